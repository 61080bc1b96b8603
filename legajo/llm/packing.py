"""Filling containers of fixed capacity with texts of varying length.

Everything that decides is done on the histogram of lengths, whose size is
bounded by the capacity however many texts there are:

1. :func:`bucket_bounds`: dynamic programming chooses the length buckets that
   minimise padding;
2. :func:`_batch`: token-budget batches form inside each bucket, from the longest
   bucket down: items in order of length, closed by the first that the budget
   does not hold;
3. :func:`_fill`: what a closed batch leaves unused is given to items of shorter
   buckets, never to its own.

The bounds decide both where a batch closes and what may fill it.  The outcome
is a short table of patterns; each item finds its container by its rank among
the items of its length.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions.session import cut_table
from legajo.llm.tokens import ranked

BUCKETS = 16
#: Bits of the rank in the key that an item is looked up by.
_RANK_BITS = 44


def bucket_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` length classes with the least total padding (items padded to their bound)."""
    lengths = np.array(sorted(histogram), dtype=np.float64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(v)] for v in lengths], dtype=np.float64)
    items, tokens = np.r_[0.0, counts.cumsum()], np.r_[0.0, (counts * lengths).cumsum()]
    n = len(lengths)
    best = lengths * items[1:] - tokens[1:]  # one bucket up to each length
    back = [np.zeros(n, dtype=int)]
    for _ in range(1, min(buckets, n)):
        following, chosen = best.copy(), np.arange(n) * 0 - 1
        for j in range(1, n):
            cost = best[:j] + lengths[j] * (items[j + 1] - items[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            k = int(cost.argmin())
            if cost[k] < following[j]:
                following[j], chosen[j] = cost[k], k
        best = following
        back.append(chosen)
    bounds, j = [], n - 1
    for chosen in reversed(back[1:]):
        if chosen[j] >= 0:
            bounds.append(int(lengths[j]))
            j = int(chosen[j])
    bounds.append(int(lengths[j]))
    return sorted(set(bounds))


def _batch(own: list[int], left: dict[int, int], room: int) -> tuple[list[tuple[int, int]], int]:
    """(contents, room left) of one batch of the bucket lengths ``own`` (ascending): the longest first, up to the first item beyond the budget."""
    content = []
    for length in reversed(own):
        copies = min(room // length, left[length])
        if copies:
            content.append((length, copies))
            room -= copies * length
        if copies < left[length]:
            break
    return content, room


def _fill(shorter: list[int], left: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Items of the lengths ``shorter`` (ascending) for the ``room`` that a batch leaves, the longest that fit first."""
    content = []
    at = bisect_right(shorter, room) - 1
    while at >= 0:
        length = shorter[at]
        copies = min(room // length, left[length])
        content.append((length, copies))
        room -= copies * length
        at = bisect_right(shorter, room, 0, at) - 1
    return content


def patterns(histogram: dict[int, int], capacity: int, buckets: int = BUCKETS, fill: bool = True) -> list[tuple[int, list[tuple[int, int]], int]]:
    """(times, [(length, copies)], bucket): contents of containers that together hold the histogram; lengths are 1 to ``capacity``.

    ``fill`` false leaves out the last step: batches of their own bucket only.
    """
    left = {length: count for length, count in histogram.items() if count > 0}
    bounds = bucket_bounds(left, buckets)
    ordered = sorted(left)
    out = []
    for bucket in range(len(bounds) - 1, -1, -1):
        low = bounds[bucket - 1] if bucket else 0
        while (border := bisect_right(ordered, low)) < len(ordered):
            content, room = _batch(ordered[border:], left, capacity)
            if fill:
                content += _fill(ordered[:border], left, room)
            times = min(left[length] // copies for length, copies in content)
            for length, copies in content:
                left[length] -= copies * times
                if not left[length]:
                    ordered.remove(length)
            out.append((times, content, bucket))
    return out


def plan_rows(spec_id: int, histogram: dict[int, int], capacity: int, buckets: int = BUCKETS, fill: bool = True) -> list[tuple]:
    """(spec_id, length, first, last, copies, base, bucket): which ranks of a length go to which containers."""
    rows, used, base = [], dict.fromkeys(histogram, 0), 0
    for times, content, bucket in patterns(histogram, capacity, buckets, fill):
        for length, copies in content:
            rows.append((spec_id, length, used[length], used[length] + copies * times, copies, base, bucket))
            used[length] += copies * times
        base += times
    return rows


def _locator(rows: list[tuple]) -> Column:
    """struct<container_id, bucket> of (spec_id, length, rank), by binary search in the plan ``rows``, which go along with the function."""
    plan: dict[int, tuple[np.ndarray, ...]] = {}
    for spec_id in {r[0] for r in rows}:
        own = sorted((r[1] << _RANK_BITS | r[2], *r[2:]) for r in rows if r[0] == spec_id)
        plan[spec_id] = tuple(np.array(column, dtype=np.int64) for column in zip(*own, strict=True))

    def locate(spec: pa.Array, length: pa.Array, rank: pa.Array) -> pa.Array:
        specs, lengths, ranks = (np.asarray(a).astype(np.int64) for a in (spec, length, rank))
        container, bucket = np.zeros(len(specs), np.int64), np.zeros(len(specs), np.int32)
        for spec_id in np.unique(specs):
            at = np.flatnonzero(specs == spec_id)
            keys, first, _, copies, base, buckets = plan[int(spec_id)]
            row = np.searchsorted(keys, lengths[at] << _RANK_BITS | ranks[at], side="right") - 1
            container[at] = base[row] + (ranks[at] - first[row]) // copies[row]
            bucket[at] = buckets[row]
        return pa.StructArray.from_arrays([pa.array(container), pa.array(bucket)], names=["container_id", "bucket"])

    return F.arrow_udf(locate, "container_id bigint, bucket int")("spec_id", "length", "rank")


def pack(spark: SparkSession, sizes: DataFrame, specs: DataFrame, buckets: int = BUCKETS, fill: bool = True) -> DataFrame:
    """(spec_id, container_id, bucket, doc_id, part_no, start_token, n_tokens) for every text and every capacity.

    ``sizes`` has doc_id and n_tokens, ``specs`` spec_id and capacity_tokens.  A
    text larger than the capacity is cut into full containers and a rest; any
    other stays whole.  Texts of size 0 lie in container 0.  Specs without a
    positive capacity give no rows.  The histogram and the plan brought to the
    driver have at most ``capacity`` lengths for each spec; every text meets every
    spec, which is what is asked for, so the specs are the few rows of a setting.
    """
    wanted = {r.spec_id: r.capacity for r in specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("int").alias("capacity")).where("spec_id is not null and capacity > 0").groupBy("spec_id").agg(F.max("capacity").alias("capacity")).collect()}
    pairs = F.array(*[F.struct(F.lit(k).cast("int").alias("spec_id"), F.lit(v).cast("int").alias("capacity")) for k, v in sorted(wanted.items())]) if wanted else F.expr("cast(array() as array<struct<spec_id int, capacity int>>)")
    parts = sizes.select("doc_id", F.col("n_tokens").cast("int").alias("size"), F.explode(pairs).alias("spec")).select("doc_id", "size", "spec.*").withColumn("part_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / F.col("capacity")).cast("int") - 1))))
    parts = parts.withColumn("start_token", F.col("part_no") * F.col("capacity")).withColumn("length", F.least("capacity", F.col("size") - F.col("start_token"))).select("spec_id", "doc_id", "part_no", "start_token", "length")
    parts = cut_table(parts)
    counts: dict[int, dict[int, int]] = {}
    for row in parts.where("length > 0").groupBy("spec_id", "length").count().collect():
        counts.setdefault(row.spec_id, {})[row.length] = row["count"]
    rows = [r for spec_id, histogram in counts.items() for r in plan_rows(spec_id, histogram, wanted[spec_id], buckets, fill)]
    placed = ranked(parts.where("length > 0"), ["spec_id", "length"], ["doc_id", "part_no"]).withColumn("place", _locator(rows))
    found = placed.select("spec_id", "place.container_id", "place.bucket", "doc_id", "part_no", "start_token", F.col("length").alias("n_tokens"))
    empty = parts.where("length = 0").select("spec_id", F.lit(0).cast("bigint").alias("container_id"), F.lit(0).alias("bucket"), "doc_id", "part_no", "start_token", F.col("length").alias("n_tokens"))
    return found.unionByName(empty)


def usage(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, containers, tokens, unused_share) of a packing."""
    filled = packed.where("n_tokens > 0").groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("tokens")).groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return filled.join(specs.select("spec_id", "capacity_tokens").dropDuplicates(["spec_id"]), "spec_id").select("spec_id", "capacity_tokens", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share"))
