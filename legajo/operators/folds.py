"""Order-dependent operators: a fold over each key's rows with memory for one state only."""

from __future__ import annotations

import hashlib
import heapq
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_fold(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, object]], name: str, kind: str) -> DataFrame:
    """``df`` with a column ``name`` of type ``kind``: what ``step`` gives for each row in the ``order`` of its key.

    Rows are shuffled by ``key`` and sorted on disk if need be; they stream
    through Python with the state of the present key alone, so that a key of any
    size needs little memory (its rows stay one sequence, as the semantics ask).
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType() if kind == "string" else T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, present, begun = None, None, False
        for part in batches:
            out = []
            for row in part.to_pylist():
                if not begun or row[key] != present:
                    state, present, begun = start(), row[key], True
                state, value = step(state, row)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string() if kind == "string" else pa.bool_())], names=[*part.schema.names, name])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def chained_hashes(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """``events`` with ``event_hash``: SHA-256 over the hash of the event before and the event's own fields."""

    def step(before: object, row: dict) -> tuple[object, object]:
        digest = hashlib.sha256("|".join([str(before), *("" if row[f] is None else str(row[f]) for f in fields)]).encode()).hexdigest()
        return digest, digest

    return ordered_fold(events, key, order, lambda: "", step, "event_hash", "string")


def rate_limited(alerts: DataFrame, rule: str, seconds: str, limit: int, window: float = 3600.0) -> DataFrame:
    """``alerts`` with ``emitted``: false where ``limit`` alerts of the rule were already emitted in the trailing window."""

    def step(recent: object, row: dict) -> tuple[object, object]:
        while recent and recent[0] <= row[seconds] - window:
            recent.popleft()
        emitted = len(recent) < limit
        if emitted:
            recent.append(row[seconds])
        return recent, emitted

    return ordered_fold(alerts, rule, [seconds], deque, step, "emitted", "boolean")


def circuit_states(calls: DataFrame, service: str, order: list[str], seconds: str, failed: str, failures: int = 5, timeout: float = 60.0) -> DataFrame:
    """``calls`` with the breaker's ``state`` after each: closed, open after ``failures`` in a row, half_open past ``timeout``."""

    def step(now: object, row: dict) -> tuple[object, object]:
        state, count, opened = now
        if state == "open" and row[seconds] - opened >= timeout:
            state = "half_open"
        if state == "half_open":
            state, count, opened = ("open", count, row[seconds]) if row[failed] else ("closed", 0, 0.0)
        elif state == "closed":
            count = count + 1 if row[failed] else 0
            if count >= failures:
                state, opened = "open", row[seconds]
        return (state, count, opened), state

    return ordered_fold(calls, service, order, lambda: ("closed", 0, 0.0), step, "state", "string")


def submodular_choice(evidence: DataFrame, key: str, group: str, score: str, row_id: str, budget: int) -> DataFrame:
    """(key, row_id, place): greedy choice of ``budget`` rows by (diversity + score) / (1 + .1 n), diversity being 1 for a new group.

    A greedy round takes the best row of a group, and of the groups not yet
    represented the one with the best row.  So only the ``budget`` best rows of the
    ``budget`` best groups of a key can be chosen; each key is first cut to these,
    exactly, and the rounds run on at most ``budget`` squared rows.
    """
    rows = evidence.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(score).cast("double").alias("s"), F.col(row_id).alias("i"))
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("k", "g").orderBy(F.desc("s"), "i"))).where(F.col("r") <= budget)
    heads = few.where("r = 1").withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("s"), "i"))).where(F.col("place") <= budget)
    few = few.join(heads.select(F.col("k").alias("h_k"), F.col("g").alias("h_g")), F.col("k").eqNullSafe(F.col("h_k")) & F.col("g").eqNullSafe(F.col("h_g")), "left_semi")
    packed = few.groupBy("k").agg(F.collect_list(F.struct("g", "s", "i")).alias("rows"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out: list[list] = [[], [], []]
            for name, left in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                left.sort(key=lambda r: (-(r["s"] if r["s"] is not None else -1e300), r["i"]))
                groups: set = set()
                for place in range(1, min(budget, len(left)) + 1):
                    at = max(range(len(left)), key=lambda i: ((left[i]["g"] not in groups) + (left[i]["s"] or 0.0), -i))
                    row = left.pop(at)
                    groups.add(row["g"])
                    for column, value in zip(out, (name, row["i"], place), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], part.schema.field(0).type), pa.array(out[1], part.schema.field(1).type.value_type.field("i").type), pa.array(out[2], pa.int32())], names=[key, row_id, "place"])

    kinds = dict(few.dtypes)
    return packed.mapInArrow(choose, f"{key} {kinds['k']}, {row_id} {kinds['i']}, place int")


def greedy_coverage(tasks: list[tuple], budget: float) -> list:
    """Ids of ``tasks`` (id, covered items, cost, needed ids or none) in the order of choice: the most new items for the cost first, within ``budget``.

    A task waits until all that it needs is chosen, so every prefix of the choice
    can be carried out and covers no less than the one before.  Gains only fall, so
    a task whose old gain is best is weighed anew and taken if it stays best.
    """
    known = {t[0] for t in tasks}
    waits = {t[0]: {n for n in t[3] or () if n != t[0]} for t in tasks}
    followers: dict = {}
    for name, needs in waits.items():
        for n in needs:
            followers.setdefault(n, []).append(name)
    by_name = {t[0]: t for t in tasks}
    covered: set = set()
    chosen: list = []
    heap = [(-len(set(t[1])) / max(t[2], 1e-9), t[0]) for t in tasks if not waits[t[0]]]
    heapq.heapify(heap)
    while heap:
        promised, name = heapq.heappop(heap)
        _, items, cost, _ = by_name[name]
        gain = -len(set(items) - covered) / max(cost, 1e-9)
        if gain > promised:
            heapq.heappush(heap, (gain, name))
            continue
        if gain == 0 and not followers.get(name) or cost > budget:
            continue
        budget -= cost
        covered |= set(items)
        chosen.append(name)
        for other in followers.get(name, ()):
            waits[other].discard(name)
            if not waits[other] and other in known:
                heapq.heappush(heap, (-len(set(by_name[other][1]) - covered) / max(by_name[other][2], 1e-9), other))
    return chosen


def coverage_choice(tasks: DataFrame, key: str, budget: float) -> DataFrame:
    """(key, task, place) of :func:`greedy_coverage` for the tasks (key, task, covers, cost, needs) of each key.

    A task stands once in a key (of repeated ones the cheapest counts); null
    costs are taken for 0.  The choice is sequential, so the tasks of one key, the
    steps of one plan, go to one task.
    """
    kinds = dict(tasks.dtypes)
    row = F.struct("covers", F.coalesce("cost", F.lit(0.0)).cast("double").alias("cost"), "needs")
    plain = tasks.where("task is not null").groupBy(key, "task").agg(F.min_by(row, F.coalesce("cost", F.lit(0.0))).alias("t")).select(F.col(key).alias("key_"), F.struct("task", "t.*").alias("t"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out: list[list] = [[], [], []]
            for name, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                picked = greedy_coverage(sorted(((t["task"], t["covers"] or [], t["cost"], t["needs"]) for t in own), key=lambda t: t[0]), budget)
                out[0] += [name] * len(picked)
                out[1] += picked
                out[2] += range(1, len(picked) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], part.schema.field(0).type), pa.array(out[1], part.schema.field(1).type.value_type.field("task").type), pa.array(out[2], pa.int32())], names=[key, "task", "place"])

    return plain.groupBy("key_").agg(F.collect_list("t").alias("tasks")).mapInArrow(choose, f"{key} {kinds[key]}, task {kinds['task']}, place int")
