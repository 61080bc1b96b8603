"""Near copies by Jaccard similarity of word shingles, exact by prefix filtering."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from legajo.functions.session import cut, cut_table

#: Rows that a join may broadcast; estimates of Spark's own, made from compressed files, are not relied on.
BROADCAST_ROWS = 100_000
#: Counters of the rarity of shingles, in blocks that are summed up apart.
COUNTERS, BLOCKS = 1 << 23, 64


def few(df: DataFrame) -> DataFrame:
    """``df``, materialised, as the side of a join: broadcast up to ``BROADCAST_ROWS`` rows, else sorted and merged."""
    known = cut_table(df)
    return F.broadcast(known) if known.count() <= BROADCAST_ROWS else known.hint("merge")


def copy_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, class_id, chars, words): texts of the same words in the same order are one class, named after its longest text.

    Of texts of one length the smallest key names the class; texts without words are left out.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    sized = docs.select(F.col(key).alias("doc_id"), words.alias("words"), F.length(text).alias("chars")).where("size(words) > 0")
    marked = cut_table(sized.withColumn("digest", F.sha2(F.concat_ws(" ", "words"), 256)))
    named = marked.groupBy("digest").agg(F.max_by("doc_id", F.struct("chars", -F.col("doc_id"))).alias("class_id"), F.count("*").alias("n"))
    repeated = few(named.where("n > 1").select("digest", "class_id"))
    return marked.join(repeated, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "chars", "words")


def _shingles(words: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of each distinct shingle, by row and shingle; a shingle is a number of 64 bits."""
    coded = words.flatten().dictionary_encode()
    names = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in coded.dictionary.to_pylist()], np.uint64)
    named = names[coded.indices.to_numpy(zero_copy_only=False)]
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    row, end = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size), size)
    place = np.arange(len(row))
    total = np.zeros(len(row), np.uint64)
    for i in range(width):
        at = place + i
        total = total * np.uint64(0x9E3779B97F4A7C15) + np.where(at < end, named[np.minimum(at, len(row) - 1)], np.uint64(0))
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(29)
    first = end - np.repeat(size, size)
    whole = (place + width <= end) | (place == first)
    row, total = row[whole], total[whole]
    order = np.lexsort((total, row))
    row, total = row[order], total[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (total[1:] != total[:-1])
    return row[new], total[new]


def _counter(shingle: np.ndarray) -> np.ndarray:
    return (shingle & np.uint64(COUNTERS - 1)).astype(np.int64)


def _rarity(sets: DataFrame, width: int) -> np.ndarray:
    """For each counter how often its shingles occur, in 255 steps; 0 if they occur once or never."""
    part = COUNTERS // BLOCKS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            at, more = np.unique(_counter(_shingles(batch.column(0), width)[1]), return_counts=True)
            n[at] += more.astype(np.uint32)
        for block in range(BLOCKS):
            own = n[block * part : (block + 1) * part]
            if len(at := np.flatnonzero(own).astype(np.uint32)):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([own[at].tobytes()], pa.binary())], ["block", "at", "n"])

    def summed(group: pa.Table) -> pa.Table:
        n = np.zeros(part)
        for at, more in zip(group["at"].to_pylist(), group["n"].to_pylist(), strict=True):
            n[np.frombuffer(at, np.uint32)] += np.frombuffer(more, np.uint32)
        step = np.minimum(255, np.ceil(12 * np.log2(np.maximum(n, 1)))).astype(np.uint8)
        return pa.table({"block": group["block"].slice(0, 1), "step": pa.array([step.tobytes()], pa.binary())})

    rarity = np.zeros(COUNTERS, np.uint8)
    counts = sets.select("words").mapInArrow(counted, "block int, at binary, n binary")
    for r in counts.groupBy("block").applyInArrow(summed, "block int, step binary").collect():
        rarity[r.block * part : (r.block + 1) * part] = np.frombuffer(r.step, np.uint8)
    return rarity


def _heads(sets: DataFrame, threshold: float, width: int) -> DataFrame:
    """(id, n, pos, shingle): of each set the first n - ceil(threshold * n) + 1 shingles from the rarest on, without those of no other set."""
    shared = sets.sparkSession.sparkContext.broadcast(_rarity(sets, width))

    def cut_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, shingle = _shingles(batch.column(1), width)
            step = shared.value[_counter(shingle)]
            order = np.lexsort((shingle, step, row))
            shingle, step = shingle[order], step[order]
            n = np.bincount(row, minlength=batch.num_rows)
            pos, size = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), np.repeat(n, n)
            taken = np.flatnonzero((pos <= size - np.ceil(threshold * size - 1e-9)) & (step > 0))
            ids = batch.column(0).take(pa.array(row[taken]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(size[taken].astype(np.int32)), pa.array(pos[taken].astype(np.int32)), pa.array(shingle[taken].view(np.int64))], ["id", "n", "pos", "shingle"])

    kinds = StructType([StructField("id", sets.schema["id"].dataType), StructField("n", IntegerType()), StructField("pos", IntegerType()), StructField("shingle", LongType())])
    return sets.select("id", "words").mapInArrow(cut_off, kinds)


def similar_pairs(sets: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """(id_a, id_b, jaccard) with id_a < id_b for every pair of (id, words) whose shingles reach ``threshold``.

    Shingles are ordered from the rarest on.  Two sets that reach the threshold
    share one within the first n - ceil(threshold * n) + 1 of each, so only these
    are joined; sizes and places rule out further pairs and the rest is counted
    in full.  Rarity is counted by hashed counters: any order that is the same
    for all sets is right, a good one makes few pairs.  A text shorter than
    ``width`` words is one shingle.  ``sets`` is read several times and had
    better be a table.
    """
    heads = cut_table(_heads(sets, threshold, width))
    a = heads.select("shingle", F.col("id").alias("id_a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"))
    b = heads.select("shingle", F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"))
    needed = threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9
    bound = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    pairs = cut_table(a.join(b.hint("merge"), "shingle").where(F.col("id_a") < F.col("id_b")).where(bound >= needed).select("id_a", "id_b").distinct())
    asked = few(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct())

    def listed(words: pa.Array) -> pa.Array:
        row, shingle = _shingles(words, width)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(words)))])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(shingle.view(np.int64)))

    known = sets.join(asked, "id", "left_semi").select("id", F.arrow_udf(listed, "array<bigint>")("words").alias("s"))
    both = pairs.join(known.select(F.col("id").alias("id_a"), F.col("s").alias("s_a")).hint("merge"), "id_a").join(known.select(F.col("id").alias("id_b"), F.col("s").alias("s_b")).hint("merge"), "id_b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    counted = both.select("id_a", "id_b", shared.alias("i"), (F.size("s_a") + F.size("s_b") - shared).alias("u"))
    return counted.where(F.col("i") >= threshold * F.col("u") - 1e-9).select("id_a", "id_b", (F.col("i") / F.col("u")).alias("jaccard"))


def removed_copies(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, class_id, keeper, jaccard) of every text that a pass from the longest on leaves out.

    A class is left out if it is similar to a kept one before it (longer, or as
    long with a smaller id); ``keeper`` is the first such.  A round keeps the
    classes without an open class before them and drops those similar to them.
    """
    order = classes.where("doc_id = class_id").select(F.col("class_id").alias("id"), F.struct(-F.col("chars"), F.col("class_id")).alias("place")).hint("merge")
    placed = pairs.join(order.select(F.col("id").alias("id_a"), F.col("place").alias("p_a")), "id_a").join(order.select(F.col("id").alias("id_b"), F.col("place").alias("p_b")), "id_b")
    first = F.col("p_a") < F.col("p_b")
    edges = cut(placed.select(F.when(first, F.col("id_a")).otherwise(F.col("id_b")).alias("early"), F.when(first, F.col("id_b")).otherwise(F.col("id_a")).alias("late"), F.least("p_a", "p_b").alias("place"), "jaccard"))
    kept, out = edges.select(F.col("early").alias("id")).limit(0), edges.select(F.col("late").alias("id")).limit(0)
    open_ = edges.select("early", "late")
    while not open_.isEmpty():
        fresh = cut(open_.select(F.col("early").alias("id")).distinct().join(open_.select(F.col("late").alias("id")), "id", "left_anti"))
        gone = cut(open_.join(fresh.withColumnRenamed("id", "early"), "early", "left_semi").select(F.col("late").alias("id")).distinct())
        kept, out = kept.unionByName(fresh), out.unionByName(gone)
        settled = fresh.unionByName(gone)
        left = open_.join(settled.withColumnRenamed("id", "early"), "early", "left_anti").join(settled.withColumnRenamed("id", "late"), "late", "left_anti")
        # classes whose open neighbours are all gone are kept without an edge of their own
        loose = open_.select("late").union(open_.select("early")).distinct().withColumnRenamed("late", "id").join(settled, "id", "left_anti")
        kept = kept.unionByName(loose.join(left.select(F.col("early").alias("id")).union(left.select("late")), "id", "left_anti"))
        open_ = cut(left)
    dropped = edges.join(cut(kept).withColumnRenamed("id", "early"), "early", "left_semi").join(out.withColumnRenamed("id", "late"), "late", "left_semi")
    best = dropped.groupBy(F.col("late").alias("class_id")).agg(F.min_by(F.struct("early", "jaccard"), "place").alias("k"))
    found = classes.join(best.hint("merge"), "class_id", "left").where("k is not null or doc_id <> class_id")
    return found.select("doc_id", "class_id", F.coalesce("k.early", "class_id").alias("keeper"), F.coalesce("k.jaccard", F.lit(1.0)).alias("jaccard"))
