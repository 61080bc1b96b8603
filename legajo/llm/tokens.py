"""Sizes of texts in tokens of a public tokenizer, and ranks within groups without a hot task."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Folder of the public vocabularies, the same on every machine, and the file used.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of a group that one task ranks, on average.
ROWS_PER_TASK = 1_000_000


@lru_cache(maxsize=4)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, *keep, n_tokens) of whole texts, one row for each ``doc_id``; null ids and texts give no rows, the empty text has size 0.

    Of several texts under one id the largest counts, with its other columns.
    """
    path = f"{folder}/{vocabulary}"
    base = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), *keep, F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    kept = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in keep)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for part in batches:
            sizes = pa.array([len(encode(t)) for t in part.column(part.num_columns - 1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], sizes], names=["doc_id", *keep, "n_tokens"])

    sized = base.mapInArrow(measure, f"doc_id bigint, {kept + ', ' if kept else ''}n_tokens int")
    return sized.groupBy("doc_id").agg(F.max(F.struct("n_tokens", *keep)).alias("best")).select("doc_id", *[F.col(f"best.{c}").alias(c) for c in keep], F.col("best.n_tokens").alias("n_tokens"))


def ranked(items: DataFrame, group: list[str], order: list[str], rank: str = "rank", rows: int | None = None) -> DataFrame:
    """``items`` with the 0-based place of each row within its group, by a hash of ``order``, then ``order``.

    A group is spread over salts, the leading bits of the hash; places are counted
    within (group, salt) and shifted by the counts of the salts before, so a group
    that holds a third of all rows is ranked by many tasks, and the ranks do not
    depend on the number of salts.
    """
    total = items.count() if rows is None else rows
    bits = max(0, -(-total // ROWS_PER_TASK) - 1).bit_length()
    hashed = items.withColumn("salt_hash", F.xxhash64(*order))
    # the sign bit turned, the hash grows with its leading bits
    salted = hashed.withColumn("salt", F.shiftrightunsigned(F.col("salt_hash").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("bigint"))
    before = Window.partitionBy(*group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = salted.groupBy(*group, "salt").agg(F.count("*").alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = salted.withColumn("place", F.row_number().over(Window.partitionBy(*group, "salt").orderBy("salt_hash", *order)) - 1)
    return placed.join(shifts, [*group, "salt"]).withColumn(rank, (F.col("place") + F.col("shift")).cast("bigint")).drop("salt", "salt_hash", "place", "shift")
