"""Greedy packing of text units as an ordered fold on the JVM, and overlaps between chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.functions.session import WHITE


def words(text: Column) -> Column:
    """Number of runs of visible characters."""
    return F.regexp_count(text, F.lit(f"[^{WHITE}]+"))


def units(text: Column, pattern: str) -> Column:
    """Parts of ``text`` between matches of ``pattern`` that hold visible characters."""
    return F.filter(F.split(text, pattern), lambda u: F.trim(u) != "")


def pack_greedily(parts: Column, limit: int, glue: str = " ") -> Column:
    """Array of chunks: units joined in order while they stay within ``limit`` words; a longer unit is a chunk of its own."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(state: Column, part: Column) -> Column:
        fits = (state["n"] == 0) | (state["n"] + words(part) <= limit)
        return F.struct(
            F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"]))).alias("done"),
            F.when(state["n"] == 0, part).when(fits, F.concat(state["open"], F.lit(glue), part)).otherwise(part).alias("open"),
            F.when(fits, state["n"] + words(part)).otherwise(words(part)).alias("n"),
        )

    return F.aggregate(parts, empty, step, lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def sentence_chunks(df: DataFrame, key: str, text: str, limit: int = 512) -> DataFrame:
    """(key, pos, chunk) of sentences packed to ``limit`` words; null texts give no rows."""
    return df.select(key, F.posexplode(pack_greedily(units(F.col(text), r"(?<=[.!?])\s+"), limit)).alias("pos", "chunk"))


def paragraph_chunks(df: DataFrame, key: str, text: str, limit: int = 512) -> DataFrame:
    """(key, pos, chunk) of paragraphs packed to ``limit`` words."""
    return df.select(key, F.posexplode(pack_greedily(units(F.col(text), r"\n\s*\n"), limit, "\n\n")).alias("pos", "chunk"))


def hybrid_chunks(df: DataFrame, key: str, text: str, limit: int = 512) -> DataFrame:
    """Paragraph chunks, those over ``limit`` words packed again by sentences."""
    pieces = F.transform(pack_greedily(units(F.col(text), r"\n\s*\n"), limit, "\n\n"), lambda c: F.when(words(c) > limit, pack_greedily(units(c, r"(?<=[.!?])\s+"), limit)).otherwise(F.array(c)))
    return df.select(key, F.posexplode(F.flatten(pieces)).alias("pos", "chunk"))


def evidence_chunks(df: DataFrame, key: str, text: str, limit: int = 100, least: int = 10) -> DataFrame:
    """Sentences without their marks packed to ``limit`` words, chunks under ``least`` words dropped as the operator asks."""
    packed = F.filter(pack_greedily(units(F.col(text), r"[.!?]+"), limit, ". "), lambda c: words(c) >= least)
    return df.select(key, F.posexplode(packed).alias("pos", "chunk"))


def with_overlap(chunks: DataFrame, key: str, tokens: int = 20, ratio: float = 0.1) -> DataFrame:
    """``chunks`` with the last max(tokens, ratio of its words) words of the chunk before put in front, the first unchanged."""
    split = F.filter(F.split("chunk", r"\s+"), lambda w: w != "")
    ready = chunks.withColumn("w", split)
    before = ready.select(F.col(key).alias("b_key"), (F.col("pos") + 1).alias("b_pos"), F.expr(f"slice(w, -least(size(w), greatest({tokens}, cast(floor({ratio} * size(w)) as int))), size(w))").alias("tail"))
    joined = ready.join(before, (F.col(key) == F.col("b_key")) & (F.col("pos") == F.col("b_pos")), "left")
    return joined.select(key, "pos", F.concat_ws(" ", F.array_join("tail", " "), F.col("chunk")).alias("chunk"))
