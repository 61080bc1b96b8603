"""Hash chains and Merkle trees over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.session import cut


def merkle_levels(leaves: DataFrame, place: str = "place", digest: str = "hash") -> list[DataFrame]:
    """Levels (place, hash) from the leaves to the root; an odd node is paired with itself.  Places count from 0 without gaps."""
    level = cut(leaves.select(F.col(place).cast("bigint").alias("place"), F.col(digest).alias("hash")))
    levels, n = [level], level.count()
    while n > 1:
        pairs = level.groupBy(F.floor(F.col("place") / 2).alias("place")).agg(F.min_by("hash", "place").alias("l"), F.max_by("hash", "place").alias("r"))
        level = cut(pairs.select("place", F.sha2(F.concat("l", "r"), 256).alias("hash")))
        levels.append(level)
        n = -(-n // 2)
    return levels


def inclusion_proofs(levels: list[DataFrame]) -> DataFrame:
    """(leaf, depth, sibling, on_left) for every leaf."""
    out = None
    for depth, level in enumerate(levels[:-1]):
        leaves = levels[0].select(F.col("place").alias("leaf")).withColumn("at", F.shiftright("leaf", depth))
        beside = F.col("at").bitwiseXOR(F.lit(1))
        known = level.select(F.col("place").alias("s_place"), F.col("hash").alias("sibling"))
        own = level.select(F.col("place").alias("o_place"), F.col("hash").alias("own"))
        step = leaves.join(known, beside == F.col("s_place"), "left").join(own, F.col("at") == F.col("o_place")).select("leaf", F.lit(depth).alias("depth"), F.coalesce("sibling", "own").alias("sibling"), (F.col("at") % 2 == 1).alias("on_left"))
        out = step if out is None else out.unionByName(step)
    return out if out is not None else levels[0].select(F.col("place").alias("leaf"), F.lit(0).alias("depth"), F.col("hash").alias("sibling"), F.lit(False).alias("on_left")).where("false")


def broken_links(events: DataFrame, stream: str, order: list[str], previous: str, digest: str) -> DataFrame:
    """Rows whose stored ``previous`` hash is not the ``digest`` of the row before them in their stream."""
    before = F.lag(digest).over(Window.partitionBy(stream).orderBy(*order))
    return events.withColumn("expected", before).where("expected is not null").where(~F.col(previous).eqNullSafe(F.col("expected")))
