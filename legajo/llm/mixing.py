"""Mixing sources to target shares of tokens by systematic sampling.

A source that is to give so many tokens repeats each of its documents that many
tokens divided by its own times on average.  Documents of a source are put in
order of size; their expected copies are summed up from the first on, one random
offset is added, and a copy is emitted for each whole number passed.  A document
thus gets the floor or the ceiling of its expected copies, and long and short
ones are drawn evenly.

The mix is as large as the sources it names.  A source whose cap does not reach
its share gives all that it has, each document as often as the cap allows; the
others fill the mix in proportion to their shares.  The report names the tokens
that each source falls short by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.session import cut_table
from legajo.llm.tokens import ranked

def targets(mix: DataFrame) -> DataFrame:
    """(mix_id, source, share, cap): one row for each source of a mix, shares made to add up to 1.

    Rows without a mix, a source or a positive share are left out; of repeated
    rows the largest share and cap hold; a null cap is none.
    """
    known = mix.select(F.col("mix_id").cast("string").alias("mix_id"), F.col("source").cast("string").alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap"))
    known = known.where("mix_id is not null and source is not null and share > 0").groupBy("mix_id", "source").agg(F.max("share").alias("share"), F.max("cap").alias("cap"))
    return known.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy("mix_id")))


def rates(sizes: DataFrame, mix: DataFrame, total_tokens: int | None = None, exact_shares: bool = False) -> DataFrame:
    """(mix_id, source, target_share, cap, tokens, wanted, rate): expected copies of each document of a source.

    ``total_tokens`` is the size of a mix; without it, all tokens of its sources,
    each once.  ``wanted`` is a source's share of it.  Sources are filled in
    order of what their cap allows for each unit of share: one that cannot reach
    its part of what is left gives all it has, and the rest is shared in
    proportion.  With ``exact_shares`` a mix is instead no larger than all caps
    allow at the exact shares, however small that is.  Sources without tokens
    have rate 0.
    """
    asked = targets(mix)
    owned = sizes.groupBy(F.col("source").alias("o_source")).agg(F.sum("n_tokens").cast("bigint").alias("tokens"))
    joined = asked.join(owned, F.col("source") == F.col("o_source"), "left").drop("o_source").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    whole = Window.partitionBy("mix_id")
    real = F.when(F.col("tokens") > 0, F.col("share"))
    joined = joined.withColumn("part", F.coalesce(real / F.sum(real).over(whole), F.lit(0.0)))
    # the most tokens of a source, and the size of mix up to which that meets its share
    joined = joined.withColumn("most", F.coalesce(F.col("cap") * F.col("tokens").cast("double"), F.lit(float("inf")))).withColumn("reach", F.when(F.col("part") > 0, F.col("most") / F.col("part")))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.sum("tokens").over(whole).cast("double")
    if exact_shares:
        total = F.least(total, F.min("reach").over(whole)) if total_tokens is not None else F.coalesce(F.when(F.min("reach").over(whole) < float("inf"), F.min("reach").over(whole)), total)
    joined = joined.withColumn("total", total)
    # sources that reach less come first: what is left after them, for the shares that are left
    before = Window.partitionBy("mix_id").orderBy(F.col("reach").asc_nulls_first(), "source").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.when(F.col("part") > 0, F.col("most")).otherwise(0.0)).over(before), F.lit(0.0))
    parts_left = 1 - F.coalesce(F.sum("part").over(before), F.lit(0.0))
    level = F.when((F.col("part") > 0) & (parts_left > 0), (F.col("total") - spent) / parts_left)
    # the first source that the level does not exhaust sets the level for itself and all after it
    joined = joined.withColumn("level", F.when(level <= F.col("reach"), level)).withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.struct("reach", "source"))).over(whole))
    given = F.least(F.col("most"), F.col("part") * F.coalesce("level", F.lit(float("inf"))))
    rate = F.when((F.col("tokens") > 0) & (F.col("part") > 0), given / F.col("tokens")).otherwise(0.0)
    return joined.select("mix_id", "source", F.col("share").alias("target_share"), "cap", "tokens", (F.col("part") * F.col("total")).alias("wanted"), rate.alias("rate"))


def mixed(sizes: DataFrame, mix: DataFrame, seed: int = 42, total_tokens: int | None = None, exact_shares: bool = False) -> DataFrame:
    """(mix_id, source, doc_id, n_tokens, copies): documents of each mix, ``copies`` at least 1.

    ``sizes`` has doc_id, source and n_tokens; rows without a source take no
    part.  The result depends only on the data and ``seed``.
    """
    known = sizes.where("source is not null and doc_id is not null").select("doc_id", "source", "n_tokens")
    known = cut_table(known.join(targets(mix).select("source").distinct(), "source", "left_semi"))
    # the place of a document in its source by size: the smaller sizes before it, then its rank among equals
    before = Window.partitionBy("source").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    steps = known.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = ranked(known, ["source", "n_tokens"], ["doc_id"]).join(steps, ["source", "n_tokens"]).withColumn("place", F.col("rank") + F.col("before"))
    offset = F.pmod(F.xxhash64(F.lit(seed), "mix_id", "source"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    drawn = rates(known, mix, total_tokens, exact_shares).where("rate > 0").select("mix_id", "source", "rate", offset.alias("offset"))
    passed = lambda place: F.floor(F.col("offset") + F.col("rate") * place)
    copies = (passed(F.col("place") + 1) - passed(F.col("place"))).cast("int")
    # the rates are one row for each source of a mix; Spark broadcasts them if they are small
    return placed.join(drawn, "source").select("mix_id", "source", "doc_id", "n_tokens", copies.alias("copies")).where("copies > 0")


def reached_shares(selection: DataFrame, sizes: DataFrame, mix: DataFrame, total_tokens: int | None = None, exact_shares: bool = False) -> DataFrame:
    """(mix_id, source, target_share, reached_share, documents, copies, tokens, shortfall, most_repeats, max_repeats) of a selection.

    ``shortfall`` is what a source lacks of its share of the mix because of its cap, in tokens.
    """
    given = selection.groupBy("mix_id", "source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("given"), F.max("copies").alias("most_repeats"))
    joined = rates(sizes, mix, total_tokens, exact_shares).join(given, ["mix_id", "source"], "left").withColumn("given", F.coalesce("given", F.lit(0)))
    whole = F.sum("given").over(Window.partitionBy("mix_id"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    lacking = F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col("wanted") - F.col("cap") * F.col("tokens")))
    return joined.select("mix_id", "source", "target_share", F.coalesce(F.try_divide("given", whole), F.lit(0.0)).alias("reached_share"), zero("documents"), zero("copies"), F.col("given").alias("tokens"), F.coalesce(lacking, F.lit(0)).alias("shortfall"), zero("most_repeats"), F.col("cap").alias("max_repeats"))
