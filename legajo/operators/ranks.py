"""Places in an order over all rows, or over the rows of few groups, without one task that sorts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.session import cut_table


def places(df: DataFrame, order: list[Column], group: tuple[str, ...] = (), place: str = "place") -> DataFrame:
    """``df`` with the 0-based ``place`` of each row in ``order``, within its group if one is named.

    Rows are sorted over ranges of (group, order), counted within each range, and
    shifted by the counts of the ranges before; a group may hold all rows.  The
    order has to be total for the places to be repeatable.
    """
    ranged = cut_table(df.repartitionByRange(*map(F.col, group), *order).withColumn("range_no", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range and each group in it
    shifts = ranged.groupBy(*group, "range_no").agg(F.count("*").alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counted = ranged.withColumn("own_place", F.row_number().over(Window.partitionBy(*group, "range_no").orderBy(*order)) - 1)
    renamed = shifts.withColumnsRenamed({c: f"s_{c}" for c in (*group, "range_no")})
    same = F.col("range_no") == F.col("s_range_no")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    return counted.join(renamed, same).withColumn(place, F.col("own_place") + F.col("shift")).select(*df.columns, place)


def order_statistics(df: DataFrame, group: str, value: str, at: dict[str, Column], ties: tuple[str, ...] = ()) -> DataFrame:
    """(group, n, *at): the values at the given 0-based places of each group, where a place may use the group's size ``n``.

    A place beyond the group gives null.
    """
    placed = places(df.select(group, value, *ties), [F.col(value), *map(F.col, ties)], (group,))
    sizes = df.groupBy(F.col(group).alias("size_group")).agg(F.count("*").alias("n"))
    met = placed.join(sizes, F.col(group).eqNullSafe(F.col("size_group")))
    hits = met.select(group, "n", value, *[(F.col("place") == where).alias(f"hit_{name}") for name, where in at.items()])
    return hits.groupBy(group, "n").agg(*[F.max(F.when(F.col(f"hit_{name}"), F.col(value))).alias(name) for name in at])
