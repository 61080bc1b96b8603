"""Parent-child links to full hierarchies by parallel tree contraction.

The graph has at most one parent per node.  A round of contraction does two
things at once over the live nodes:

* *rake*: every node without live children is taken out and recorded with its
  present parent and the distance to it;
* *compress*: of the nodes with exactly one child, an independent set (those
  whose round hash beats the hashes of both neighbours) is spliced out, the
  child inheriting the parent, the distance and the nodes passed over.

Rounds are logarithmic in the number of nodes whatever the depth.  A cycle is
never raked, so it shrinks to a node that is its own parent: the core that does
not terminate and exposes the cycle.  Reading the records backwards gives root,
depth and path of every node; each step joins a round's records to the nodes
already known, so total work is proportional to the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.session import WHITE, cut


def code_key(code: Column) -> Column:
    """``code`` without outer blanks, case and leading zeros."""
    trimmed = F.regexp_replace(code, f"^[{WHITE}]+|[{WHITE}]+$", "")
    return F.upper(F.regexp_replace(trimmed, "^0+(?=.)", ""))


def parent_links(components: DataFrame, code: str = "code", dependencies: str = "dependencies") -> DataFrame:
    """(code, parent) with one row for each distinct non-null ``code``.

    The parent is the first entry of ``dependencies`` whose key is that of a
    code; where several codes share a key the smallest is meant.  Republished
    rows are merged, the first resolvable entry over all of them winning.
    """
    base = components.select(F.col(code).cast("string").alias("code"), F.col(dependencies).alias("deps")).where("code is not null")
    known = base.groupBy(code_key(F.col("code")).alias("key")).agg(F.min("code").alias("target"))
    entries = base.select("code", F.posexplode("deps").alias("pos", "entry")).select("code", "pos", code_key(F.col("entry")).alias("key"))
    named = entries.where("key is not null and key <> ''").join(known, "key").groupBy("code").agg(F.min_by("target", F.struct("pos", "target")).alias("parent"))
    return base.select("code").distinct().join(named, "code", "left")


def dependency_edges(components: DataFrame, code: str = "code", dependencies: str = "dependencies") -> DataFrame:
    """(a, b) for each component ``a`` that a component ``b`` depends on, named as for :func:`parent_links`."""
    base = components.select(F.col(code).cast("string").alias("b"), F.col(dependencies).alias("deps")).where("b is not null")
    known = base.groupBy(code_key(F.col("b")).alias("key")).agg(F.min("b").alias("a"))
    entries = base.select("b", F.explode("deps").alias("entry")).select("b", code_key(F.col("entry")).alias("key"))
    return entries.where("key is not null and key <> ''").join(known, "key").select("a", "b").distinct()


def _round(live: DataFrame, number: int) -> DataFrame:
    """One round over (node, parent, dist, low[, mids]); ``gone`` marks what it takes out."""
    paths = "mids" in live.columns
    children = live.where("parent is not null").groupBy(F.col("parent").alias("p_node")).agg(F.count("*").alias("n"), F.min("node").alias("child"))
    joined = live.join(children, F.col("node") == F.col("p_node"), "left").drop("p_node")
    mark = lambda c: F.xxhash64(F.lit(number), c)
    spliced = (F.col("n") == 1) & F.col("parent").isNotNull() & (F.col("parent") != F.col("node")) & (mark(F.col("node")) > mark(F.col("child"))) & (mark(F.col("node")) > mark(F.col("parent")))
    joined = joined.withColumn("spliced", F.coalesce(spliced, F.lit(False)))
    over = joined.where("spliced").select(
        F.col("node").alias("s_node"), F.col("parent").alias("s_parent"), F.col("dist").alias("s_dist"), F.least("low", "node").alias("s_low"), *([F.concat("mids", F.array("node")).alias("s_mids")] if paths else [])
    )
    bridged = joined.join(over, F.col("parent") == F.col("s_node"), "left")
    hit = F.col("s_node").isNotNull()
    return bridged.select(
        "node",
        F.when(hit, F.col("s_parent")).otherwise(F.col("parent")).alias("parent"),
        (F.col("dist") + F.coalesce("s_dist", F.lit(0))).alias("dist"),
        F.least("low", "s_low").alias("low"),
        *([F.when(hit, F.concat("s_mids", "mids")).otherwise(F.col("mids")).alias("mids")] if paths else []),
        (F.col("n").isNull() | F.col("spliced")).alias("gone"),
    )


def resolve_hierarchy(links: DataFrame, node: str = "code", parent: str = "parent", with_paths: bool = False) -> DataFrame:
    """(code, root_code, tree_depth[, path]) for each distinct non-null ``node``.

    A parent that is no node counts as none.  Of several rows for one node the
    smallest parent holds.  On a cycle or below one ``tree_depth`` is -1,
    ``root_code`` the smallest code of that cycle and ``path`` null.  An empty
    table gives an empty result.
    """
    raw = links.select(F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent")).where("node is not null")
    merged = raw.groupBy("node").agg(F.min("parent").alias("parent"))
    real = merged.select(F.col("node").alias("parent"))
    live = merged.where("parent is not null").join(real, "parent", "left_semi")
    live = merged.select("node").join(live, "node", "left").select("node", "parent", F.lit(1).alias("dist"), F.lit(None).cast("string").alias("low"))
    if with_paths:
        live = live.withColumn("mids", F.array().cast("array<string>"))
    records: list[DataFrame] = []
    number = 0
    live = cut(live)
    while True:
        number += 1
        state = cut(_round(live, number))
        records.append(state.where("gone"))
        live = state.where("not gone").drop("gone")
        if live.where("parent is null or parent <> node").isEmpty():
            break
    mids = ["mids"] if with_paths else []
    known = live.select(
        F.col("node"), F.least("node", "low").alias("root_code"), F.lit(-1).alias("tree_depth"), *([F.lit(None).cast("array<string>").alias("path")] if with_paths else [])
    )
    for record in reversed(records):
        up = known.select(F.col("node").alias("u"), "root_code", F.col("tree_depth").alias("u_depth"), *([F.col("path").alias("u_path")] if with_paths else []))
        found = record.join(up, F.col("parent") == F.col("u"), "left")
        cyclic = F.col("u_depth") == -1
        found = found.select(
            "node",
            F.coalesce("root_code", "node").alias("root_code"),
            F.when(F.col("u").isNull(), 0).when(cyclic, -1).otherwise(F.col("u_depth") + F.col("dist")).alias("tree_depth"),
            *([F.when(F.col("u").isNull(), F.array("node")).when(~cyclic, F.concat("u_path", *mids, F.array("node"))).alias("path")] if with_paths else []),
        )
        known = cut(known.unionByName(found))
    return known.select(F.col("node").alias("code"), "root_code", "tree_depth", *(["path"] if with_paths else []))


def below_cycles(links: DataFrame, resolved: DataFrame, node: str = "code", parent: str = "parent") -> DataFrame:
    """``resolved`` with a ``path`` for nodes below a cycle too; only members of a cycle keep a null one.

    The path leads once round the cycle, ending at the member the node hangs
    from, and on down to the node.  Each cycle is opened at its smallest code,
    so the trees below it resolve like any other.
    """
    caught = resolved.where("tree_depth = -1").select("code", "root_code")
    raw = links.select(F.col(node).cast("string").alias("code"), F.col(parent).cast("string").alias("parent"))
    up = cut(raw.groupBy("code").agg(F.min("parent").alias("parent")).join(caught, "code"))
    opened = up.select("code", F.when(F.col("code") != F.col("root_code"), F.col("parent")).alias("parent"))
    forest = cut(resolve_hierarchy(opened, with_paths=True))
    last = up.where("code = root_code").select("root_code", F.col("parent").alias("code"))
    rings = last.join(forest.select("code", F.col("path").alias("ring")), "code").select("root_code", "ring")
    below = forest.join(rings, "root_code").where(~F.array_contains("ring", F.col("code")))
    paths = below.select("code", F.expr("slice(ring, size(array_intersect(path, ring)) + 1, size(ring))").alias("rest"), F.col("path").alias("way"))
    joined = resolved.join(paths.select("code", F.concat("rest", "way").alias("way")), "code", "left")
    return joined.select("code", "root_code", "tree_depth", F.coalesce("path", "way").alias("path"))


def descendants(resolved: DataFrame) -> DataFrame:
    """(code, descendant, distance) from the ``path`` of :func:`resolve_hierarchy`; a node is not its own descendant.

    With :func:`below_cycles` in between, all members of a cycle have the nodes
    below it as descendants; members are no descendants, not even of each other.
    """
    steps = resolved.where("path is not null").select(F.col("code").alias("descendant"), (F.size("path") - 1).alias("length"), F.posexplode("path").alias("pos", "ancestor"))
    return steps.where("pos < length").select(F.col("ancestor").alias("code"), "descendant", (F.col("length") - F.col("pos")).alias("distance"))


def preorder_intervals(resolved: DataFrame) -> DataFrame:
    """(code, root_code, tree_depth, first, last) from the ``path`` of :func:`resolve_hierarchy`: all descendants in one row for each node.

    Nodes are counted in preorder, a node's descendants being those with ``first``
    from its own plus one up to its ``last``.  Paths in order are nodes in
    preorder; a mark that sorts behind all longer paths stands for the end of a
    node's descendants, and places are counted within ranges of paths and shifted
    by the counts of the ranges before.  Nodes on cycles and below them have no
    path and null places.
    """
    known = resolved.where("path is not null").select("code", "root_code", "tree_depth", "path")
    ends = known.select("code", F.concat("path", F.array(F.lit("\U0010ffff"))).alias("path"), F.lit(0).alias("real"))
    ranges = known.select("code", "path", F.lit(1).alias("real")).unionByName(ends).repartitionByRange("path").select("code", "path", "real", F.spark_partition_id().alias("range"))
    ranges = cut(ranges)
    before = ranges.groupBy("range").agg(F.sum("real").alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each range
    counted = ranges.withColumn("place", F.sum("real").over(Window.partitionBy("range").orderBy("path", "real", "code").rowsBetween(Window.unboundedPreceding, 0)))
    placed = counted.join(F.broadcast(before.select("range", "shift")), "range").select("code", "real", (F.col("place") + F.col("shift")).alias("place"))
    bounds = placed.groupBy("code").agg(F.max(F.when(F.col("real") == 1, F.col("place"))).alias("first"), F.max(F.when(F.col("real") == 0, F.col("place"))).alias("last"))
    return resolved.select("code", "root_code", "tree_depth").join(bounds, "code", "left")
