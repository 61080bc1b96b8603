"""Graph operators by iterated joins: bounded simple paths, closure, rank, Horn rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.functions.session import cut


def simple_paths(edges: DataFrame, cutoff: int = 10) -> DataFrame:
    """(path) of every simple path of 1 to ``cutoff`` edges over (a, b); null ends and repeated edges are ignored."""
    known = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    frontier = known.select(F.array("a", "b").alias("path"))
    found = frontier
    step = known.select(F.col("a").alias("s_a"), F.col("b").alias("s_b"))
    for _ in range(cutoff - 1):
        frontier = cut(frontier.join(step, F.element_at("path", -1) == F.col("s_a")).where(~F.array_contains("path", F.col("s_b"))).select(F.concat("path", F.array("s_b")).alias("path")))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def closure(edges: DataFrame) -> DataFrame:
    """(a, b) for every pair joined by a path, by repeated squaring of new pairs only."""
    known = cut(edges.select("a", "b").where("a is not null and b is not null").distinct())
    fresh = known
    while not fresh.isEmpty():
        left = known.select("a", F.col("b").alias("m")).join(fresh.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        right = fresh.select("a", F.col("b").alias("m")).join(known.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        fresh = cut(left.unionByName(right).distinct().join(known, ["a", "b"], "left_anti"))
        known = cut(known.unionByName(fresh))
    return known


def page_rank(edges: DataFrame, rounds: int = 15, damping: float = 0.85) -> DataFrame:
    """(node, rank) summing to 1; rank of nodes without successors is spread evenly."""
    known = edges.select("a", "b").where("a is not null and b is not null").distinct()
    nodes = cut(known.select(F.col("a").alias("node")).union(known.select("b")).distinct().join(known.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("out")), "node", "left"))
    n = max(1, nodes.count())
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        given = known.join(ranks.where("out > 0"), F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        loose = ranks.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        mixed = nodes.join(given, "node", "left").crossJoin(F.broadcast(loose))  # one row
        ranks = cut(mixed.select("node", "out", ((1 - damping) / n + damping * (F.coalesce("given", F.lit(0.0)) + F.col("loose") / n)).alias("rank")))
    return ranks.select("node", "rank")


def horn_closure(facts: DataFrame, clauses: list[tuple[set[str], str]]) -> DataFrame:
    """(entity, fact): the least fixpoint of ``facts`` under clauses (body, head), a bounded list."""
    known = cut(facts.select("entity", "fact").where("entity is not null and fact is not null").distinct())
    while True:
        held = known.groupBy("entity").agg(F.collect_set("fact").alias("held"))
        derived = [held.where(F.lit(not body) | (F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(body))))) == len(body))).select("entity", F.lit(head).alias("fact")) for body, head in clauses]
        if not derived:
            return known
        fresh = derived[0]
        for other in derived[1:]:
            fresh = fresh.unionByName(other)
        fresh = cut(fresh.distinct().join(known, ["entity", "fact"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = cut(known.unionByName(fresh))


def shortest_paths(edges: DataFrame, cutoff: int | None = 10) -> DataFrame:
    """(a, b, dist): least number of edges of the undirected graph between different nodes, up to ``cutoff`` (None: any)."""
    known = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    known = cut(known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    step = known.select(F.col("a").alias("m"), F.col("b").alias("to"))
    found = frontier = cut(known.withColumn("dist", F.lit(1)))
    dist = 1
    while cutoff is None or dist < cutoff:
        dist += 1
        onward = frontier.join(step, F.col("b") == F.col("m")).where("a <> to").select("a", F.col("to").alias("b")).distinct()
        frontier = cut(onward.join(found, ["a", "b"], "left_anti").withColumn("dist", F.lit(dist)))
        if frontier.isEmpty():
            break
        found = cut(found.unionByName(frontier))
    return found


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges left when those are dropped again and again that start where none ends or end where none starts."""
    size = edges.count()
    while size:
        edges = cut(edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        before, size = size, edges.count()
        if size == before:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches each node."""
    colours = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("colour", F.col("node")))
    while True:
        sent = edges.join(colours.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("sent"))
        joined = cut(colours.join(sent, "node", "left").select("node", F.least("colour", "sent").alias("colour"), (F.col("sent") < F.col("colour")).alias("changed")))
        colours = joined.select("node", "colour")
        if joined.where("changed").isEmpty():
            return colours


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach each other share a component, named after its smallest node.

    By colouring, never by pairs: what cannot lie on a cycle is trimmed off,
    each node takes the smallest node that reaches it as its colour, and what
    reaches a colour's own node within the colour is its component; these leave
    and the rest goes on.
    """
    known = edges.select("a", "b").where("a is not null and b is not null").distinct()
    nodes = known.select(F.col("a").alias("node")).union(known.select("b")).distinct()
    live = _trimmed(cut(known.where("a <> b")))
    found = nodes.select("node", F.col("node").alias("component")).limit(0)
    while not live.isEmpty():
        colours = _coloured(live)
        inner = live.join(colours.select(F.col("node").alias("a"), F.col("colour").alias("ca")), "a").join(colours.select(F.col("node").alias("b"), F.col("colour").alias("cb")), "b").where("ca = cb").select("a", "b")
        inner = cut(inner)
        members = frontier = cut(colours.where("node = colour").select("node", F.col("colour").alias("component")))
        while not frontier.isEmpty():
            back = inner.join(frontier.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component").distinct()
            frontier = cut(back.join(members, "node", "left_anti"))
            members = cut(members.unionByName(frontier))
        found = found.unionByName(members)
        gone = members.select("node")
        live = _trimmed(cut(live.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node) of every node that lies on a cycle; empty exactly if the graph is acyclic."""
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    groups = cut(strong_components(edges))
    several = groups.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return groups.join(several, "component", "left_semi").select("node").unionByName(loops).distinct()


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node) of every node that a path of one or more edges leads to from a node of ``start`` (node)."""
    known = cut(edges.select("a", "b").where("a is not null and b is not null").distinct())
    frontier = cut(known.join(start.select(F.col("node").alias("a")).distinct(), "a", "left_semi").select(F.col("b").alias("node")).distinct())
    found = frontier
    while not frontier.isEmpty():
        onward = known.join(frontier.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        frontier = cut(onward.join(found, "node", "left_anti"))
        found = cut(found.unionByName(frontier))
    return found


def weighted_effects(edges: DataFrame, cutoff: int = 6, decay: float = 0.9) -> DataFrame:
    """(a, b, strongest, decayed) over the simple paths of up to ``cutoff`` edges (a, b, confidence): the largest product of confidences, and the sum of products that each further edge decays."""
    known = cut(edges.where("a is not null and b is not null and a <> b").groupBy("a", "b").agg(F.max("confidence").alias("confidence")))
    step = known.select(F.col("a").alias("m"), F.col("b").alias("to"), F.col("confidence").alias("c"))
    frontier = known.select(F.array("a", "b").alias("path"), F.col("confidence").alias("product"))
    found = frontier.withColumn("part", F.col("product"))
    for length in range(2, cutoff + 1):
        onward = frontier.join(step, F.element_at("path", -1) == F.col("m")).where(~F.array_contains("path", F.col("to")))
        frontier = cut(onward.select(F.concat("path", F.array("to")).alias("path"), (F.col("product") * F.col("c")).alias("product")))
        found = found.unionByName(frontier.withColumn("part", F.col("product") * decay ** (length - 1)))
    return found.groupBy(F.element_at("path", 1).alias("a"), F.element_at("path", -1).alias("b")).agg(F.max("product").alias("strongest"), F.sum("part").alias("decayed"))


def closeness(edges: DataFrame) -> DataFrame:
    """(node, closeness) of the undirected graph: reached nodes over the sum of distances, times the share of nodes reached."""
    paths = shortest_paths(edges, cutoff=None)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).where("node is not null").distinct()
    n = nodes.count()
    near = paths.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("reached"), F.sum("dist").alias("total"))
    score = F.col("reached") / F.col("total") * F.col("reached") / F.lit(max(1, n - 1))
    return nodes.join(near, "node", "left").select("node", F.coalesce(score, F.lit(0.0)).alias("closeness"))


#: Edges of a graph whose layers one task works out; a larger graph takes a round of joins for each layer.
ONE_TASK_EDGES = 500_000


def _kahn(frame):  # noqa: ANN001, ANN202
    """Longest distances from the sources of a graph of one task."""
    import pandas as pd

    onward: dict = {}
    waiting: dict = {}
    for a, b in zip(frame["a"], frame["b"]):
        onward.setdefault(a, []).append(b)
        waiting[b] = waiting.get(b, 0) + 1
    layer = {a: 0 for a in onward if a not in waiting}
    ready = list(layer)
    while ready:
        a = ready.pop()
        for b in onward.get(a, ()):
            layer[b] = max(layer.get(b, 0), layer[a] + 1)
            waiting[b] -= 1
            if not waiting[b]:
                ready.append(b)
    stuck = {b for b, n in waiting.items() if n}
    nodes = sorted(set(onward) | set(waiting))
    return pd.DataFrame({"node": nodes, "layer": [-1 if v in stuck else layer[v] for v in nodes]})


def topological_layers(nodes: DataFrame, edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, layer) with ``layer`` the most edges (a before b) that lead to the node; -1 on a cycle and after one.

    Edges of a node to itself are ignored.  A graph of at most ``one_task`` edges
    is worked out by one task; beyond, a round drops the edges whose start has no
    edge left before it, and there are as many rounds as layers.
    """
    left = cut(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    size, number = left.count(), 0
    if size <= one_task:
        kind = left.schema["a"].dataType.simpleString()
        layers = left.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(_kahn, f"node {kind}, layer int")
        return nodes.select("node").distinct().join(layers, "node", "left").select("node", F.coalesce("layer", F.lit(0)).alias("layer"))
    waits = left.select(F.col("b").alias("node"), F.lit(1).alias("layer")).limit(0)
    while size:
        number += 1
        waits = waits.unionByName(left.select(F.col("b").alias("node"), F.lit(number).alias("layer")).distinct())
        left = cut(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi"))
        before, size = size, left.count()
        if size == before:
            break
    stuck = left.select(F.col("b").alias("node")).distinct().withColumn("stuck", F.lit(True))
    layers = waits.groupBy("node").agg(F.max("layer").alias("layer"))
    found = nodes.select("node").distinct().join(layers, "node", "left").join(stuck, "node", "left")
    return found.select("node", F.when(F.col("stuck"), -1).otherwise(F.coalesce("layer", F.lit(0))).alias("layer"))
