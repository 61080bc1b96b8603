import random

from legajo.operators.graphs import closeness, cyclic_nodes, reachable, strong_components, topological_layers, weighted_effects
from legajo.operators.hierarchy import dependency_edges
from legajo.plans import frames


def test_layers_match_a_plain_kahn_pass(spark):
    rng = random.Random(2)
    edges = {(a, b) for _ in range(70) if (a := rng.randrange(40)) < (b := rng.randrange(40))} | {(50, 51), (51, 50), (51, 52), (3, 3), (3, 50)}
    nodes, left, want = {*range(45), 50, 51, 52}, {*range(45), 50, 51, 52}, {}
    while fresh := {n for n in left if not any(b == n and a != b and a in left for a, b in edges)}:
        layer = max(want.values(), default=-1) + 1
        want |= dict.fromkeys(fresh, layer)
        left -= fresh
    want |= dict.fromkeys(left, -1)
    frames_ = (spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(list(edges), "a int, b int"))
    for one_task in (10_000, 0):  # in one task, and by rounds of joins
        assert {r.node: r.layer for r in topological_layers(*frames_, one_task=one_task).collect()} == want


def test_every_dependency_is_an_edge(spark):
    rows = [("007A", []), ("2B", [" 7a ", "3c", None]), ("3C", ["none", "2b"]), ("4D", None)]
    components = spark.createDataFrame(rows, "code string, dependencies array<string>")
    assert {tuple(r) for r in dependency_edges(components).collect()} == {("007A", "2B"), ("3C", "2B"), ("2B", "3C")}


def test_components_are_mutually_reachable(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "a int, b int")
    assert {tuple(r) for r in strong_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)}


def test_simple_paths_reach_ten_edges(spark):
    paths = frames.QUERIES["g1_simple_paths"](spark, "/root/testdata/sf0.001").collect()
    assert max(r.path.count(">") for r in paths) == 10


def test_components_of_random_graphs(spark):
    rng = random.Random(7)
    for n, m in ((12, 18), (15, 40), (9, 6)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {v: {v} for e in edges for v in e}
        for _ in range(n):
            for a, b in edges:
                for v, own in reach.items():
                    if a in own:
                        own.add(b)
        want = {(v, min(u for u in reach if u in reach[v] and v in reach[u])) for v in reach}
        df = spark.createDataFrame(list(edges), "a int, b int")
        assert {tuple(r) for r in strong_components(df).collect()} == want
        cyclic = {v for v, c in want if sum(d == c for _, d in want) > 1} | {a for a, b in edges if a == b}
        assert {r.node for r in cyclic_nodes(df).collect()} == cyclic
        start = min(reach)
        onward = set().union(*(reach[b] for a, b in edges if a == start))
        assert {r.node for r in reachable(df, spark.createDataFrame([(start,)], "node int")).collect()} == onward


def test_effects_and_closeness(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (1, 3, 0.2), (3, 1, 1.0)], "a int, b int, confidence double")
    got = {(r.a, r.b): (round(r.strongest, 6), round(r.decayed, 6)) for r in weighted_effects(edges).collect()}
    assert got[1, 3] == (0.25, round(0.2 + 0.9 * 0.25, 6)) and got[3, 2] == (0.5, round(0.9 * 0.5, 6))
    near = {r.node: r.closeness for r in closeness(edges.unionByName(spark.createDataFrame([(8, 9, 1.0)], "a int, b int, confidence double"))).collect()}
    assert near[1] == 0.5 and near[8] == 0.25
