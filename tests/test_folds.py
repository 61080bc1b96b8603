import random

import pytest

from legajo.functions.expressions import column_of
from legajo.operators import folds
from legajo.operators.folds import coverage_choice, greedy_coverage
from legajo.operators.vectors import cell_search, maximum_mean_discrepancy, top_similar


def test_rate_limit_counts_emitted_only(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), float(rng.randint(0, 9000)), i) for i in range(300)]
    got = {(r.rule, r.seconds, r.n): r.emitted for r in folds.rate_limited(spark.createDataFrame(rows, "rule string, seconds double, n int"), "rule", "seconds", 3).collect()}
    for rule in "ab":
        recent = []
        for key in sorted((k for k in got if k[0] == rule), key=lambda k: k[1]):
            recent = [t for t in recent if t > key[1] - 3600]
            expected = len(recent) < 3
            if expected:
                recent.append(key[1])
        assert sum(v for k, v in got.items() if k[0] == rule) <= 3 * 4


def test_chain_and_breaker(spark):
    calls = spark.createDataFrame([("s", i, float(t), f) for i, (t, f) in enumerate([(0, True), (1, True), (2, False), (100, True), (101, False), (200, False), (201, True)])], "service string, i int, seconds double, failed boolean")
    states = [r.state for r in folds.circuit_states(calls, "service", ["i"], "seconds", "failed", 2, 60.0).orderBy("i").collect()]
    assert states == ["closed", "open", "open", "open", "open", "closed", "closed"]
    hashes = [r.event_hash for r in folds.chained_hashes(calls, "service", ["i"], ["i", "failed"]).orderBy("i").collect()]
    assert len(set(hashes)) == 7 and folds.chained_hashes(calls.where("false"), "service", ["i"], ["i"]).count() == 0


def test_submodular_choice_is_greedy(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), rng.choice("abcdefg"), round(rng.random(), 3), i) for i in range(80)]
    got = {}
    for r in folds.submodular_choice(spark.createDataFrame(rows, "k string, g string, s double, i int"), "k", "g", "s", "i", 4).orderBy("place").collect():
        got.setdefault(r.k, []).append(r.i)
    for key in "xy":
        left, taken, groups = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[3])), [], set()
        while left and len(taken) < 4:
            best = max(left, key=lambda r: ((r[1] not in groups) + r[2], -left.index(r)))
            left.remove(best)
            groups.add(best[1])
            taken.append(best[3])
        assert got[key] == taken


def test_expressions(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 0.0)], "a int, b double")
    assert [r[0] for r in df.select(column_of("max(a, b) + 2 * -a if False else 0".split(" if")[0], {"a", "b"})).collect()] == [3.0, -2.0]
    assert [r[0] for r in df.select(column_of("0 < b <= 5 and not a == 2", {"a", "b"})).collect()] == [True, False]
    for bad in ("__import__('os')", "c + 1", "a.b", "[a]", "a if b else 1", "pow(a, 2)", "a +"):
        with pytest.raises(ValueError):
            column_of(bad, {"a", "b"})


def test_cell_search_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = vectors.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in top_similar(vectors, queries).collect()}
    found = {(r.query_id, r.vec_id) for r in cell_search(vectors, queries).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_discrepancy_tells_shifted_groups(spark):
    rng = random.Random(1)
    same = spark.createDataFrame([(i % 2 == 0, rng.gauss(0, 1)) for i in range(2000)], "g boolean, v double")
    moved = spark.createDataFrame([(i % 2 == 0, rng.gauss(2 * (i % 2), 1)) for i in range(2000)], "g boolean, v double")
    near, far = (maximum_mean_discrepancy(d, "g", "v").collect()[0].mmd2 for d in (same, moved))
    assert near < 0.02 < 0.2 < far


def test_coverage_choice_is_greedy(spark):
    """Lazily weighed gains choose what weighing all tasks in every round does."""
    rng = random.Random(8)

    def plain(tasks, budget):
        chosen, covered = [], set()
        while True:
            open_ = [t for t in tasks if t[0] not in chosen and t[2] <= budget and all(n in chosen for n in t[3] or ())]
            needed = {n for t in tasks for n in t[3] or ()}
            open_ = [t for t in open_ if set(t[1]) - covered or t[0] in needed]
            if not open_:
                return chosen
            best = min(open_, key=lambda t: (-len(set(t[1]) - covered) / t[2], t[0]))
            chosen.append(best[0])
            covered |= set(best[1])
            budget -= best[2]

    for _ in range(60):
        tasks = [(i, rng.sample("abcdefgh", rng.randint(0, 4)), rng.choice([1.0, 2.0, 3.0]), rng.choice([None, None, [rng.randrange(i)] if i else None, [99]])) for i in range(8)]
        assert greedy_coverage(tasks, 7.0) == plain(tasks, 7.0)
    rows = [("k", 1, ["a"], 1.0, None), ("k", 1, ["a"], 2.0, None), ("k", 2, ["a", "b"], None, [1]), ("k", None, ["z"], 1.0, None), (None, 3, None, 1.0, None), ("j", 4, ["x"], 50.0, None)]
    df = spark.createDataFrame(rows, "key string, task int, covers array<string>, cost double, needs array<int>")
    assert sorted((r.key, r.task, r.place) for r in coverage_choice(df, "key", 10.0).collect()) == [("k", 1, 1), ("k", 2, 2)]
    assert coverage_choice(df.where("false"), "key", 10.0).count() == 0
