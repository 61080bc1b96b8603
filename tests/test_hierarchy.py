import random

from legajo.operators.hierarchy import below_cycles, descendants, parent_links, preorder_intervals, resolve_hierarchy


def _brute(parents):
    out = {}
    for node in parents:
        seen, at = [], node
        while at is not None and at not in seen:
            seen.append(at)
            at = parents.get(at)
        out[node] = (seen[-1], len(seen) - 1, seen[::-1]) if at is None else (min(seen[seen.index(at) :]), -1, None)
    return out


def _check(spark, parents):
    links = spark.createDataFrame([(n, p, "x") for n, p in parents.items()], "code string, parent string, node string")
    got = {r.code: (r.root_code, r.tree_depth, r.path) for r in resolve_hierarchy(links, with_paths=True).collect()}
    assert got == _brute({n: p if p in parents else None for n, p in parents.items()})


def test_random_forests_with_cycles(spark):
    rng = random.Random(5)
    names = [f"n{i:03d}" for i in range(120)]
    _check(spark, {n: rng.choice([None, "missing", *names]) for n in names})


def test_long_chain_ending_in_a_cycle(spark):
    _check(spark, {f"c{i:03d}": f"c{i + 1:03d}" if i < 89 else "c080" for i in range(90)} | {"r": None, "s": "r", "self": "self", "below": "self"})


def test_star(spark):
    _check(spark, {"hub": None} | {f"leaf{i}": "hub" for i in range(200)})


def test_loose_names_and_republished_rows(spark):
    rows = [("007A", []), ("2B", [" 7a ", None, "07A"]), ("2B", [" 7a ", None, "07A"]), ("3C", ["none", ""]), ("4D", None), ("5E", ["00002b "]), (None, ["2B"])]
    components = spark.createDataFrame([(c, d, 1) for c, d in rows], "code string, dependencies array<string>, key int")
    assert {tuple(r) for r in parent_links(components).collect()} == {("007A", None), ("2B", "007A"), ("3C", None), ("4D", None), ("5E", "2B")}


def test_empty_table(spark):
    links = spark.createDataFrame([], "code string, parent string")
    assert resolve_hierarchy(links).count() == 0


def test_descendants(spark):
    links = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "code string, parent string")
    found = {tuple(r) for r in descendants(resolve_hierarchy(links, with_paths=True)).collect()}
    assert found == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_descendants_below_cycles(spark):
    rng = random.Random(3)
    names = [f"n{i:02d}" for i in range(60)]
    parents = {n: rng.choice([None, "missing", *names]) for n in names} | {"x": "y", "y": "z", "z": "x", "d": "y", "e": "d", "f": "e", "self": "self", "under": "self"}
    links = spark.createDataFrame(list(parents.items()), "code string, parent string").cache()

    def up(node):
        out, at = [], parents[node]
        while at in parents and at not in out:
            out.append(at)
            at = parents[at]
        return out

    want = {(a, n, i) for n in parents if n not in up(n) for i, a in enumerate(up(n), 1)}
    assert {("d", "f", 2), ("y", "f", 3), ("z", "f", 4), ("x", "f", 5), ("self", "under", 1)} <= want
    found = descendants(below_cycles(links, resolve_hierarchy(links, with_paths=True)))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_intervals_hold_the_descendants(spark):
    """Exactly the descendants of a node have their first place within its interval."""
    rng = random.Random(9)
    parents = {f"n{i}": f"n{rng.randrange(i)}" if i and rng.random() > 0.1 else None for i in range(80)} | {"c1": "c2", "c2": "c1", "c3": "c1"}
    links = spark.createDataFrame(list(parents.items()), "code string, parent string")
    resolved = resolve_hierarchy(links, with_paths=True)
    rows = {r.code: r for r in preorder_intervals(resolved).collect()}
    want = {(r.code, r.descendant) for r in descendants(resolved).collect()}
    inside = {(a.code, b.code) for a in rows.values() for b in rows.values() if a.first is not None and b.first is not None and a.first < b.first <= a.last}
    assert inside == want and rows["c3"].first is None and len(rows) == len(parents)
    assert sorted(r.first for r in rows.values() if r.first) == list(range(1, 81)) and preorder_intervals(resolved.where("false")).count() == 0
