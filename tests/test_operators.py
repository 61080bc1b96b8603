import math
import random

import duckdb
import numpy as np
import pytest

from legajo.functions.session import table
from legajo.operators import chunking, graphs, lineage, transport
from legajo.operators.vectors import top_similar
from legajo.plans import registry


def test_spelling_for_both_engines():
    sql = "SELECT SHA(concat('a', b)), round(x * 0.5, 2), LEN(WORDS(text)), regexp_replace(t, '1.5', '', 'g') FROM {documents}"
    spark_sql, duck_sql = registry.spell(sql, 0), registry.spell(sql, 1)
    assert "sha2(concat('a', b), 256)" in spark_sql and "sha256(concat('a', b))" in duck_sql
    assert "0.5e0" in spark_sql and "'1.5', '')" in spark_sql and "'1.5', '', 'g')" in duck_sql
    assert registry.twin(sql).endswith("FROM documents")


def test_greedy_packing_matches_a_plain_loop(spark):
    rng = random.Random(4)
    texts = [" ".join("Voy a " + "x " * rng.randint(1, 9) + "ya." for _ in range(rng.randint(0, 12))) for _ in range(30)] + [None, "", "sin punto"]

    def brute(text):
        import re

        out, n = [], 0
        for unit in [u for u in re.split(r"(?<=[.!?])\s+", text or "") if u.strip()]:
            size = len(unit.split())
            if out and n and n + size <= 15:
                out[-1] += " " + unit
                n += size
            else:
                out.append(unit)
                n = size
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in chunking.sentence_chunks(df, "k", "t", 15).orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append(r.chunk)
    assert got == {i: b for i, t in enumerate(texts) if (b := brute(t))}


def test_overlap(spark):
    chunks = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "d e"), (2, 0, "z")], "k int, pos int, chunk string")
    got = {(r.k, r.pos): r.chunk for r in chunking.with_overlap(chunks, "k", 2, 0.1).collect()}
    assert got == {(1, 0): "a b c", (1, 1): "b c d e", (2, 0): "z"}


@pytest.mark.parametrize("block", [7, 1000])
def test_vector_search_is_exact(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(60, None), (61, []), (62, [0.0] * 4), (63, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.place): r.vec_id for r in top_similar(df, df.where("vec_id % 20 = 0"), 3, block=block).collect()}
    m = np.array([r[1] for r in rows[:60]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        scores = np.round(m @ m[q], 6)
        scores[q] = -1
        assert [got[q, p] for p in (1, 2, 3)] == [int(i) for i in sorted(range(60), key=lambda i: (-scores[i], i))[:3]]


def test_paths_closure_and_rank(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (1, 2), (None, 5), (4, 4)], "a int, b int")
    paths = {tuple(r.path) for r in graphs.simple_paths(edges, 3).collect()}
    assert paths == {(1, 2), (2, 3), (3, 1), (3, 4), (1, 2, 3), (2, 3, 1), (2, 3, 4), (3, 1, 2), (1, 2, 3, 4)}
    assert {tuple(r) for r in graphs.closure(edges).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)} | {(4, 4)}
    ranks = {r.node: r["rank"] for r in graphs.page_rank(edges).collect()}
    assert math.isclose(sum(ranks.values()), 1.0, abs_tol=1e-9) and max(ranks, key=ranks.get) == 4


def test_horn_fixpoint(spark):
    facts = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", None)], "entity string, fact string")
    got = {tuple(r) for r in graphs.horn_closure(facts, [({"a", "b"}, "c"), ({"c"}, "d")]).collect()}
    assert got == {("x", "a"), ("x", "b"), ("x", "c"), ("x", "d"), ("y", "a")}


def test_merkle_proofs_verify(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = spark.createDataFrame([(i, h(str(i))) for i in range(5)], "place bigint, hash string")
    levels = lineage.merkle_levels(leaves)
    root = levels[-1].collect()[0].hash
    proofs = {}
    for r in lineage.inclusion_proofs(levels).collect():
        proofs.setdefault(r.leaf, []).append(r)
    for i in range(5):
        digest = h(str(i))
        for step in sorted(proofs[i], key=lambda s: s.depth):
            digest = h(step.sibling + digest if step.on_left else digest + step.sibling)
        assert digest == root


def test_chain_check(spark):
    events = spark.createDataFrame([("s", 1, None, "a"), ("s", 2, "a", "b"), ("s", 3, "x", "c"), ("t", 1, "q", "d")], "stream string, n int, previous string, hash string")
    assert [r.n for r in lineage.broken_links(events, "stream", ["n"], "previous", "hash").collect()] == [3]


def test_transport():
    rng = np.random.default_rng(0)
    cost, p, q = rng.random((4, 5)), np.full(4, 0.25), np.full(5, 0.2)
    plan = transport.sinkhorn(cost, p, q)
    assert np.allclose(plan.sum(1), p, atol=1e-6) and np.allclose(plan.sum(0), q, atol=1e-6)
    points = rng.random((5, 2))
    c = np.linalg.norm(points[:, None] - points[None], axis=2)
    plan, _ = transport.gromov_wasserstein(c, c, q, q, 0.002)
    assert np.allclose(plan.sum(0), q, atol=1e-3)
    assert transport.fused_cost(np.zeros((2, 2)), cost[:2, :2]).max() <= 0.5 + 1e-9


def test_queries_match_their_twins(spark):
    """A few of each module at the smallest scale; the driver compares all of them."""
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    known, twins = entry.queries(), entry.oracle_sql()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in registry.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in ("r1_bm25", "t8_densities", "a4_point_scores", "stat_p2_conformal_quantile", "m21_sessions", "g1_simple_paths", "m21_stream_sessions"):
        ours, theirs = known[name](spark, sf).toArrow(), con.execute(twins[name]).to_arrow_table()
        columns = sorted(ours.column_names)
        assert columns == sorted(theirs.column_names)
        assert sorted(map(repr, zip(*[ours[c].to_pylist() for c in columns]))) == sorted(map(repr, zip(*[theirs[c].to_pylist() for c in columns]))), name


def test_only_the_subpackage_needs_itself():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "legajo"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"legajo\.llm|from \.llm", path.read_text()), path


def test_table_reader(spark):
    assert table(spark, "/root/testdata/sf0.001", "region").count() == 5
