import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from legajo.functions.canonical import canonical_json
from legajo.functions.session import ensure_checkpoint_dir
from legajo.operators import transport
from legajo.operators.ranks import order_statistics, places
from legajo.plans import measures


def test_canonical_json():
    assert canonical_json('{"b": [1.0, " x  y "], "a": {"d": null, "c": 0.5}}') == canonical_json('{"a":{"c":0.5,"d":null},"b":[1,"x y"]}') == '{"a":{"c":0.5,"d":null},"b":[1,"x y"]}'
    assert canonical_json(None) is canonical_json("{") is canonical_json("") is canonical_json("[1e999]") is None


def _common(a, b):
    return 0 if not a or not b else 1 + _common(a[1:], b[1:]) if a[0] == b[0] else max(_common(a[1:], b), _common(a, b[1:]))


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(40):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(7))] for _ in range(2))
        assert measures.longest_common(a, b) == _common(a, b)


def test_late_interaction_over_blocks(spark):
    """Blocks of any size give the same scores, documents spread over blocks included."""
    rng = random.Random(3)
    vectors = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)], i % 3, i // 5) for i in range(40)], "vec_id bigint, embedding array<double>, query bigint, document bigint")
    queries, documents = vectors.where("vec_id % 4 = 0").select("vec_id", "embedding", "query"), vectors.select("embedding", "document")
    small, large = ({(r["query"], r.document): round(r.score, 3) for r in measures.max_similarity(queries, documents, block).collect()} for block in (7, 1000))
    assert small == large and len(large) == 24


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()
        getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError, match="shared|share"):
        ensure_checkpoint_dir(type("Session", (), {"sparkContext": Context()})())


def test_places(spark):
    """Places over all rows and within groups, one of them null and one with most rows; ties are broken by the order."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(40)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, g string, v int").repartition(5)
    for group in ((), ("g",)):
        got = {r.i: r.place for r in places(df, [F.col("v").desc(), F.col("i")], group).collect()}
        for name in {g for _, g, _ in rows} if group else {None}:
            own = sorted((r for r in rows if not group or r[1] == name), key=lambda r: (-r[2], r[0]))
            assert [got[r[0]] for r in own] == list(range(len(own)))
    got = {r.g: (r.n, r.mid, r.beyond) for r in order_statistics(df, "g", "v", {"mid": F.floor(F.col("n") / 2), "beyond": F.col("n")}).collect()}
    for name in ("a", "b", None):
        own = sorted(r[2] for r in rows if r[1] == name)
        assert got[name] == (len(own), own[len(own) // 2], None)
    assert places(df.where("false"), [F.col("v")]).count() == 0


def test_assignments_cost_least():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 3), (6, 6)):
        for costs in (rng.random((n, m)), rng.integers(0, 3, (n, m)).astype(float)):
            pairs = transport.assign(costs)
            small, large = min(n, m), max(n, m)
            view = costs if n <= m else costs.T
            best = min(sum(view[i, p[i]] for i in range(small)) for p in permutations(range(large), small))
            assert len(pairs) == small == len({i for i, _ in pairs}) == len({j for _, j in pairs}) and abs(sum(costs[i, j] for i, j in pairs) - best) < 1e-9
    costs = transport.jaccard_costs([{1, 2}, set()], [{2, 3}, {9}], (["a", "a"], ["a", "b"]))
    assert costs.tolist() == [[1 - 1 / 3, 10.0], [1.0, 10.0]]


def test_words_by_filter_or_join(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "agua y plan de agua"), (2, "plan"), (3, ""), (4, None), (5, "nada de eso")], "doc_id int, text string")
    asked = spark.createDataFrame([(0, "agua", 2), (0, "plan", 2), (7, "plan", 1)], "query int, word string, words int")
    few = {tuple(r) for r in measures.bm25(docs, asked).collect()}
    monkeypatch.setattr(measures, "FILTER_WORDS", 1)
    assert few == {tuple(r) for r in measures.bm25(docs, asked).collect()} and {(r[0], r[2], r[3]) for r in few} == {(0, 1, 2), (0, 2, 1), (7, 1, 1), (7, 2, 1)}
    assert measures.bm25(docs.where("false"), asked).count() == 0


def test_texts_under_many_ids_are_scored_once(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("plan de agua la mesa meta".split()) for _ in range(rng.randrange(6))) for _ in range(9)]
    rows = [(f"M{i:03}", rng.choice("PPPQ"), rng.choice([*texts, None])) for i in range(90)] + [("M900", None, texts[0]), ("M901", None, texts[0])]
    spark.createDataFrame(rows, "mapping_id string, question_id string, question_text string").write.parquet(f"{tmp_path}/question_mapping.parquet")
    ignored = {w.strip(" '") for w in measures._IGNORED.split(",")}

    def score(x, y):
        x, y = x.split(), y.split()
        share = lambda a, b: len(a & b) / len(a | b) if a | b else 0
        return 0.5 * share({*x} - ignored, {*y} - ignored) + 0.3 * share({*zip(x, x[1:])}, {*zip(y, y[1:])}) + 0.2 * (2 * _common(x, y) / (len(x) + len(y)) if x or y else 0)

    want = {(i, j): score(x, y) for i, p, x in rows for j, q, y in rows if i < j and p == q and p and x is not None and y is not None}
    for most in (measures.BROADCAST_PAIRS, 0):
        monkeypatch.setattr(measures, "BROADCAST_PAIRS", most)
        found = measures.t21_lexical_similarity(spark, str(tmp_path))
        got = [((r.id_a, r.id_b), r.similarity) for r in found.collect()]
        assert len(got) == len(want) and dict(got) == pytest.approx(want, abs=1e-6)
        assert bool(most) == ("ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString())
