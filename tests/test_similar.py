import random

import pytest

from legajo.operators import similar
from legajo.operators.similar import copy_classes, removed_copies, similar_pairs


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_match_a_plain_pass_from_the_longest_on(spark):
    rng = random.Random(7)
    bases = [[rng.choice("abcdefghijklmnopqrst") * 3 + str(rng.randint(0, 9)) for _ in range(rng.choice([3, 12, 60, 90]))] for _ in range(12)]
    texts = []
    for _ in range(150):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = "changed" + str(rng.randint(0, 3))
        texts.append(rng.choice([" ", " ", "\n"]).join(words[rng.choice([0, 0, 1, 4]) :]))
    texts = [t or "z" for t in texts]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, "...")], "k bigint, t string")

    classes = {}
    for i, t in enumerate(texts):
        classes.setdefault(tuple(t.split()), []).append(i)
    name = {i: max(ids, key=lambda j: (len(texts[j]), -j)) for ids in classes.values() for i in ids}
    sets = {c: _shingles(texts[c]) for c in set(name.values())}
    pairs = {(a, b): _jaccard(sets[a], sets[b]) for a in sets for b in sets if a < b and _jaccard(sets[a], sets[b]) >= 0.8}
    kept, keeper = [], {}
    for c in sorted(sets, key=lambda c: (-len(texts[c]), c)):
        keeper[c] = next((u for u in kept if tuple(sorted((u, c))) in pairs), None)
        if keeper[c] is None:
            kept.append(c)
    want = {(i, c, c if keeper[c] is None else keeper[c]) for i, c in name.items() if keeper[c] is not None or i != c}

    found = copy_classes(docs, "k", "t").cache()
    near = similar_pairs(found.where("doc_id = class_id").selectExpr("class_id AS id", "words")).cache()
    assert {(r.id_a, r.id_b): r.jaccard for r in near.collect()} == pairs and pairs
    assert {(r.doc_id, r.class_id, r.keeper) for r in removed_copies(found, near).collect()} == want


@pytest.fixture
def plans(spark, monkeypatch):
    """Of what is materialised, the plans, where Spark takes every table for small enough to broadcast."""
    seen = []
    for name in ("cut", "cut_table"):
        if plain := getattr(similar, name, None):
            monkeypatch.setattr(similar, name, lambda df, plain=plain: seen.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8g")
    yield seen
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


_TEXTS = [(i, " ".join(f"w{(i // 2) * 1000 + j}" for j in range(30 + i % 2))) for i in range(40)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _broadcast(plans):
    return [line for plan in plans for line in plan.split("\n") if "BroadcastHashJoin" in line and "Inner" in line]


def test_no_texts_are_broadcast(spark, plans, tmp_path):
    """Whatever sizes Spark expects: compressed texts are far larger once they are in memory."""
    spark.createDataFrame(_TEXTS, "k bigint, t string").write.parquet(f"{tmp_path}/docs")
    classes = copy_classes(spark.read.parquet(f"{tmp_path}/docs"), "k", "t")
    near = similar_pairs(classes.where("doc_id = class_id").selectExpr("class_id AS id", "words"))
    assert near.count() == 20
    assert len(plans) > 2 and not _broadcast([*plans, _plan(classes), _plan(near)])


def test_a_pass_from_the_longest_on_broadcasts_no_list_of_classes(spark, plans, tmp_path):
    spark.createDataFrame([*_TEXTS, (100, _TEXTS[0][1])], "k bigint, t string").write.parquet(f"{tmp_path}/docs")
    found = similar.cut_table(copy_classes(spark.read.parquet(f"{tmp_path}/docs"), "k", "t"))
    pairs = similar.cut_table(similar_pairs(found.where("doc_id = class_id").selectExpr("class_id AS id", "words")))
    del plans[:]
    left_out = removed_copies(found, pairs)
    assert not _broadcast(plans[:1]) and not [line for line in _plan(left_out).split("\n") if "BroadcastHashJoin" in line and "LeftOuter" in line]
    assert {(r.doc_id, r.keeper) for r in left_out.collect()} == {(i, i + 1) for i in range(0, 40, 2)} | {(100, 1)}
