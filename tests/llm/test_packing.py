import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from legajo.llm.packing import bucket_bounds, pack, patterns, usage
from legajo.llm.tokens import ranked, token_sizes


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=15))
def test_patterns_hold_everything(histogram):
    held = defaultdict(int)
    for times, content, _ in patterns(histogram, 40, 4):
        assert sum(length * copies for length, copies in content) <= 40 and times > 0
        for length, copies in content:
            held[length] += copies * times
    assert dict(held) == histogram


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 5), min_size=1, max_size=6), st.integers(1, 4))
def test_bounds_minimise_padding(histogram, buckets):
    from itertools import combinations

    lengths = sorted(histogram)

    def padding(bounds):
        return sum(n * (min(b for b in bounds if b >= v) - v) for v, n in histogram.items())

    best = min(padding((*c, lengths[-1])) for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k))
    bounds = bucket_bounds(histogram, buckets)
    assert len(bounds) <= buckets and padding(bounds) == best


def test_the_bounds_decide(monkeypatch):
    """Other bounds than the dynamic programme's give another packing, with and without filling."""
    rng = random.Random(4)
    histogram = {length: rng.randint(1, 9) for length in rng.sample(range(1, 200), 80)}
    for fill in (True, False):
        best = patterns(histogram, 200, 6, fill)
        monkeypatch.setattr("legajo.llm.packing.bucket_bounds", lambda lengths, buckets: [max(lengths)])
        single = patterns(histogram, 200, 6, fill)
        monkeypatch.undo()
        assert [c for _, c, _ in best] != [c for _, c, _ in single]
    own = patterns(histogram, 200, 6, False)
    bounds = bucket_bounds(histogram, 6)
    assert all(len({next(b for b in bounds if b >= length) for length, _ in content}) == 1 for _, content, _ in own)
    assert sum(t for t, _, _ in patterns(histogram, 200, 6)) < sum(t for t, _, _ in own)


def test_containers(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 3, 3, 7, 19, 64, 65, 200])) for i in range(400)]
    specs = spark.createDataFrame([(1, 64), (2, 100), (3, None), (None, 5), (4, 0)], "spec_id int, capacity_tokens int")
    packed = pack(spark, spark.createDataFrame(sizes, "doc_id bigint, n_tokens int"), specs)
    rows = packed.collect()
    for spec, capacity in ((1, 64), (2, 100)):
        own = [r for r in rows if r.spec_id == spec]
        filled, parts = defaultdict(int), defaultdict(list)
        for r in own:
            filled[r.container_id] += r.n_tokens
            parts[r.doc_id].append((r.start_token, r.n_tokens))
        assert max(filled.values()) <= capacity
        for doc, size in sizes:
            covered = sorted(parts[doc])
            assert sum(n for _, n in covered) == size and (len(covered) == 1 or size > capacity)
    shares = {r.spec_id: r.unused_share for r in usage(packed, specs).collect()}
    assert set(shares) == {1, 2} and max(shares.values()) < 0.15  # few small items are left for the gaps
    assert pack(spark, spark.createDataFrame([], "doc_id bigint, n_tokens int"), specs).count() == 0


def test_ranks_within_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr("legajo.llm.tokens.ROWS_PER_TASK", 10)
    items = spark.createDataFrame([(i, i % 7 and 1) for i in range(100)], "doc_id bigint, k int")
    got = defaultdict(list)
    for r in ranked(items, ["k"], ["doc_id"]).collect():
        got[r.k].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
    few = {r.doc_id: r["rank"] for r in ranked(items, ["k"], ["doc_id"]).collect()}
    monkeypatch.setattr("legajo.llm.tokens.ROWS_PER_TASK", 1000)
    assert few == {r.doc_id: r["rank"] for r in ranked(items, ["k"], ["doc_id"]).collect()}


def test_sizes(spark):
    docs = spark.createDataFrame([(1, "hola mundo", "a"), (1, "hola", "b"), (2, "", None), (3, None, "a"), (None, "x", "a"), (4, "x " * 50_000, "a")], "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.source, r.n_tokens) for r in token_sizes(docs, keep=("source",)).collect()}
    assert set(got) == {1, 2, 4} and got[2] == (None, 0) and got[1][0] == "a" and got[4][1] >= 50_000
