import random

from legajo.llm.mixing import mixed, reached_shares

MIX = "mix_id string, source string, target_share double, max_repeats int"


def _sizes(spark, seed=2):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaab") if i > 5 else "tiny", rng.choice([10, 20, 300])) for i in range(600)]
    return spark.createDataFrame([*rows, (9999, None, 5)], "doc_id bigint, source string, n_tokens int")


def _filled(owned, asked, total, cap):
    """Tokens of each source by filling the mix step by step."""
    given, left, open_ = {}, total, {k: v for k, v in asked.items() if owned.get(k)}
    while open_:
        unit = left / sum(open_.values())
        short = [k for k, v in open_.items() if cap.get(k) is not None and cap[k] * owned[k] < unit * v]
        if not short:
            return given | {k: unit * v for k, v in open_.items()}
        for k in short:
            given[k] = cap[k] * owned[k]
            left -= given[k]
            del open_[k]
    return given


def test_shares_and_caps(spark):
    sizes = _sizes(spark)
    mix = spark.createDataFrame([("m", "a", 3.0, 1), ("m", "b", 2.0, None), ("m", "b", 2.0, None), ("m", "tiny", 0.2, 4), ("m", "none", 1.0, 2), ("m", None, 1.0, 2), (None, "a", 1.0, 2), ("n", "none", 1.0, None)], MIX)
    chosen = mixed(sizes, mix)
    report = {(r.mix_id, r.source): r for r in reached_shares(chosen, sizes, mix).collect()}
    owned = {r.source: r.t for r in sizes.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "t").collect()}
    total = sum(owned[k] for k in ("a", "b", "tiny"))
    for source, tokens in _filled(owned, {"a": 3.0, "b": 2.0, "tiny": 0.2}, total, {"a": 1, "tiny": 4}).items():
        assert abs(report["m", source].tokens - tokens) <= 300
    assert abs(sum(report["m", k].tokens for k in ("a", "b", "tiny")) - total) <= 900
    assert report["m", "tiny"].shortfall == -(-0.2 / 5.2 * total // 1) - 4 * owned["tiny"] and report["m", "a"].shortfall == 0
    assert report["m", "none"].tokens == 0 and report["n", "none"].reached_share == 0.0
    caps = {("m", "a"): 1, ("m", "tiny"): 4}
    assert all(r.copies <= caps.get((r.mix_id, r.source), 99) for r in chosen.collect())
    assert {tuple(r) for r in chosen.collect()} == {tuple(r) for r in mixed(sizes, mix).collect()}


def test_exact_shares(spark):
    sizes = _sizes(spark)
    mix = spark.createDataFrame([("m", "a", 3.0, 1), ("m", "b", 2.0, None), ("m", "tiny", 0.2, 4)], MIX)
    report = {r.source: r for r in reached_shares(mixed(sizes, mix, exact_shares=True), sizes, mix, exact_shares=True).collect()}
    assert all(abs(r.reached_share - r.target_share) < 0.03 and r.shortfall == 0 for r in report.values()) and report["tiny"].most_repeats == 4


def test_given_total_and_empty(spark):
    sizes = _sizes(spark)
    mix = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "tiny", 0.5, 2)], MIX)
    report = {r.source: r for r in reached_shares(mixed(sizes, mix, total_tokens=10_000), sizes, mix, total_tokens=10_000).collect()}
    tiny = report["tiny"].tokens
    assert abs(report["a"].tokens - (10_000 - tiny)) < 600 and report["tiny"].most_repeats == 2 and report["tiny"].shortfall == 5000 - tiny
    assert mixed(sizes.where("false"), mix).count() == 0 and mixed(sizes, mix.where("false")).count() == 0


def test_every_cap_binds(spark):
    sizes = _sizes(spark)
    mix = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "tiny", 0.5, 1)], MIX)
    report = {r.source: r for r in reached_shares(mixed(sizes, mix, total_tokens=10**9), sizes, mix, total_tokens=10**9).collect()}
    assert all(r.copies == r.documents and r.most_repeats == 1 for r in report.values())
