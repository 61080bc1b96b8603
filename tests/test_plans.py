from legajo.plans import extended, scoring, statistics


def _tables(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_coverage_matrix_counts_every_answer(spark, tmp_path):
    orders = [(1, 1, "1-URGENT"), (3, 1, "5-LOW"), (4, 1, "2-HIGH"), (6, 2, "3-MEDIUM"), (8, 2, "5-LOW"), (12, 2, "5-LOW")]
    sf = _tables(
        spark,
        tmp_path,
        orders=(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string"),
        customer=([(1, 0), (2, 5)], "c_custkey bigint, c_nationkey int"),
        nation=([(0, 0), (5, 1)], "n_nationkey int, n_regionkey int"),
    )
    got = {r.point: (r.de1, r.de2, r.de3, r.de4) for r in scoring.QUERIES["a39_coverage_matrix"](spark, sf).collect()}
    assert got == {0: (0.5, 0.5, 0.0, 0.5), 5: (1.0, 0.0, 0.5, 0.0)}


def test_pattern_matches_find_keywords_of_several_words(spark, tmp_path):
    lines = ["¿Hay agua potable?", "agua muy potable", "Agua\npotable para el Agua", "desagua potable", "costo-beneficio del agua potables", "el costo beneficio", None]
    words = ["agua", "Agua potable", "costo-beneficio", "c++ (x)"]
    sf = _tables(
        spark,
        tmp_path,
        question_mapping=([(str(i), t) for i, t in enumerate(lines)], "mapping_id string, question_text string"),
        keyword_lexicon=([(f"k{i}", w) for i, w in enumerate(words)], "kw_id string, keyword string"),
    )
    got = sorted((r.mapping_id, r.kw_id, r.score) for r in extended.QUERIES["r25_pattern_matches"](spark, sf).collect())
    assert got == [("0", "k0", 1.0), ("0", "k1", 0.95), ("1", "k0", 1.0), ("2", "k0", 1.0), ("2", "k1", 0.95), ("4", "k0", 1.0), ("4", "k2", 1.0)]


def test_fuzzy_sections_match_brute_force(spark):
    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/keyword_lexicon.parquet").collect()
    want = {(a.kw_id, b.kw_id, d) for a in rows for b in rows if a.kw_id < b.kw_id and (d := levenshtein(a.keyword.lower(), b.keyword.lower())) <= 3}
    assert {tuple(r) for r in extended.QUERIES["t14_fuzzy_sections"](spark, sf).collect()} == want
    assert any(a[0] != b[0] for a, b in ((x.keyword.lower(), y.keyword.lower()) for x in rows for y in rows if (x.kw_id, y.kw_id) in {w[:2] for w in want}))


def test_worked_scores(spark, tmp_path):
    """The multipliers, point score and strength that are worked out by hand."""
    # completeness is o_orderkey % 11 / 10, quality o_custkey % 11 / 10, the dimension DE-(o_orderkey % 4 + 1)
    orders = [(20, 10, "1-URGENT"), (17, 7, "3-MEDIUM")]
    sf = _tables(
        spark,
        tmp_path,
        orders=(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string"),
        customer=([(10, 0), (7, 0)], "c_custkey bigint, c_nationkey int"),
        nation=([(0, 0)], "n_nationkey int, n_regionkey int"),
        lineitem=([(1, 1, 50, 0.09)], "l_orderkey bigint, l_suppkey bigint, l_partkey bigint, l_discount double"),
    )
    got = {r.question_id: (r.multiplier, r.score) for r in scoring.QUERIES["a2_evidence_multiplier"](spark, sf).collect()}
    assert got == {20: (1.151, 1.151), 17: (0.941, 0.4705)}
    assert {r.document: r.score for r in scoring.QUERIES["a4_point_scores"](spark, sf).collect()} == {10: 1.151, 7: 0.4705}
    assert [round(r.strength, 6) for r in statistics.QUERIES["g13_strength"](spark, sf).collect()] == [0.95]
