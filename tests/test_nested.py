import json

from legajo.operators.nested import artifact_nodes, child_table, dewey_nodes, dimension_table, parent_label, record_table, schema_tables, section_children


def _rows(df):
    return {tuple(r) for r in df.collect()}


def _artifacts(spark, payloads):
    return spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "record_id bigint, payload string, path string")


def test_labels_link_children_to_parents(spark):
    nodes = dewey_nodes(_artifacts(spark, ['{"a": [{"b": 1}, {"b": null}], "c": "[2, 3]"}']))
    got = {tuple(r.dewey): r for r in nodes.collect()}
    assert set(got) == {(), (0,), (0, 0), (0, 0, 0), (0, 1), (0, 1, 0), (1,), (1, 0), (1, 1)}
    assert got[(1,)].kind == "array" and got[(1, 1)].value == "3" and got[(0, 1, 0)].kind == "null"
    assert got[(0, 1, 0)].path == ["a", "*", "b"]
    parents = {tuple(r.dewey): None if r.p is None else tuple(r.p) for r in nodes.select("dewey", parent_label(nodes.dewey).alias("p")).collect()}
    assert all((p is None) == (d == ()) and (p is None or p == d[:-1]) for d, p in parents.items())
    tables = schema_tables(nodes).collect()
    keys = {r.node_key for r in tables}
    assert all(r.parent_key is None or r.parent_key in keys for r in tables)


def test_broken_null_and_empty_payloads_give_nothing(spark):
    bad = ["", "{", None, "NaN", '{"coverage_metrics": {"x": NaN}}', "{'a': 1}"]
    assert dewey_nodes(_artifacts(spark, bad)).count() == 0
    assert dewey_nodes(_artifacts(spark, []).where("false")).count() == 0


def test_deep_nesting_and_extra_columns(spark):
    deep = "[" * 500 + "1" + "]" * 500
    assert dewey_nodes(_artifacts(spark, [deep])).count() == 501


def test_children_of_all_shapes(spark):
    entry = {"dnp_scores": [0.1, None, "0,3"], "evidence_items": {"rule_violations": "late"}}
    payloads = [
        json.dumps({"data": {"coverage_metrics": {"x": 1.0, "y": None}, "dimensions_aggregation": [dict(entry, dimension_name="n"), None]}}),
        json.dumps({"dimension_results": json.dumps({"DE-1": {"dimension_id": "DE-9", "question_breakdown": [None, {"evidence_refs": ["a", None, "b"]}], "correction_factors": {"factor": 1}}})}),
    ]
    got = _rows(section_children(artifact_nodes(_artifacts(spark, payloads))))
    assert got == {
        (0, "coverage_metrics", "x", "coverage", -1, -1),
        (0, "dimensions_aggregation", "n", "dimension", -1, -1),
        (0, "dimensions_aggregation", "n", "dnp_score", -1, 0),
        (0, "dimensions_aggregation", "n", "dnp_score", -1, 2),
        (0, "dimensions_aggregation", "n", "evidence_item", -1, 0),
        (0, "dimensions_aggregation", "n", "rule_violation", 0, 0),
        (1, "dimension_results", "DE-1", "dimension", -1, -1),
        (1, "dimension_results", "DE-1", "question", -1, 1),
        (1, "dimension_results", "DE-1", "evidence_ref", 1, 0),
        (1, "dimension_results", "DE-1", "evidence_ref", 1, 2),
        (1, "dimension_results", "DE-1", "correction", -1, 0),
    }


def test_only_the_sections(spark):
    """What stands outside the sections is left out, with the same labels for the rest."""
    payloads = [json.dumps({"a": {"coverage_metrics": {"x": 1}, "b": [1, {"dimensions_aggregation": json.dumps([{"dimension_id": "q", "dnp_scores": 1}])}]}, "c": 3})]
    records = _artifacts(spark, payloads)
    assert _rows(section_children(artifact_nodes(records))) == {(0, "coverage_metrics", "x", "coverage", -1, -1), (0, "dimensions_aggregation", "q", "dimension", -1, -1), (0, "dimensions_aggregation", "q", "dnp_score", -1, 0)}
    every = {(r.record_id, tuple(r.dewey), r.kind, r.value) for r in dewey_nodes(records).collect()}
    some = {(r.record_id, tuple(r.dewey), r.kind, r.value) for r in artifact_nodes(records).collect()}
    assert some < every and len(every - some) == 6 and artifact_nodes(records).where("section is null").count() == 0


def test_related_tables(spark):
    entry = {"dimension_name": "n", "status": {"value": "done"}, "scores": {"raw_score": 0.5}, "evidence_items": [{"evidence_id": "e1", "is_valid": True, "dnp_compliance_score": "0,5", "rule_violations": ["late", None, "old"]}, {"evidence_id": "e2", "rule_violations": "one"}]}
    payloads = [json.dumps({"coverage_metrics": {"x": "26.4%"}, "dimensions_aggregation": [entry], "dimension_results": {"D": {"question_breakdown": {"question_id": "q", "evidence_refs": ["a"]}}}}), "{"]
    records = _artifacts(spark, payloads)
    nodes = artifact_nodes(records)
    assert {(r.record_id, r.valid, r.path) for r in record_table(records).collect()} == {(0, True, "x"), (1, False, "x")}
    dimensions = {r.dimension: r for r in dimension_table(nodes).collect()}
    assert dimensions["x"].number == 26.4 and dimensions["n"].status == "done" and dimensions["n"].raw_score == 0.5 and set(dimensions) == {"x", "n", "D"}
    children = child_table(nodes).collect()
    by_key = {(r.record_id, r.child_key): r for r in children}
    entries = {r.dimension_key for r in dimensions.values()}
    assert all(r.dimension_key in entries and (r.parent_key in entries or (r.record_id, r.parent_key) in by_key) for r in children)
    late = next(r for r in children if r.name == "late")
    assert by_key[0, late.parent_key].name == "e1" and by_key[0, late.parent_key].number == 0.5 and by_key[0, late.parent_key].valid is True
    assert by_key[0, next(r for r in children if r.name == "one").parent_key].name == "e2" and by_key[0, next(r for r in children if r.name == "a").parent_key].name == "q"
    assert len(children) == 7 and len(by_key) == 7
    assert child_table(nodes.where("false")).count() == 0 and dimension_table(nodes.where("false")).count() == 0
