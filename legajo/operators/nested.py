"""Deeply nested JSON records to flat related tables by Dewey labels.

Every JSON value gets an ordinal path identifier (its Dewey label, an array of
ordinals below the record).  The parent of a node is the label without its last
ordinal, so links come from truncation and need no generated keys; nodes that
share a schema path (keys kept, list positions replaced by ``*``) form a table.
Strings that themselves hold a JSON object or list are opened in place.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What Python hands over for each node: label and path as one string each, which the JVM takes apart.
_FLAT_SCHEMA = "record_id bigint, dewey string, path string, name string, listed boolean, kind string, value string, section string, level int, title string, below string"
_FLAT = pa.schema([("record_id", pa.int64()), *((n, pa.string()) for n in ("dewey", "path", "name")), ("listed", pa.bool_()), ("kind", pa.string()), ("value", pa.string()), ("section", pa.string()), ("level", pa.int32()), ("title", pa.string()), ("below", pa.string())])
_STEP = "\x1f"


def _refuse(token: str) -> None:
    raise ValueError(token)


def _parse(text: str | None) -> tuple[bool, object]:
    try:
        return True, json.loads(text, parse_constant=_refuse)  # type: ignore[arg-type]
    except (ValueError, TypeError, RecursionError):
        return False, None


def _nodes(record: int, root: object, within: frozenset[str], names: tuple[str, ...]) -> Iterator[tuple]:
    """All nodes below ``root``, or below the keys ``within``, without recursion, so that depth is bounded by memory only."""
    stack: list[tuple] = [(root, "", "", None, False, None, 0, None, 0, None)]
    while stack:
        value, dewey, path, name, listed, section, level, title, depth, under = stack.pop()
        if type(value) is str and value.lstrip()[:1] in ("{", "["):
            valid, inner = _parse(value)
            value = inner if valid else value
        if section is not None and depth == level + 1:  # an entry of the section: its key, or what a listed one calls itself
            title = name if not listed else next((value[k] for k in names if type(value.get(k)) is str), None) if isinstance(value, dict) else None
            under = section
        below = None if under is None else under + "/"
        if isinstance(value, dict):
            kind, scalar = "object", None
            for i, (k, v) in enumerate(value.items()):
                step = f"{path}{_STEP}{k.replace(_STEP, chr(0xFFFD))}"
                label = f"{dewey}.{i}" if dewey else str(i)
                stack.append((v, label, step, k, False, k, depth + 1, None, depth + 1, None) if k in within else (v, label, step, k, False, section, level, title, depth + 1, below and below + k))
        elif isinstance(value, list):
            kind, scalar = "array", None
            for i, v in enumerate(value):
                stack.append((v, f"{dewey}.{i}" if dewey else str(i), f"{path}{_STEP}*", None, True, section, level, title, depth + 1, below and below + "*"))
        elif value is None:
            kind, scalar = "null", None
        elif isinstance(value, str):
            kind, scalar = "string", value
        else:
            kind, scalar = "boolean" if isinstance(value, bool) else "number", json.dumps(value)
        if section is not None or not within:
            yield record, dewey, path, name, listed, kind, scalar, section, level, title, under


def dewey_nodes(records: DataFrame, record_id: str = "record_id", payload: str = "payload", batch: int = 20_000, within: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> DataFrame:
    """(record_id, dewey, path, name, listed, kind, value, section, level, title, below): one row for each JSON value of each record.

    With ``within`` only the values at and below these keys are given, wherever
    they stand: ``section`` is the last of the keys on the way, ``level`` its
    depth, ``title`` the key of its entry that holds the value, or for a listed
    entry the first string that it has under one of ``names``, ``below`` the
    section with the keys below its entry, list positions as ``*``.  Payloads that are null, empty or no valid JSON (``NaN`` and
    ``Infinity`` included) give no rows, nor do rows without ``record_id``.  Of
    equal keys in one object the last counts, as in common JSON readers; the unit
    separator in a key becomes the replacement character in ``path``.
    """
    keys = frozenset(within)

    def flat(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _FLAT, strict=True)], schema=_FLAT)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows: list[tuple] = []
            for record, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                valid, root = _parse(text)
                for node in _nodes(record, root, keys, names) if valid else ():
                    rows.append(node)
                    if len(rows) >= batch:
                        yield flat(rows)
                        rows = []
            if rows:
                yield flat(rows)

    source = records.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(payload).cast("string").alias("payload"))
    told = source.where("record_id is not null and payload is not null").mapInArrow(label, _FLAT_SCHEMA)
    dewey = F.when(F.col("dewey") == "", F.expr("cast(array() as array<int>)")).otherwise(F.split("dewey", "[.]").cast("array<int>"))
    path = F.expr(f"slice(split(path, '{_STEP}'), 2, size(split(path, '{_STEP}')))")
    return told.select("record_id", dewey.alias("dewey"), path.alias("path"), "name", "listed", "kind", "value", "section", "level", "title", "below")


def parent_label(dewey: Column) -> Column:
    """The label of the parent: the last ordinal cut off; null at the root."""
    return F.when(F.size(dewey) > 0, F.slice(dewey, 1, F.size(dewey) - 1))


def schema_tables(nodes: DataFrame) -> DataFrame:
    """(table_path, record_id, node_key, parent_key, ordinal, kind, value): nodes grouped by schema path, keys as dotted labels."""
    return nodes.select(
        F.array_join("path", "/").alias("table_path"), "record_id", _dotted(F.col("dewey")).alias("node_key"), _dotted(parent_label(F.col("dewey"))).alias("parent_key"), F.try_element_at("dewey", F.lit(-1)).alias("ordinal"), "kind", "value"
    )


#: section -> kind of its entries; container below an entry -> (kind of child, container below the child, kind of grandchild)
SECTIONS = {"coverage_metrics": "coverage", "dimensions_aggregation": "dimension", "dimension_results": "dimension"}
CONTAINERS = {
    "dimensions_aggregation": {"dnp_scores": ("dnp_score", None, None), "evidence_items": ("evidence_item", "rule_violations", "rule_violation")},
    "dimension_results": {"question_breakdown": ("question", "evidence_refs", "evidence_ref"), "correction_factors": ("correction", None, None)},
}
NAMES = ("dimension_name", "dimension_id")


def artifact_nodes(records: DataFrame, record_id: str = "record_id", payload: str = "payload") -> DataFrame:
    """The nodes of the sections above."""
    return dewey_nodes(records, record_id, payload, within=tuple(SECTIONS), names=NAMES)


def _patterns() -> Iterator[tuple[str, str, int | None, int | None, bool]]:
    """(schema path below the entry, kind, place of the parent, of the child, single) with places as steps below the section."""
    for section, kind in SECTIONS.items():
        yield section, kind, None, None, False
    for section, containers in CONTAINERS.items():
        for container, (kind, under, deep) in containers.items():
            here = f"{section}/{container}"
            yield here, kind, None, 0, True
            yield f"{here}/*", kind, None, 3, False
            if under:
                yield f"{here}/{under}", deep, 0, 0, True
                yield f"{here}/{under}/*", deep, 0, 4, False
                yield f"{here}/*/{under}", deep, 3, 0, True
                yield f"{here}/*/{under}/*", deep, 3, 5, False


def section_nodes(nodes: DataFrame) -> DataFrame:
    """(record_id, section, dimension, child_kind, parent_pos, child_pos, dewey, entry, kind, value) of the non-null children in :func:`artifact_nodes`.

    A node's schema path below its section's entry says what it is.  A list
    position is the child's place; a single value stands for a list of one.
    ``entry`` is the label of the section's entry that holds the child.
    """
    patterns = list(_patterns())
    inside = nodes.where("kind <> 'null'").where(F.col("below").isin([p[0] for p in patterns]))
    place = lambda i: F.lit(-1) if i is None else F.lit(0) if i == 0 else F.try_element_at("dewey", F.col("level") + i)
    child = F.lit(None).cast("struct<child_kind string, parent_pos int, child_pos int>")
    for path, kind, parent, own, single in patterns:
        hit = (F.col("below") == path) & (F.col("kind") != "array") if single else F.col("below") == path
        child = F.when(hit, F.struct(F.lit(kind).alias("child_kind"), place(parent).cast("int").alias("parent_pos"), place(own).cast("int").alias("child_pos"))).otherwise(child)
    known = inside.withColumn("child", child).where("child is not null")
    return known.select("record_id", "section", F.col("title").alias("dimension"), "child.*", "dewey", F.slice("dewey", 1, F.col("level") + 1).alias("entry"), "kind", "value")


def section_children(nodes: DataFrame) -> DataFrame:
    """(record_id, section, dimension, child_kind, parent_pos, child_pos) of :func:`section_nodes`, each once."""
    return section_nodes(nodes).select("record_id", "section", "dimension", "child_kind", "parent_pos", "child_pos").distinct()


def _dotted(label: Column) -> Column:
    return F.array_join(F.transform(label, lambda v: v.cast("string")), ".")


def _number(text: Column) -> Column:
    """A number written with a decimal comma or a percent sign as well."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, "%", "")), ",", ".").try_cast("double")


def record_table(records: DataFrame, record_id: str = "record_id", payload: str = "payload") -> DataFrame:
    """(record_id, valid, ...): one row for each record with an id, its own columns kept, whether its payload is valid JSON."""

    def check(texts: pa.Array) -> pa.Array:
        return pa.array([t is not None and _parse(t)[0] for t in texts.to_pylist()], pa.bool_())

    kept = [c for c in records.columns if c not in (record_id, payload, "valid")]
    return records.where(F.col(record_id).isNotNull()).select(F.col(record_id).cast("bigint").alias("record_id"), F.arrow_udf(check, "boolean")(F.col(payload).cast("string")).alias("valid"), *kept)


def dimension_table(nodes: DataFrame) -> DataFrame:
    """(record_id, dimension_key, section, dimension, number, status, raw_score, adjusted_score) of the entries of all sections.

    ``dimension_key`` is the entry's dotted label, the ``parent_key`` of its
    children; ``number`` the value of a coverage entry; ``status`` may be stored
    as a string or as an object with a value.
    """
    own = section_nodes(nodes).where("child_kind in ('coverage', 'dimension')").select("record_id", _dotted(F.col("dewey")).alias("dimension_key"), "section", "dimension", _number(F.col("value")).alias("number"))
    facts = nodes.where("below is not null and value is not null").withColumn("fact", F.expr("substring(below, length(section) + 2)")).where("fact in ('status', 'status/value', 'scores/raw_score', 'scores/adjusted_score', 'raw_score', 'adjusted_score')")
    facts = facts.groupBy(F.col("record_id").alias("f_record"), _dotted(F.slice("dewey", 1, F.col("level") + 1)).alias("f_key")).agg(
        F.max(F.when(F.col("fact").startswith("status"), F.col("value"))).alias("status"), F.max(F.when(F.col("fact").endswith("raw_score"), _number(F.col("value")))).alias("raw_score"), F.max(F.when(F.col("fact").endswith("adjusted_score"), _number(F.col("value")))).alias("adjusted_score")
    )
    return own.join(facts, (F.col("record_id") == F.col("f_record")) & (F.col("dimension_key") == F.col("f_key")), "left").drop("f_record", "f_key")


def child_table(nodes: DataFrame) -> DataFrame:
    """(record_id, child_key, parent_key, dimension_key, section, dimension, child_kind, place, name, number, valid) of the children of the entries.

    ``parent_key`` is the entry for scores, items, questions and corrections, the
    item or question for what hangs below these.  ``name`` is the value itself or
    the id of an object, ``number`` its score, ``valid`` its mark.
    """
    own = section_nodes(nodes).where("child_kind not in ('coverage', 'dimension')")
    listed = F.col("parent_pos") >= 0
    # the item stands in the container's list, or is the container itself
    item = F.expr("slice(dewey, 1, size(entry) + 1)")
    up = F.when(listed, F.expr("if(stepped, slice(dewey, 1, size(entry) + 2), slice(dewey, 1, size(entry) + 1))")).otherwise(F.col("entry"))
    items = nodes.where("kind = 'array'").select(F.col("record_id").alias("a_record"), F.col("dewey").alias("a_label"))
    own = own.withColumn("container", item).join(items, (F.col("record_id") == F.col("a_record")) & (F.col("container") == F.col("a_label")), "left").withColumn("stepped", F.col("a_label").isNotNull())
    own = own.select("record_id", _dotted(F.col("dewey")).alias("child_key"), _dotted(up).alias("parent_key"), _dotted(F.col("entry")).alias("dimension_key"), "section", "dimension", "child_kind", F.col("child_pos").alias("place"), "value")
    facts = nodes.where("value is not null and name in ('evidence_id', 'question_id', 'factor', 'dnp_compliance_score', 'raw_score', 'amount', 'is_valid')")
    facts = facts.groupBy(F.col("record_id").alias("f_record"), _dotted(parent_label(F.col("dewey"))).alias("f_key")).agg(
        F.max(F.when(F.col("name").isin("evidence_id", "question_id", "factor"), F.col("value"))).alias("f_name"), F.max(F.when(F.col("name").isin("dnp_compliance_score", "raw_score", "amount"), _number(F.col("value")))).alias("f_number"), F.max(F.when(F.col("name") == "is_valid", F.col("value").try_cast("boolean"))).alias("valid")
    )
    joined = own.join(facts, (F.col("record_id") == F.col("f_record")) & (F.col("child_key") == F.col("f_key")), "left")
    return joined.select("record_id", "child_key", "parent_key", "dimension_key", "section", "dimension", "child_kind", "place", F.coalesce("value", "f_name").alias("name"), F.coalesce(_number(F.col("value")), "f_number").alias("number"), "valid")
