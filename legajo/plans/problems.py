"""Queries of the general problems: nested records (5) and hierarchies (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from legajo.functions.session import cut, cut_table, table
from legajo.operators.hierarchy import below_cycles, descendants, parent_links, preorder_intervals, resolve_hierarchy
from legajo.operators.nested import artifact_nodes, child_table, dewey_nodes, dimension_table, record_table, schema_tables, section_children


def p5_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_tables(dewey_nodes(table(spark, sf_dir, "aggregation_artifact")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_children(_section_nodes(spark, sf_dir))


def _section_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifact_nodes(table(spark, sf_dir, "aggregation_artifact"))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_table(table(spark, sf_dir, "aggregation_artifact"))


def p5_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension_table(cut_table(_section_nodes(spark, sf_dir)))


def p5_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return child_table(cut_table(_section_nodes(spark, sf_dir)))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parent_links(table(spark, sf_dir, "pipeline_index"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_hierarchy(_links(spark, sf_dir)).select("code", "root_code", "tree_depth")


def p7_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_hierarchy(_links(spark, sf_dir), with_paths=True)


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = cut(_links(spark, sf_dir))
    return descendants(below_cycles(links, cut(resolve_hierarchy(links, with_paths=True))))


def p7_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preorder_intervals(cut(resolve_hierarchy(_links(spark, sf_dir), with_paths=True)))


QUERIES = {"p5_found": p5_found, "p5_nodes": p5_nodes, "p5_records": p5_records, "p5_dimensions": p5_dimensions, "p5_children": p5_children, "p7_found": p7_found, "p7_paths": p7_paths, "p7_descendants": p7_descendants, "p7_intervals": p7_intervals}

_KEY = r"upper(regexp_replace(regexp_replace({}, '^[\t-\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\t-\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g'), '^0+(.)', '\1'))"

ORACLES = {
    "p7_found": f"""
        WITH RECURSIVE c AS (SELECT code, unnest(dependencies) AS entry, unnest(range(len(dependencies))) AS pos FROM pipeline_index WHERE code IS NOT NULL),
        k AS (SELECT {_KEY.format("code")} AS key, min(code) AS target FROM pipeline_index WHERE code IS NOT NULL GROUP BY 1),
        p AS (SELECT code, arg_min(target, struct_pack(pos := pos, target := target)) AS parent FROM c JOIN k ON {_KEY.format("entry")} = key WHERE key <> '' GROUP BY code),
        w AS (SELECT DISTINCT code, code AS here, [code] AS path FROM pipeline_index WHERE code IS NOT NULL
              UNION ALL SELECT w.code, p.parent, list_append(path, p.parent) FROM w JOIN p ON w.here = p.code WHERE len(list_distinct(path)) = len(path))
        SELECT code, here AS root_code, CAST(len(path) - 1 AS INTEGER) AS tree_depth FROM w WHERE len(list_distinct(path)) = len(path) AND here NOT IN (SELECT code FROM p)
        UNION ALL SELECT code, list_min(path[list_position(path, here):]) AS root_code, -1 AS tree_depth FROM w WHERE len(list_distinct(path)) < len(path)""",
}
