"""Named queries written once in the dialect that Spark SQL and DuckDB share.

``{table}`` stands for a table.  The few functions that differ go by neutral
names (``WORDS``, ``UNNEST``, ``LEN`` ...) that are spelt out for each engine, so
a query and its SQL twin cannot drift apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings processed_chunk chunk_config question_mapping keyword_lexicon pipeline_index aggregation_artifact mix_target container_spec".split()
# Neutral name -> (Spark, DuckDB); \1, \2 are the arguments.
_CALLS = {
    r"WORDS\((\w+(?:\.\w+)?)\)": (r"regexp_extract_all(lower(\1), '([\\\\p{L}\\\\p{N}_]+)', 1)", r"regexp_extract_all(lower(\1), '[\\p{L}\\p{N}_]+')"),
    r"FINDALL\((\w+(?:\.\w+)?), '([^']*)'\)": (r"regexp_extract_all(\1, '\2', 0)", r"regexp_extract_all(\1, '\2')"),
    r"SHA\(": (r"sha256x(", r"sha256("),
    r"UNNEST\(": ("explode(", "unnest("),
    r"LEN\(": ("size(", "len("),
    r"INTERSECT_OF\(": ("array_intersect(", "list_intersect("),
    r"DISTINCT_OF\(": ("array_distinct(", "list_distinct("),
    r"JOINED\(": ("array_join(", "array_to_string("),
    r"COLLECT\(": ("collect_list(", "list("),
    r"MEDIAN_AT\(([^,]+), ([\d.e]+)\)": (r"percentile(\1, \2)", r"quantile_cont(\1, \2)"),
    r"DAYS\(([^,]+), ([^)]+)\)": (r"datediff(\2, \1)", r"date_diff('day', CAST(\1 AS DATE), CAST(\2 AS DATE))"),
    r"UNIX\((\w+(?:\.\w+)?)\)": (r"(unix_micros(CAST(\1 AS TIMESTAMP)) / 1000000.0)", r"(epoch_us(\1) / 1000000.0)"),
    r"SORTED\(": ("array_sort(", "list_sort("),
    r", 'g'\)": (")", ", 'g')"),
    r"SPLIT\(": ("split(", "string_split_regex("),
}


def spell(sql: str, engine: int) -> str:
    """``sql`` for Spark (0) or DuckDB (1), tables left as placeholders."""
    # plain decimals become doubles, and ties of rounding are broken alike
    sql = "".join(part if i % 2 else re.sub(r"(?<![\w.])\d+\.\d+(?![\w.])", r"\g<0>e0", part).replace("round(", "round(1e-9 + ") for i, part in enumerate(re.split("('[^']*')", sql)))
    for pattern, forms in _CALLS.items():
        sql = re.sub(pattern, forms[engine], sql)
    if engine == 0:  # sha2 takes the length of the digest as well
        while (at := sql.find("sha256x(")) >= 0:
            depth, end = 1, at + 8
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            sql = f"{sql[:at]}sha2({sql[at + 8 : end - 1]}, 256){sql[end:]}"
    return sql


def _tables(sql: str, form: Callable[[str], str]) -> str:
    for name in TABLES:
        sql = sql.replace("{" + name + "}", form(name))
    return sql


def spark_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    spelt = spell(sql, 0)
    return lambda spark, sf_dir: spark.sql(_tables(spelt, lambda name: f"parquet.`{sf_dir}/{name}.parquet`"))


def twin(sql: str) -> str:
    return _tables(spell(sql, 1), lambda name: name)


def build(shared: dict[str, str]) -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    return {k: spark_query(v) for k, v in shared.items()}, {k: twin(v) for k, v in shared.items()}
