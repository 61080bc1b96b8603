"""Queries of the operators written with DataFrames, and their SQL twins where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions.session import cut, cut_table, ensure_checkpoint_dir, table
from legajo.functions.expressions import column_of
from legajo.operators import chunking, folds, graphs, lineage, transport
from legajo.operators.learning import adaptive_scores
from legajo.operators.nested import dewey_nodes
from legajo.operators.similar import copy_classes, removed_copies, similar_pairs
from legajo.operators.vectors import cell_search, coherence, maximum_mean_discrepancy, top_similar
from legajo.sources import files
from legajo.streaming import metrics


def r5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_similar(vectors, vectors.where("vec_id % 20 = 0")).select("query_id", "vec_id", "score", F.col("place").cast("bigint").alias("place"))


def _chunks(form):  # noqa: ANN001, ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return form(table(spark, sf_dir, "documents"), "doc_id", "text")

    return query


def c5_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.with_overlap(chunking.sentence_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 64), "doc_id")


def _nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("a"))
    return nation.select("a", F.explode(F.array((F.col("a") * 2) % 25, (F.col("a") * 3 + 1) % 25)).alias("b"))


def g1_simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.simple_paths(_nation_edges(spark, sf_dir), 10).select(F.array_join("path", ">").alias("path"))


def g3_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.strong_components(_nation_edges(spark, sf_dir))


def g3_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.closure(_nation_edges(spark, sf_dir))


def g4_page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000_000).alias("b"))
    return graphs.page_rank(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), 10)


def h11_horn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    facts = orders.select(F.col("o_custkey").alias("entity"), F.concat(F.lit("s"), "o_orderstatus").alias("fact"))
    return graphs.horn_closure(facts, [({"sF", "sO"}, "active"), ({"active", "sP"}, "mixed"), ({"mixed"}, "review")])


def h7_merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    first = F.broadcast(customer.agg(F.min("c_custkey").alias("first")))  # one row
    leaves = customer.crossJoin(first).select((F.col("c_custkey") - F.col("first")).alias("place"), F.sha2("c_name", 256).alias("hash"))
    return lineage.merkle_levels(leaves)[-1].select("hash")


def s13_jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(table(spark, sf_dir, "question_mapping").select("mapping_id", "question_text", "dimension", "decalogo_point"), path, ["dimension"])
    return spark.read.json(path).groupBy("dimension").agg(F.count("*").alias("n"), F.sum(F.length("question_text")).alias("chars"))


def r6_cell_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return cell_search(vectors, vectors.where("vec_id % 20 = 0"))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("ts is not null")
    return events.select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))


def h6_chained_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.chained_hashes(_timed(spark, sf_dir), "user_id", ["seconds", "event_id"], ["event_id", "event_type"]).select("event_id", "event_hash")


def m8_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.rate_limited(_timed(spark, sf_dir), "event_type", "seconds", 5).select("event_id", "emitted")


def m17_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _timed(spark, sf_dir).withColumn("failed", F.coalesce(F.col("value") > 15, F.lit(False)))
    return folds.circuit_states(calls, "user_id", ["seconds", "event_id"], "seconds", "failed", 2, 3600.0).select("event_id", "state")


def e10_submodular(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_discount", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("item"))
    return folds.submodular_choice(items, "l_orderkey", "l_returnflag", "l_discount", "item", 3)


def h22_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = column_of("0 < o_totalprice / 1000 <= 150 and not (o_custkey % 2 == 0)", {"o_totalprice", "o_custkey"})
    return table(spark, sf_dir, "orders").select("o_orderkey", rule.alias("holds"))


def p12_mmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("old"), "o_totalprice")
    return maximum_mean_discrepancy(orders, "old", "o_totalprice")


def a47_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"), F.avg("l_discount").alias("discount"), F.sum("l_extendedprice").alias("price"))
    return adaptive_scores(rows, "l_orderkey", ["quantity", "n", "discount"], "price")


def o1_region_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gromov-Wasserstein plans between the nations of each region and those of the first, by distance of key: a region has few nations."""
    import numpy as np

    nation = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").where("n_nationkey is not null and n_regionkey is not null")

    def align(pdf):  # noqa: ANN001, ANN202
        keys = pdf["n_nationkey"].sort_values().to_numpy(dtype=float)
        n = len(keys)
        own = np.abs(keys[:, None] - keys[None]) / 25
        base = np.abs(np.arange(n)[:, None] - np.arange(n)[None]) / max(1, n)
        plan, _ = transport.gromov_wasserstein(own, base, np.full(n, 1 / n), np.full(n, 1 / n), 0.01)
        i, j = np.nonzero(plan > 1e-6)
        return pdf.__class__({"region": int(pdf["n_regionkey"].iloc[0]), "nation": keys[i].astype(int), "place": j, "mass": np.round(plan[i, j], 6)})

    return nation.groupBy("n_regionkey").applyInPandas(align, "region int, nation int, place int, mass double")


def s12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/artifacts-{uuid.uuid4().hex}"
    files.write_jsonl(table(spark, sf_dir, "keyword_lexicon"), path)
    found = files.file_manifest(spark, path).where(F.col("path").endswith(".json"))
    return files.verify_manifest(found, found).groupBy("state").agg(F.count("*").alias("n"))


def s19_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/levels-{uuid.uuid4().hex}"
    mapping = table(spark, sf_dir, "question_mapping")
    rows = mapping.select(F.lit("question").alias("level"), F.col("mapping_id").alias("id")).unionByName(mapping.select(F.lit("dimension").alias("level"), F.col("dimension").alias("id")).where("id is not null").distinct())
    files.write_jsonl(rows, path, ["level"])
    return spark.read.json(path).groupBy("level").agg(F.count("*").alias("n"))


def o9_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.shortest_paths(_nation_edges(spark, sf_dir), None)


def g8_cyclic_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.cyclic_nodes(_nation_edges(spark, sf_dir))


def p24_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coherence(table(spark, sf_dir, "embeddings")).select("label", "n", F.round(F.lit(1e-9) + F.col("coherence"), 5).alias("coherence"))


def e14_nested_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = dewey_nodes(table(spark, sf_dir, "aggregation_artifact"))
    return nodes.where("name = 'evidence_id' and kind = 'string'").groupBy("value").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("records"))


def _class_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    classes = cut_table(copy_classes(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return classes, similar_pairs(classes.where("doc_id = class_id").select(F.col("class_id").alias("id"), "words"))


def r30_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_pairs(spark, sf_dir)[1].select("id_a", "id_b", F.round(F.lit(1e-9) + F.col("jaccard"), 6).alias("jaccard"))


def r30_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, pairs = _class_pairs(spark, sf_dir)
    return removed_copies(classes, pairs).withColumn("jaccard", F.round(F.lit(1e-9) + F.col("jaccard"), 6))


QUERIES = {
    "r30_similar_pairs": r30_similar_pairs,
    "r30_near_duplicates": r30_near_duplicates,
    "o9_shortest_paths": o9_shortest_paths,
    "g8_cyclic_nodes": g8_cyclic_nodes,
    "stat_p24_coherence": p24_coherence,
    "e14_nested_evidence": e14_nested_evidence,
    "r6_cell_search": r6_cell_search,
    "h6_chained_log": h6_chained_log,
    "m8_rate_limit": m8_rate_limit,
    "m17_circuit": m17_circuit,
    "e10_submodular": e10_submodular,
    "h22_expression": h22_expression,
    "stat_p12_mmd": p12_mmd,
    "a47_adaptive": a47_adaptive,
    "o1_region_alignment": o1_region_alignment,
    "s12_manifest": s12_manifest,
    "s19_levels": s19_levels,
    "r5_vector_search": r5_vector_search,
    "c1_sentence_chunks": _chunks(chunking.sentence_chunks),
    "c2_paragraph_chunks": _chunks(chunking.paragraph_chunks),
    "c4_hybrid_chunks": _chunks(chunking.hybrid_chunks),
    "c5_overlap": c5_overlap,
    "c8_evidence_chunks": _chunks(chunking.evidence_chunks),
    "g1_simple_paths": g1_simple_paths,
    "g3_closure": g3_closure,
    "g3_components": g3_components,
    "g4_page_rank": g4_page_rank,
    "h11_horn_labels": h11_horn_labels,
    "h7_merkle_root": h7_merkle_root,
    "s13_jsonl_round_trip": s13_jsonl_round_trip,
    "m10_stream_hours": metrics.streamed(metrics.hour_counts),
    "m5_stream_sliding": metrics.streamed(metrics.sliding_counts),
    "m21_stream_sessions": metrics.streamed(metrics.sessions),
}

_EDGES = "e AS (SELECT DISTINCT a, b FROM (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(unnest([(n_nationkey * 2) % 25, (n_nationkey * 3 + 1) % 25]) AS BIGINT) AS b FROM nation))"
ORACLES = {
    "r30_similar_pairs": r"""WITH w AS (SELECT doc_id, length(text) AS chars, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words FROM documents), k AS (SELECT arg_max(doc_id, struct_pack(chars := chars, doc := -doc_id)) AS id, any_value(words) AS words FROM w WHERE len(words) > 0 GROUP BY array_to_string(words, ' ')),
        s AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(1, len(words) - 4) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle FROM k), n AS (SELECT id, count(*) AS n FROM s GROUP BY id), i AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.id < b.id GROUP BY 1, 2)
        SELECT id_a, id_b, round(1e-9 + i / CAST(x.n + y.n - i AS DOUBLE), 6) AS jaccard FROM i JOIN n x ON id_a = x.id JOIN n y ON id_b = y.id WHERE 5 * i >= 4 * (x.n + y.n - i)""",
    "o9_shortest_paths": "WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(unnest([(n_nationkey * 2) % 25, (n_nationkey * 3 + 1) % 25]) AS BIGINT) AS b FROM nation) WHERE a <> b), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, b, 1 AS dist FROM u UNION SELECT r.a, u.b, dist + 1 FROM r JOIN u ON r.b = u.a WHERE dist < 10) SELECT a, b, min(dist) AS dist FROM r WHERE a <> b GROUP BY a, b",
    "g8_cyclic_nodes": "WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(unnest([(n_nationkey * 2) % 25, (n_nationkey * 3 + 1) % 25]) AS BIGINT) AS b FROM nation)), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS node FROM c WHERE a = b",
    "stat_p24_coherence": """WITH u AS (SELECT label, embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings WHERE label IS NOT NULL), x AS (SELECT label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) / norm AS v FROM u), s AS (SELECT label, dim, sum(v) AS s, count(*) AS n FROM x GROUP BY label, dim)
        SELECT label, max(n) AS n, round(1e-9 + (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 5) AS coherence FROM s GROUP BY label HAVING max(n) > 1""",
    "h22_expression": "SELECT o_orderkey, 0 < o_totalprice / 1000 AND o_totalprice / 1000 <= 150 AND NOT (o_custkey % 2 = 0) AS holds FROM orders",
    "s19_levels": "SELECT 'question' AS level, count(*) AS n FROM question_mapping UNION ALL SELECT 'dimension', count(DISTINCT dimension) FROM question_mapping",
    "r5_vector_search": """SELECT query_id, vec_id, score, place FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (
        SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE score > 0) WHERE place <= 10""",
    "g3_closure": f"WITH RECURSIVE {_EDGES}, c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c",
    "g1_simple_paths": f"WITH RECURSIVE {_EDGES}, p AS (SELECT [a, b] AS path FROM e WHERE a <> b UNION ALL SELECT list_append(path, b) FROM p JOIN e ON path[-1] = a WHERE NOT list_contains(path, b) AND len(path) < 11) SELECT array_to_string(path, '>') AS path FROM p",
    "g3_components": f"WITH RECURSIVE {_EDGES}, c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a), n AS (SELECT a AS node FROM e UNION SELECT b FROM e) SELECT node, least(node, min(y.b)) AS component FROM n LEFT JOIN (SELECT c.a, c.b FROM c JOIN c d ON c.a = d.b AND c.b = d.a) y ON node = y.a GROUP BY node",
    "h11_horn_labels": """WITH f AS (SELECT DISTINCT o_custkey AS entity, 's' || o_orderstatus AS fact FROM orders), a AS (SELECT entity FROM f WHERE fact IN ('sF', 'sO') GROUP BY entity HAVING count(*) = 2), m AS (SELECT entity FROM a WHERE entity IN (SELECT entity FROM f WHERE fact = 'sP'))
        SELECT entity, fact FROM f UNION ALL SELECT entity, 'active' FROM a UNION ALL SELECT entity, 'mixed' FROM m UNION ALL SELECT entity, 'review' FROM m""",
    "s13_jsonl_round_trip": "SELECT dimension, count(*) AS n, CAST(sum(length(question_text)) AS BIGINT) AS chars FROM question_mapping GROUP BY dimension",
    "m10_stream_hours": "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "m5_stream_sliding": "SELECT CAST(w AS VARCHAR) AS start, event_type, count(*) AS n, round(1e-9 + avg(coalesce(value, 0)), 6) AS mean_value FROM (SELECT event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events WHERE ts IS NOT NULL) GROUP BY w, event_type",
    "m21_stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WHERE ts IS NOT NULL), s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(min(ts) AS VARCHAR) AS opened, count(*) AS n FROM s GROUP BY user_id, k",
}
