"""Evidence scoring and roll-ups from question to dimension, point, cluster and document.

The sales tables stand in for scored answers: an order is a question of a
customer's plan, its priority the response, the nation a point, the region a
cluster; line items are pieces of evidence and suppliers their sources.
"""

from __future__ import annotations

from legajo.plans.registry import build

# Base score of a response, weight of a dimension, expected questions of a dimension.
_BASE = "CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 1.0 WHEN '3-MEDIUM' THEN 0.5 ELSE 0.0 END"
_WEIGHT = "CASE dimension WHEN 'DE-1' THEN 0.30 WHEN 'DE-2' THEN 0.25 WHEN 'DE-3' THEN 0.25 ELSE 0.20 END"
_EXPECTED = "CASE dimension WHEN 'DE-1' THEN 6 WHEN 'DE-2' THEN 21 ELSE 8 END"

_ANSWERS = f"""answers AS (SELECT o_orderkey AS question_id, c_custkey AS document, n_nationkey AS point, n_regionkey AS cluster, concat('DE-', CAST(o_orderkey % 4 + 1 AS STRING)) AS dimension,
    o_orderpriority AS response, CAST({_BASE} AS DOUBLE) AS base, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS completeness, CAST(o_custkey % 11 AS DOUBLE) / 10 AS quality, CAST(o_orderkey % 7 AS INT) AS evidence
    FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey)"""
_SCORED = f"""{_ANSWERS}, scored AS (SELECT *, least(1.2, greatest(0.5, 0.5 + (0.7 * completeness + 0.3 * quality) * 0.7)) AS multiplier, base * least(1.2, greatest(0.5, 0.5 + (0.7 * completeness + 0.3 * quality) * 0.7)) AS score, CAST({_WEIGHT} AS DOUBLE) AS weight FROM answers)"""
_EVIDENCE = """evidence AS (SELECT l_orderkey AS question_id, l_linenumber AS evidence_id, l_suppkey AS source, concat('DE-', CAST(l_partkey % 4 + 1 AS STRING)) AS dimension, CAST(l_quantity AS DOUBLE) / 50 AS relevance, 1 - CAST(l_discount AS DOUBLE) * 5 AS credibility,
    CAST(l_tax AS DOUBLE) * 10 AS authority, l_shipdate AS dated, l_returnflag AS kind FROM {lineitem})"""
_POINTS = f"""{_SCORED}, dims AS (SELECT document, point, cluster, dimension, avg(score) AS score, count(*) AS n, sum(evidence) AS evidence FROM scored GROUP BY document, point, cluster, dimension),
    points AS (SELECT document, point, cluster, sum(score * {_WEIGHT}) / sum({_WEIGHT}) AS score, count(*) AS dimensions, sum(n) AS n, sum(evidence) AS evidence FROM dims GROUP BY document, point, cluster)"""
_COVERAGE = f"WITH {_ANSWERS} SELECT point, round(least(count_if(dimension = 'DE-1') / CAST(2 AS DOUBLE), 1.0), 6) AS de1, round(least(count_if(dimension = 'DE-2') / CAST(2 AS DOUBLE), 1.0), 6) AS de2, round(least(count_if(dimension = 'DE-3') / CAST(2 AS DOUBLE), 1.0), 6) AS de3, round(least(count_if(dimension = 'DE-4') / CAST(2 AS DOUBLE), 1.0), 6) AS de4 FROM answers"

SHARED = {
    "a1_base_scores": f"WITH {_ANSWERS} SELECT response, CAST(count(*) AS BIGINT) AS n, round(sum(base), 6) AS total FROM answers GROUP BY response",
    "a2_evidence_multiplier": f"WITH {_SCORED} SELECT question_id, round(multiplier, 6) AS multiplier, round(score, 6) AS score FROM scored",
    "a3_dimension_means": f"WITH {_SCORED} SELECT document, dimension, round(avg(score), 6) AS score FROM scored GROUP BY document, dimension",
    "a4_point_scores": f"WITH {_POINTS} SELECT document, point, round(score, 4) AS score FROM points",
    "a5_question_counts": f"WITH {_ANSWERS} SELECT document, CAST(count(*) AS BIGINT) AS n, count(*) = 47 AS complete FROM answers GROUP BY document",
    "a6_point_scores_fixed": f"WITH {_POINTS} SELECT document, round(sum(score * {_WEIGHT}), 4) AS score, round(count(*) / CAST(4 AS DOUBLE), 4) AS completion FROM dims GROUP BY document",
    "a7_compliance_histogram": f"WITH {_POINTS} SELECT point, CASE WHEN score >= 0.75 THEN 'CUMPLE' WHEN score >= 0.5 THEN 'CUMPLE_PARCIAL' ELSE 'NO_CUMPLE' END AS compliance, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean_score FROM points GROUP BY 1, 2",
    "a8_weighted_dimension": f"WITH {_SCORED} SELECT point, dimension, round(sum(score * (1 + evidence)) / sum(1 + evidence), 6) AS weighted, round(100 * sum(score * (1 + evidence)) / sum(sum(score * (1 + evidence))) OVER (PARTITION BY point), 6) AS share FROM scored GROUP BY point, dimension",
    "a9_density": f"WITH {_SCORED} SELECT point, dimension, round(sum(evidence) / CAST(count(*) AS DOUBLE), 6) AS density, round(avg(quality), 6) AS quality, round(least(100.0, 100.0 * count(*) / max({_EXPECTED})), 6) AS completion FROM scored GROUP BY point, dimension",
    "a10_corrections": f"WITH {_SCORED} SELECT point, dimension, round(avg(score) * CASE WHEN sum(evidence) / CAST(count(*) AS DOUBLE) < 0.3 THEN 0.8 ELSE 1.0 END * CASE WHEN dimension = 'DE-1' AND stddev_pop(score) > 0.15 * avg(score) THEN 0.9 ELSE 1.0 END, 6) AS corrected FROM scored GROUP BY point, dimension",
    "a11_correction_summary": f"WITH {_SCORED}, c AS (SELECT point, dimension, sum(evidence) / CAST(count(*) AS DOUBLE) < 3 AS sparse, stddev_pop(score) > 0.15 * avg(score) AS uneven FROM scored GROUP BY point, dimension) SELECT dimension, CAST(count_if(sparse) AS BIGINT) AS sparse, CAST(count_if(uneven) AS BIGINT) AS uneven FROM c GROUP BY dimension",
    "a13_evidence_weight": f"WITH {_EVIDENCE} SELECT question_id, evidence_id, round(greatest(0.1, least(2.0, (1 + 0.5 * (authority - 0.5)) * (1 + 0.3 * (credibility - 0.5)) * CASE WHEN dated IS NULL THEN 1.0 ELSE 1.02 END)), 6) AS weight FROM evidence",
    "a14_confidence_level": f"WITH {_EVIDENCE} SELECT question_id, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END AS level FROM (SELECT question_id, round((1 - least(1.0, var_pop(relevance))) * avg(credibility), 9) AS c FROM evidence GROUP BY question_id)",
    "a15_dimension_groups": f"WITH {_EVIDENCE} SELECT dimension, kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM evidence GROUP BY dimension, kind",
    "a16_coverage": f"WITH {_EVIDENCE} SELECT dimension, round(100.0 * count(DISTINCT source) / max(total), 2) AS coverage FROM evidence CROSS JOIN (SELECT count(DISTINCT source) AS total FROM evidence) GROUP BY dimension",
    "a17_divergence": f"WITH {_POINTS}, cv AS (SELECT cluster, stddev_pop(score) / avg(score) AS cv FROM points GROUP BY cluster) SELECT a.cluster AS cluster_a, b.cluster AS cluster_b, round(abs(a.cv - b.cv), 4) AS divergence FROM cv a JOIN cv b ON a.cluster < b.cluster",
    "a18_participation": f"WITH {_POINTS} SELECT cluster, round(100.0 * count_if(score >= 0.25) / count(*), 4) AS low, round(100.0 * count_if(score >= 0.5) / count(*), 4) AS middle, round(100.0 * count_if(score >= 0.75) / count(*), 4) AS high FROM points GROUP BY cluster",
    "a19_macro": f"WITH {_POINTS} SELECT round(sum(coalesce(s, 0) * w) / sum(w), 6) AS macro FROM (SELECT n_nationkey AS point, CAST(1 + n_nationkey % 3 AS DOUBLE) AS w FROM {{nation}}) LEFT JOIN (SELECT point AS p, avg(score) AS s FROM points GROUP BY point) ON point = p",
    "a20_clusters": f"WITH {_POINTS} SELECT cluster, round(avg(score), 6) AS mean_score, round(min(score), 6) AS least, round(max(score), 6) AS most, round(var_pop(score), 6) AS variance, CAST(sum(n) AS BIGINT) AS questions FROM points GROUP BY cluster",
    "a21_contradictions": f"WITH {_POINTS} SELECT point, round(cv, 6) AS cv, CASE WHEN cv > 0.5 THEN 'high' WHEN cv > 0.3 THEN 'medium' ELSE 'none' END AS severity, CAST(thin AS BIGINT) AS thin FROM (SELECT point, stddev_pop(score) / avg(score) AS cv, count_if(score > 0.7 AND evidence < 3) AS thin FROM points GROUP BY point)",
    "a21_outliers": f"WITH {_POINTS} SELECT document, point, round(z, 6) AS z FROM (SELECT document, point, (score - avg(score) OVER p) / nullif(stddev_pop(score) OVER p, 0) AS z FROM points WINDOW p AS (PARTITION BY point)) WHERE abs(z) > 2",
    "a22_recommendations": f"WITH {_POINTS}, p AS (SELECT point, avg(score) AS s, count_if(dimensions < 4) AS gaps FROM points GROUP BY point) SELECT point, CAST(place AS BIGINT) AS place, impact FROM (SELECT point, row_number() OVER (ORDER BY round(s, 9), gaps DESC, point) AS place, round(least(1 - s, 0.5) * 0.1, 6) AS impact FROM p) WHERE place <= 5",
    "a23_macro_penalised": f"WITH {_POINTS} SELECT cluster, round((0.5 * avg(dimensions / CAST(4 AS DOUBLE)) + 0.3 * count_if(score >= 0.5) / CAST(count(*) AS DOUBLE)) * (1 - least(1.0, stddev_pop(score))), 6) AS macro FROM points GROUP BY cluster",
    "a24_question_scores": f"WITH {_SCORED} SELECT question_id, round(0.7 * score + 0.3 * least(1.0, evidence / 5.0) * score, 6) AS adjusted, round(greatest(0.0, score - 1.96 * 0.1 / sqrt(1 + evidence)), 6) AS low, CASE WHEN evidence = 0 THEN 'critical' WHEN evidence < 2 THEN 'high' WHEN evidence < 4 THEN 'medium' ELSE 'none' END AS gap FROM scored",
    "a25_evidence_gaps": f"WITH {_EVIDENCE} SELECT severity, CAST(count(*) AS BIGINT) AS n FROM (SELECT question_id, CASE WHEN count(*) = 0 THEN 'critical' WHEN count(*) < 2 THEN 'severe' WHEN avg(relevance) < 0.3 THEN 'moderate' WHEN sum(relevance) < 1.5 THEN 'minor' ELSE 'none' END AS severity FROM evidence GROUP BY question_id) GROUP BY severity",
    "a26_quality": f"WITH {_EVIDENCE} SELECT question_id, round(sum(relevance * credibility) / nullif(sum(credibility), 0), 6) AS quality FROM evidence GROUP BY question_id",
    "a27_agreement": f"WITH {_EVIDENCE} SELECT question_id, round(exp(-var_samp(relevance) / 0.1), 6) AS agreement FROM evidence GROUP BY question_id HAVING count(*) > 1",
    "a28_question_confidence": f"WITH {_EVIDENCE} SELECT question_id, round(0.4 * least(1.0, count(*) / 5.0) + 0.4 * count(DISTINCT source) / CAST(count(*) AS DOUBLE) + 0.2 * avg(credibility), 6) AS confidence FROM evidence GROUP BY question_id",
    "a30_self_weighted": f"WITH {_POINTS} SELECT point, round(sum(score * score) / nullif(sum(score), 0), 6) AS confidence FROM points GROUP BY point",
    "a31_harmonic": f"WITH {_POINTS} SELECT cluster, round(count(*) / sum(1 / score), 6) AS harmonic FROM points WHERE score > 0 GROUP BY cluster",
    "a32_geometric": f"WITH {_POINTS} SELECT round(exp(avg(ln(score))), 6) AS geometric FROM points WHERE score > 0",
    "a33_recency": f"WITH {_EVIDENCE} SELECT question_id, round(avg(exp(-DAYS(dated, DATE '1999-01-01') / 365.0)), 6) AS recency FROM evidence GROUP BY question_id",
    "a34_normative": f"WITH {_EVIDENCE} SELECT question_id, round(greatest(0.0, 100 - (sum(CASE WHEN relevance < 0.1 THEN 10 ELSE 0 END) * (1 + 0.1 * count_if(relevance < 0.1)) + 5 * count_if(relevance >= 0.1 AND relevance < 0.3) + 0.5 * count_if(relevance >= 0.3 AND relevance < 0.5))), 6) AS score FROM evidence GROUP BY question_id",
    "a35_alignment": f"WITH {_EVIDENCE} SELECT dimension, round(sum(credibility * relevance) / sum(credibility) + least(0.2, 0.02 * count(DISTINCT source)), 6) AS alignment FROM evidence GROUP BY dimension",
    "a36_deviations": f"WITH {_POINTS} SELECT point, round(abs(0.75 - avg(score)), 6) AS deviation, CASE WHEN abs(0.75 - avg(score)) <= 0.1 THEN 'aligned' WHEN abs(0.75 - avg(score)) <= 0.3 THEN 'minor' WHEN abs(0.75 - avg(score)) <= 0.5 THEN 'major' ELSE 'critical' END AS status FROM points GROUP BY point",
    "a39_coverage_matrix": f"{_COVERAGE} GROUP BY point",
    "a40_lookup": "SELECT mapping_id, question_id, decalogo_point, dimension, sector FROM {question_mapping} WHERE decalogo_point = 3 OR (dimension = 'DE-2' AND value_chain_link = 'resultado')",
    "a41_registry_distribution": "SELECT decalogo_point, dimension, CAST(count(*) AS BIGINT) AS n, CAST(grouping(dimension) AS BIGINT) AS total FROM {question_mapping} GROUP BY GROUPING SETS ((decalogo_point, dimension), (decalogo_point))",
    "a42_jensen_shannon": """WITH p AS (SELECT o_orderpriority AS k, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_orderpriority), q AS (SELECT o_orderpriority AS k, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS q FROM {orders} WHERE o_orderstatus = 'O' GROUP BY o_orderpriority)
        SELECT round(sum(0.5 * p * ln(2 * p / (p + q)) + 0.5 * q * ln(2 * q / (p + q))), 9) AS js, round(sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))), 9) AS cosine FROM p JOIN q ON p.k = q.k""",
    "a44_chunk_rollup": "SELECT channel, CAST(count(*) AS BIGINT) AS n, round(count_if(token_count > 0) / CAST(count(*) AS DOUBLE), 6) AS success, CAST(count_if(token_count IS NULL) AS BIGINT) AS missing FROM {processed_chunk} GROUP BY channel",
    "a45_pooling": "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 3) AS mean_value, max(o_totalprice) AS most, min(o_totalprice) AS least, round(max(m) + ln(sum(exp(o_totalprice / 100000.0 - m))), 6) AS lse FROM (SELECT o_custkey, o_totalprice, max(o_totalprice / 100000.0) OVER (PARTITION BY o_custkey) AS m FROM {orders}) GROUP BY o_custkey",
    "a46_reducers": "SELECT o_custkey, o_orderpriority, max(o_totalprice) AS most, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_custkey, o_orderpriority",
    "a48_correction_factor": f"WITH {_POINTS} SELECT point, round(greatest(0.1, least(2.0, greatest(0.5, 1 - var_pop(score)) * exp(-abs(avg(score) - 0.5)) * greatest(0.3, 1 - stddev_pop(score)) * (1 + 0.2 * avg(dimensions / 4.0)))), 6) AS factor FROM points GROUP BY point",
    "a49_gap_priorities": f"WITH {_POINTS} SELECT point, dimension, gap FROM (SELECT point, dimension, round(gap, 6) AS gap, row_number() OVER (ORDER BY round(gap, 9) DESC, point, dimension) AS place FROM (SELECT point, dimension, 1 - avg(score) AS gap FROM dims GROUP BY point, dimension)) WHERE place <= 10",
    "a50_findings": f"WITH {_POINTS} SELECT cluster, CASE WHEN score >= 0.9 THEN 0.9 WHEN score >= 0.7 THEN 0.8 WHEN score >= 0.5 THEN 0.6 ELSE 0.3 END AS severity, CAST(count(*) AS BIGINT) AS n FROM points GROUP BY 1, 2",
    "a51_best_mapping": "SELECT question_id, mapping_id FROM (SELECT question_id, mapping_id, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(LEN(keywords), 0) DESC, mapping_id) AS place FROM {question_mapping}) WHERE place = 1",
    "a55_evidence_summary": f"WITH {_EVIDENCE} SELECT dimension, CAST(count(*) AS BIGINT) AS total, round(avg(relevance), 6) AS mean_relevance, CAST(count_if(credibility >= 0.8) AS BIGINT) AS confident, CAST(count(DISTINCT source) AS BIGINT) AS sources, CAST(count(DISTINCT kind) AS BIGINT) AS kinds FROM evidence GROUP BY dimension",
    "a57_satisfaction": f"WITH {_POINTS} SELECT dimension, round(avg(score), 6) AS mean_score, CASE WHEN avg(score) >= 0.8 THEN 'full' WHEN avg(score) >= 0.6 THEN 'mostly' WHEN avg(score) >= 0.4 THEN 'partial' WHEN avg(score) >= 0.2 THEN 'low' ELSE 'none' END AS level FROM dims GROUP BY dimension",
    "a58_pipeline_quality": f"WITH {_EVIDENCE}, q AS (SELECT 0.3 * relevance + 0.2 * credibility + 0.2 * authority + 0.2 * relevance + 0.1 AS s FROM evidence) SELECT round(avg(s), 6) AS mean_quality, round(min(s), 6) AS least, round(max(s), 6) AS most, CAST(count(*) AS BIGINT) AS n FROM q",
    "e2_rank_dedup": "SELECT chunk_id, hash FROM (SELECT chunk_id, md5(lower(trim(content))) AS hash, row_number() OVER (PARTITION BY md5(lower(trim(content))) ORDER BY coalesce(token_count, 0) DESC, chunk_id, row_id) AS place FROM {processed_chunk}) WHERE place = 1",
    "e3_evidence_types": "SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN content LIKE '%«%' OR content LIKE '%“%' THEN 'quote' WHEN LEN(FINDALL(content, '[0-9]+[.,]?[0-9]* ?%')) > 0 THEN 'statistic' WHEN lower(content) LIKE '%según%' THEN 'expert' WHEN lower(content) LIKE '%caso%' THEN 'case' ELSE 'paraphrase' END AS kind FROM {processed_chunk}) GROUP BY kind",
    "e4_confidence": "SELECT row_id, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN length(content) > 500 THEN 0.1 WHEN length(content) < 100 THEN -0.1 ELSE 0.0 END + 0.05 * LEN(FINDALL(content, 'según|indicador|meta')))), 6) AS confidence FROM {processed_chunk}",
    "e5_composite": f"WITH {_EVIDENCE} SELECT question_id, evidence_id, round(0.4 * relevance + 0.3 * credibility + 0.2 * exp(-DAYS(dated, DATE '1999-01-01') / 365.0) + 0.1 * authority, 6) AS score FROM evidence",
    "e7_recency_steps": f"WITH {_EVIDENCE} SELECT CASE WHEN age <= 365 THEN 1.0 WHEN age <= 1095 THEN 0.8 WHEN age <= 1825 THEN 0.6 ELSE 0.3 END AS recency, CAST(count(*) AS BIGINT) AS n FROM (SELECT DAYS(dated, DATE '1999-01-01') AS age FROM evidence) GROUP BY 1",
    "e8_merge": "SELECT chunk_id, CAST(count(*) AS BIGINT) AS multiplicity, max(received_at) AS latest, CAST(max(coalesce(token_count, 0)) AS BIGINT) AS counter FROM {processed_chunk} GROUP BY chunk_id",
    "e9_groups": f"WITH {_EVIDENCE} SELECT dimension, question_id, CAST(count(*) AS BIGINT) AS n, min(evidence_id) AS first_id FROM evidence GROUP BY dimension, question_id",
    "e11_routing": f"WITH {_EVIDENCE} SELECT route, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN kind = 'R' THEN 'review' WHEN dimension = 'DE-1' THEN 'diagnosis' WHEN credibility >= 0.8 THEN 'accept' ELSE 'queue' END AS route FROM evidence) GROUP BY route",
    "e12_validation": "SELECT row_id, round(greatest(0.0, least(1.0, hits / CAST(3 AS DOUBLE) + CASE WHEN size_ > 100 THEN 0.1 WHEN size_ < 20 THEN -0.2 ELSE 0.0 END)), 6) AS score FROM (SELECT row_id, length(content) AS size_, LEN(DISTINCT_OF(FINDALL(content, 'meta|indicador|línea base'))) AS hits FROM {processed_chunk})",
    "e13_quality_metrics": "SELECT channel, round(count_if(length(content) > 0) / CAST(count(DISTINCT chunk_id) AS DOUBLE), 6) AS completeness, round(count_if(LEN(page_anchors) > 0) / CAST(count(*) AS DOUBLE), 6) AS page_reference FROM {processed_chunk} GROUP BY channel",
    "e15_cluster_questionnaire": f"WITH {_SCORED} SELECT cluster, dimension, CAST(n AS BIGINT) AS n, CASE WHEN n >= 2 THEN 'CUMPLE' WHEN n = 1 THEN 'PARCIAL' ELSE 'NO' END AS verdict FROM (SELECT cluster, dimension, count_if(score > 0.5) AS n FROM scored GROUP BY cluster, dimension)",
    "e16_traceability": f"WITH {_EVIDENCE}, {_ANSWERS} SELECT a.cluster, e.dimension, CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT e.source) AS BIGINT) AS sources FROM evidence e JOIN answers a ON e.question_id = a.question_id GROUP BY a.cluster, e.dimension",
    "e17_best_candidate": f"WITH {_EVIDENCE} SELECT question_id, evidence_id, score FROM (SELECT question_id, evidence_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, evidence_id) AS place FROM (SELECT question_id, evidence_id, round(relevance * CASE kind WHEN 'R' THEN 1.3 WHEN 'A' THEN 1.0 ELSE 0.9 END, 6) AS score FROM evidence)) WHERE place = 1",
    "e18_point_evidence": "SELECT m.mapping_id, round(least(1.0, LEN(INTERSECT_OF(m.w, m.k)) / CAST(LEN(m.k) AS DOUBLE)), 6) AS confidence FROM (SELECT mapping_id, DISTINCT_OF(WORDS(question_text)) AS w, DISTINCT_OF(WORDS(point_name)) AS k FROM {question_mapping}) m WHERE LEN(m.k) > 0",
}

QUERIES, ORACLES = build(SHARED)
