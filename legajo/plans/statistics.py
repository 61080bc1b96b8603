"""Conformal statistics, drift, ordering and lineage, rules, graphs and operational metrics."""

from __future__ import annotations

from legajo.plans.registry import build

# o_totalprice stands for the truth, a smooth function of the customer for the prediction.
_PAIRS = "pairs AS (SELECT o_orderkey AS id, o_orderpriority AS kind, o_totalprice / 500000 AS truth, (150000 + (o_custkey % 100) * 100) / CAST(500000 AS DOUBLE) AS predicted FROM {orders})"
_NC = f"{_PAIRS}, nc AS (SELECT id, kind, truth, predicted, abs(truth - predicted) AS s, row_number() OVER (PARTITION BY kind ORDER BY abs(truth - predicted), id) AS place, count(*) OVER (PARTITION BY kind) AS n FROM pairs)"
_Q = f"{_NC}, q AS (SELECT kind, max(CASE WHEN place = least(n, CAST(ceil((n + 1) * 0.9) AS BIGINT)) THEN s END) AS q90, max(CASE WHEN place = least(n, CAST(ceil((n + 1) * 0.95) AS BIGINT)) THEN s END) AS q95 FROM nc GROUP BY kind)"
_SAMPLES = "x AS (SELECT o_totalprice / 100000 AS v FROM {orders} WHERE o_orderstatus = 'F'), y AS (SELECT o_totalprice / 100000 AS v FROM {orders} WHERE o_orderstatus = 'O')"
_LINKS = "links AS (SELECT l_suppkey AS a, l_partkey % 50 + 1 AS b, avg(l_discount) * 10 AS confidence, count(*) AS n FROM {lineitem} GROUP BY l_suppkey, l_partkey % 50 + 1)"
_METRICS = "m AS (SELECT event_id, ts, user_id, event_type, coalesce(value, 0) AS value FROM {events} WHERE ts IS NOT NULL)"

SHARED = {
    "stat_p1_nonconformity": f"WITH {_PAIRS} SELECT id, round(abs(truth - predicted), 6) AS absolute, round(abs(truth - predicted) / (0.01 + predicted), 6) AS normalised FROM pairs",
    "stat_p2_conformal_quantile": f"WITH {_Q} SELECT kind, round(q90, 6) AS q90, round(q95, 6) AS q95 FROM q",
    "stat_p3_intervals": f"WITH {_Q} SELECT id, round(greatest(0.0, predicted - q90), 6) AS low, round(least(1.0, predicted + q90), 6) AS high FROM pairs JOIN q ON pairs.kind = q.kind",
    "stat_p4_coverage": f"WITH {_Q} SELECT q.kind, round(avg(CASE WHEN abs(truth - predicted) <= q90 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(least(1.0, predicted + q90) - greatest(0.0, predicted - q90)), 6) AS width FROM pairs JOIN q ON pairs.kind = q.kind GROUP BY q.kind",
    "stat_p6_regression_scorers": f"WITH {_PAIRS} SELECT kind, round(avg(abs(truth - predicted)), 6) AS absolute, round(avg(power(truth - predicted, 2)), 6) AS squared, round(avg(greatest(0.9 * (truth - predicted), -0.1 * (truth - predicted))), 6) AS pinball, round(stddev_pop(truth - predicted), 6) AS scale FROM pairs GROUP BY kind",
    "stat_p8_quantile_levels": f"WITH {_PAIRS} SELECT kind, round(MEDIAN_AT(abs(truth - predicted), 0.9), 6) AS interpolated, round(avg(abs(truth - predicted)) + 1.645 * stddev_pop(abs(truth - predicted)), 6) AS normal FROM pairs GROUP BY kind",
    "stat_p10_risk_bounds": f"WITH {_PAIRS} SELECT kind, round(avg(abs(truth - predicted)) + sqrt(ln(20) / (2 * count(*))), 6) AS hoeffding, round(avg(abs(truth - predicted)) + 1.645 * stddev_samp(abs(truth - predicted)) / sqrt(count(*)), 6) AS clt FROM pairs GROUP BY kind",
    "stat_p11_ks_drift": f"""WITH {_SAMPLES}, z AS (SELECT v, sum(nx) AS nx, sum(ny) AS ny FROM (SELECT v, 1 AS nx, 0 AS ny FROM x UNION ALL SELECT v, 0, 1 FROM y) GROUP BY v), b AS (SELECT floor(v * 1000) AS bin, sum(nx) AS nx, sum(ny) AS ny FROM z GROUP BY floor(v * 1000))
        SELECT round(max(abs(fx - fy)), 6) AS ks FROM (SELECT sum(nx) OVER (ORDER BY bin) / CAST((SELECT count(*) FROM x) AS DOUBLE) AS fx, sum(ny) OVER (ORDER BY bin) / CAST((SELECT count(*) FROM y) AS DOUBLE) AS fy FROM b)""",
    "stat_p13_energy_distance": """WITH z AS (SELECT bin, sum(nx) AS nx, sum(ny) AS ny FROM (SELECT floor(o_totalprice / 100) AS bin, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS nx, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS ny FROM {orders}) GROUP BY bin),
        c AS (SELECT bin, CAST(sum(nx) OVER (ORDER BY bin) AS DOUBLE) / sum(nx) OVER () AS fx, CAST(sum(ny) OVER (ORDER BY bin) AS DOUBLE) / sum(ny) OVER () AS fy, lead(bin) OVER (ORDER BY bin) - bin AS step FROM z) SELECT round(2 * sum(power(fx - fy, 2) * step) / 1000, 6) AS energy FROM c WHERE step IS NOT NULL""",
    "stat_p14_fold_coverage": f"WITH {_PAIRS}, f AS (SELECT id % 5 AS fold, abs(truth - predicted) AS s FROM pairs), q AS (SELECT k.fold, MEDIAN_AT(f.s, 0.9) AS q FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY k.fold) SELECT CAST(f.fold AS BIGINT) AS fold, round(avg(CASE WHEN s <= q THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM f JOIN q ON f.fold = q.fold GROUP BY f.fold",
    "stat_p17_trend": f"WITH {_METRICS} SELECT event_type, round(regr_slope(value, place), 6) AS slope FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS place FROM m) WHERE place <= 30 GROUP BY event_type",
    "stat_p19_hoeffding_band": f"WITH {_METRICS} SELECT event_type, round(avg(value) - (max(value) - min(value)) * sqrt(ln(40) / (2 * count(*))), 6) AS low, round(avg(value) + (max(value) - min(value)) * sqrt(ln(40) / (2 * count(*))), 6) AS high FROM m GROUP BY event_type",
    "stat_p20_anova": """WITH g AS (SELECT o_orderpriority AS k, count(*) AS n, avg(o_totalprice) AS mean_value, var_pop(o_totalprice) * count(*) AS ssw FROM {orders} GROUP BY o_orderpriority), t AS (SELECT sum(n) AS n, sum(n * mean_value) / sum(n) AS grand, sum(ssw) AS ssw, count(*) AS k FROM g)
        SELECT round((sum(g.n * power(mean_value - grand, 2)) / (max(t.k) - 1)) / (max(t.ssw) / (max(t.n) - max(t.k))), 6) AS f FROM g CROSS JOIN t""",
    "stat_p22_information": """WITH j AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM {orders} GROUP BY o_orderstatus, o_orderpriority), w AS (SELECT p, sum(p) OVER (PARTITION BY a) AS pa, sum(p) OVER (PARTITION BY b) AS pb FROM j)
        SELECT round(-sum(p * ln(p)), 6) AS joint, round(sum(p * ln(p / (pa * pb))), 6) AS mutual, round(-sum(p * ln(p / pa)), 6) AS conditional FROM w""",
    "stat_p23_posteriors": "SELECT o_orderpriority AS kind, round((1 + count_if(o_orderstatus = 'F')) / CAST(2 + count(*) AS DOUBLE), 6) AS mean_value, round(sqrt((1 + count_if(o_orderstatus = 'F')) * (1 + count_if(o_orderstatus <> 'F')) / (power(2 + count(*), 2) * (3 + count(*)))), 6) AS sd FROM {orders} GROUP BY o_orderpriority",
    "stat_p25_metric_model": f"WITH {_METRICS} SELECT event_type, round(regr_slope(value, UNIX(ts) / 3600), 6) AS slope, round(regr_r2(value, UNIX(ts) / 3600), 6) AS r2 FROM m GROUP BY event_type",
    "h1_total_order": "SELECT vec, CAST(place AS BIGINT) AS place FROM (SELECT o_orderkey AS vec, row_number() OVER (ORDER BY CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END, o_totalprice DESC, o_orderkey) AS place FROM {orders})",
    "h3_canonical_hash": "SELECT o_orderkey, SHA(concat_ws('|', CAST(o_custkey AS STRING), o_orderpriority, o_orderstatus)) AS hash FROM {orders}",
    "h4_combined_hash": "SELECT o_custkey, SHA(JOINED(SORTED(COLLECT(md5(CAST(o_orderkey AS STRING)))), '|')) AS hash FROM {orders} GROUP BY o_custkey",
    "h7_merkle_leaves": "SELECT place, SHA(concat(min(CASE WHEN side = 0 THEN h END), coalesce(min(CASE WHEN side = 1 THEN h END), min(CASE WHEN side = 0 THEN h END)))) AS node FROM (SELECT CAST(floor(c_custkey / 2) AS BIGINT) AS place, c_custkey % 2 AS side, SHA(c_name) AS h FROM {customer}) GROUP BY place HAVING min(CASE WHEN side = 0 THEN h END) IS NOT NULL",
    "h15_artifact_integrity": "SELECT record_id, CASE WHEN payload IS NULL THEN 'missing' WHEN trim(payload) = '' THEN 'empty' WHEN substr(trim(payload), length(trim(payload)), 1) NOT IN ('}', ']') THEN 'truncated' ELSE 'ok' END AS state, CAST(length(payload) AS BIGINT) AS size_, SHA(coalesce(payload, '')) AS hash FROM {aggregation_artifact}",
    "h16_required_fields": "SELECT row_id, (CASE WHEN content IS NULL THEN 1 ELSE 0 END) + (CASE WHEN token_count IS NULL THEN 1 ELSE 0 END) + (CASE WHEN sentence_count IS NULL THEN 1 ELSE 0 END) + (CASE WHEN provenance.source_hash IS NULL THEN 1 ELSE 0 END) AS missing FROM {processed_chunk}",
    "h17_constraints": "SELECT l_orderkey, count(*) >= 3 AND avg(l_quantity) / 50 >= 0.5 AND avg(l_discount) <= 0.2 AS satisfied FROM {lineitem} GROUP BY l_orderkey",
    "h18_missing_indicators": "SELECT document, dimension FROM (SELECT c_custkey AS document, concat('DE-', CAST(r_regionkey % 4 + 1 AS STRING)) AS dimension FROM {customer} CROSS JOIN (SELECT r_regionkey FROM {region} WHERE r_regionkey < 4)) EXCEPT SELECT o_custkey, concat('DE-', CAST(o_orderkey % 4 + 1 AS STRING)) FROM {orders}",
    "h20_normative_rules": "SELECT mapping_id, 100 - (CASE WHEN sector IS NULL THEN 15 ELSE 0 END) - (CASE WHEN weight IS NULL THEN 20 ELSE 0 END) - (CASE WHEN search_patterns IS NULL THEN 8 ELSE 0 END) - (CASE WHEN keywords IS NULL THEN 5 ELSE 0 END) AS score FROM {question_mapping}",
    "h21_first_failed_guard": "SELECT row_id, CASE WHEN content IS NULL THEN 'g1' WHEN token_count IS NULL THEN 'g2' WHEN token_count <= 0 THEN 'g3' WHEN sentence_count > token_count THEN 'g4' ELSE 'none' END AS guard FROM {processed_chunk}",
    "h23_ranges": "SELECT row_id, coalesce(token_count BETWEEN 0 AND 5000, true) AND coalesce(channel IN ('pdf_text', 'pdf_scan', 'portal'), true) AS valid FROM {processed_chunk}",
    "h24_sections": "SELECT channel, CAST(count_if(LEN(WORDS(content)) < 20) AS BIGINT) AS short, CAST(count_if(LEN(provenance.section_path) = 0) AS BIGINT) AS loose, CAST(count(*) AS BIGINT) AS n FROM {processed_chunk} GROUP BY channel",
    "h25_text_validators": "SELECT row_id, CAST(LEN(FINDALL(content, 'quizás|tal vez|aproximadamente|posiblemente')) AS BIGINT) AS uncertain, CAST(LEN(FINDALL(content, '[0-9]+[.,]?[0-9]* ?%')) AS BIGINT) AS figures, content LIKE '%según%' AS sourced FROM {processed_chunk}",
    "m1_ema": f"WITH {_METRICS}, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY event_type) AS n FROM m) SELECT event_type, round(sum(value * power(0.7, least(back, 700)) * CASE WHEN back = n - 1 THEN 1.0 ELSE 0.3 END), 6) AS ema FROM r WHERE back < 200 GROUP BY event_type",
    "m2_trend": f"WITH {_METRICS} SELECT event_type, CASE WHEN abs(r) < 0.5 THEN 'volatile' WHEN slope > 0.1 THEN 'up' WHEN slope < -0.1 THEN 'down' ELSE 'flat' END AS trend FROM (SELECT event_type, regr_slope(value, -place) AS slope, corr(value, -place) AS r FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM m) WHERE place <= 5 GROUP BY event_type)",
    "m3_window_variance": f"WITH {_METRICS} SELECT event_id, round(var_pop(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 5) AS variance FROM m",
    "m4_scaling": f"WITH {_METRICS}, h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, avg(value) AS v FROM m GROUP BY date_trunc('hour', ts)), s AS (SELECT hour, (CASE WHEN n > 1.2 * avg(n) OVER () THEN 2 ELSE 0 END) + (CASE WHEN v > avg(v) OVER () THEN 1 ELSE 0 END) AS score FROM h) SELECT CASE WHEN score >= 2 THEN 'up' WHEN score = 0 THEN 'down' ELSE 'hold' END AS decision, CAST(count(*) AS BIGINT) AS hours FROM s GROUP BY 1",
    "m5_sliding_rate": f"WITH {_METRICS} SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS trailing, round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w / CAST(count(*) OVER w AS DOUBLE), 6) AS error_rate FROM (SELECT event_id, event_type, CAST(floor(UNIX(ts)) AS BIGINT) AS s FROM m) WINDOW w AS (PARTITION BY event_type ORDER BY s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)",
    "m6_latency": f"WITH {_METRICS} SELECT event_type, max(CASE WHEN place = floor(n * 0.5) THEN value END) AS p50, max(CASE WHEN place = floor(n * 0.95) THEN value END) AS p95, max(CASE WHEN place = floor(n * 0.99) THEN value END) AS p99 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM m) GROUP BY event_type",
    "m7_alerts": f"WITH {_METRICS} SELECT event_id, state FROM (SELECT event_id, CASE WHEN high AND NOT was THEN 'fire' WHEN high THEN 'update' WHEN was THEN 'resolve' ELSE 'idle' END AS state FROM (SELECT event_id, value > 50 AS high, coalesce(lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS was FROM m)) WHERE state <> 'idle'",
    "m9_active": f"WITH {_METRICS} SELECT event_type, CASE WHEN value > 90 THEN 'critical' WHEN value > 50 THEN 'warning' ELSE 'info' END AS severity, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1, 2",
    "m10_hour_trend": f"WITH {_METRICS} SELECT CAST(date_trunc('hour', ts) AS STRING) AS hour, event_type, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1, 2",
    "m11_top_components": f"WITH {_METRICS} SELECT user_id, n FROM (SELECT user_id, n, row_number() OVER (ORDER BY n DESC, user_id) AS place FROM (SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY user_id HAVING count(DISTINCT event_type) > 1)) WHERE place <= 10",
    "m13_delivery": f"WITH {_METRICS} SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS receivers, round(avg(value), 6) AS mean_value FROM m GROUP BY event_type",
    "m14_duplicates": f"WITH {_METRICS} SELECT user_id, CAST(max(event_id) AS BIGINT) AS version, CAST(count(DISTINCT event_id) AS BIGINT) AS messages FROM m GROUP BY user_id",
    "m15_barrier": f"WITH {_METRICS} SELECT user_id, max(first_at) AS fired_at FROM (SELECT user_id, event_type, min(ts) AS first_at FROM m GROUP BY user_id, event_type) GROUP BY user_id HAVING count(*) = (SELECT count(DISTINCT event_type) FROM m)",
    "m16_merge": f"WITH {_METRICS} SELECT user_id, event_type, max(value) AS most, max(ts) AS latest FROM m GROUP BY user_id, event_type",
    "m20_edges": f"WITH {_METRICS} SELECT source, target, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type AS target, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source FROM m) WHERE source IS NOT NULL GROUP BY source, target",
    "m21_sessions": f"WITH {_METRICS}, g AS (SELECT user_id, ts, event_id, CASE WHEN UNIX(ts) - lag(UNIX(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800 THEN 0 ELSE 1 END AS starts FROM m), s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS opened, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, session",
    "m23_progress": f"WITH {_METRICS} SELECT event_type, round(avg(value), 6) AS mean_value, min(value) AS least, max(value) AS most FROM m GROUP BY event_type",
    "m24_health": f"WITH {_METRICS}, l AS (SELECT event_type, CASE WHEN avg(value) > 90 THEN 3 WHEN avg(value) > 50 THEN 2 WHEN avg(value) > 20 THEN 1 ELSE 0 END AS level FROM m GROUP BY event_type) SELECT round(100 - 25 * avg(level), 6) AS health, round(count(*) / CAST(5 AS DOUBLE), 6) AS confidence FROM l",
    "g2_roots_terminals": "WITH e AS (SELECT DISTINCT n_regionkey AS a, n_nationkey + 100 AS b FROM {nation} UNION SELECT DISTINCT c_nationkey + 100, c_custkey + 1000 FROM {customer}) SELECT CAST((SELECT count(*) FROM (SELECT a FROM e EXCEPT SELECT b FROM e)) AS BIGINT) AS roots, CAST((SELECT count(*) FROM (SELECT b FROM e EXCEPT SELECT a FROM e)) AS BIGINT) AS terminals",
    "g4_degrees": f"WITH {_LINKS} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT a AS node, 1 AS o, 0 AS i FROM links UNION ALL SELECT b, 0, 1 FROM links) GROUP BY node",
    "g5_confident_subgraph": f"WITH {_LINKS} SELECT a, b, round(confidence, 6) AS confidence FROM links WHERE round(confidence, 9) >= 0.5",
    "g6_intervention": f"WITH {_LINKS} SELECT a, b FROM links WHERE b <> 7",
    "g7_roles": f"WITH {_LINKS}, k AS (SELECT a, b FROM links WHERE round(confidence, 9) >= 0.6) SELECT node, CAST(sum(m) AS BIGINT) AS mediates, CAST(sum(c) AS BIGINT) AS collides FROM (SELECT x.b AS node, count(*) AS m, 0 AS c FROM k x JOIN k y ON x.b = y.a AND x.a <> y.b GROUP BY x.b UNION ALL SELECT b, 0, count(*) * (count(*) - 1) / 2 FROM k GROUP BY b) GROUP BY node",
    "g13_strength": f"WITH {_LINKS} SELECT b, round(avg(confidence) + least(0.2, 0.05 * count(DISTINCT a)), 6) AS strength FROM links GROUP BY b",
    "g14_inventory": "SELECT word, CAST(count(DISTINCT chunk_id) AS BIGINT) AS chunks FROM (SELECT chunk_id, UNNEST(FINDALL(content, '[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+ [A-ZÁÉÍÓÚÑ][a-záéíóúñ]+')) AS word FROM {processed_chunk}) GROUP BY word",
    "g16_node_ids": f"WITH {_LINKS} SELECT a, b, substr(SHA(concat(CAST(a AS STRING), '>', CAST(b AS STRING))), 1, 16) AS edge_id FROM links",
    "s6_page_ranges": "SELECT doc_id, CAST(floor(page / 3) AS BIGINT) AS part, CAST(min(page) AS BIGINT) AS first_page, CAST(max(page) AS BIGINT) AS last_page FROM (SELECT doc_id, UNNEST(RANGE0) AS page FROM (SELECT doc_id, CAST(floor(length(text) / 2000) AS INT) AS last FROM {documents})) GROUP BY doc_id, floor(page / 3)",
    "s4_needs_ocr": "SELECT chunk_id, length(trim(content)) < 50 OR LEN(FINDALL(content, '[^a-zA-ZáéíóúñüÁÉÍÓÚÑ0-9 .,;:!?()%\\n-]')) > 0.3 * length(content) AS needs_ocr FROM (SELECT chunk_id, min(content) AS content FROM {processed_chunk} GROUP BY chunk_id)",
    "s14_manifest": "SELECT channel, metadata.policy AS policy, CAST(count(*) AS BIGINT) AS sections, CAST(sum(length(content)) AS BIGINT) AS chars FROM {processed_chunk} GROUP BY channel, metadata.policy",
    "s15_citation_index": "SELECT provenance.source_document AS source, page, CAST(count(DISTINCT chunk_id) AS BIGINT) AS chunks FROM (SELECT provenance, chunk_id, UNNEST(PAGES) AS page FROM {processed_chunk}) GROUP BY provenance.source_document, page",
    "s22_readiness": "SELECT source, count(*) >= 1 AND avg(complete) >= 0.5 AND max(size_) > 500 AS ready FROM (SELECT provenance.source_document AS source, CASE WHEN token_count IS NULL THEN 0.0 ELSE 1.0 END AS complete, length(content) AS size_ FROM {processed_chunk}) GROUP BY source",
    "x_theta_join": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "x_cube": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "x_intersect": "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O'",
}


def _own(sql: str, engine: int) -> str:
    return sql.replace("RANGE0", ("sequence(0, last)", "range(0, last + 1)")[engine]).replace("UNNEST(PAGES)", ("explode(page_anchors.page_number)", "unnest(list_transform(page_anchors, lambda x: x.page_number))")[engine])


QUERIES = build({k: _own(v, 0) for k, v in SHARED.items()})[0]
ORACLES = build({k: _own(v, 1) for k, v in SHARED.items()})[1]
