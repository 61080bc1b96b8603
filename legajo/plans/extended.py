"""Further queries: hybrid ranking, evaluation, drift, graph effects, transport inputs and controls."""

from __future__ import annotations

from legajo.plans.registry import build, spark_query
from legajo.plans.scoring import _ANSWERS, _EVIDENCE, _POINTS, _SCORED
from legajo.plans.statistics import _LINKS, _METRICS, _PAIRS

_POSTINGS = """t AS (SELECT doc_id, word, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, UNNEST(WORDS(text)) AS word FROM {documents}) GROUP BY doc_id, word),
    d AS (SELECT doc_id, sum(tf) AS dl FROM t GROUP BY doc_id), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d)"""
_QUERY_TERMS = "k AS (SELECT kw_id, UNNEST(WORDS(keyword)) AS word FROM {keyword_lexicon})"
_BATCH = f"""{_POSTINGS}, {_QUERY_TERMS}, f AS (SELECT t.word, count(*) AS df FROM t JOIN (SELECT DISTINCT word FROM k) u ON t.word = u.word GROUP BY t.word),
    b AS (SELECT kw_id, t.doc_id, round(sum(ln((s.n - f.df + 0.5) / (f.df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM k JOIN f ON k.word = f.word JOIN t ON t.word = f.word JOIN d ON t.doc_id = d.doc_id CROSS JOIN s GROUP BY kw_id, t.doc_id),
    r AS (SELECT kw_id, doc_id, score, row_number() OVER (PARTITION BY kw_id ORDER BY score DESC, doc_id) AS place FROM b)"""
_FUSED = """lexical AS (SELECT o_custkey AS k, avg(o_totalprice) / 500000 AS s FROM {orders} GROUP BY o_custkey), dense AS (SELECT c_custkey AS k, (c_acctbal + 1000) / 11000 AS s FROM {customer}), late AS (SELECT o_custkey AS k, count(DISTINCT o_orderpriority) / CAST(5 AS DOUBLE) AS s FROM {orders} GROUP BY o_custkey),
    places AS (SELECT k, CAST(1 AS DOUBLE) / (60 + row_number() OVER (ORDER BY s DESC, k)) AS s FROM lexical UNION ALL SELECT k, CAST(1 AS DOUBLE) / (60 + row_number() OVER (ORDER BY s DESC, k)) FROM dense), rrf AS (SELECT k, sum(s) AS s FROM places GROUP BY k)"""

# Whole keywords: candidates share the first word, then the keyword has to stand between characters of no word, any white space for its blanks.
_PHRASES = r"""SELECT mapping_id, kw_id, CASE WHEN concat(' ', line, ' ') LIKE concat('% ', phrase, ' %') THEN 1.0 ELSE 0.95 END AS score
    FROM (SELECT mapping_id, line, UNNEST(DISTINCT_OF(WORDS(line))) AS word FROM (SELECT mapping_id, lower(question_text) AS line FROM {question_mapping}))
    JOIN (SELECT kw_id, lower(keyword) AS phrase, WORDS(keyword)[0] AS first_word FROM {keyword_lexicon} WHERE LEN(WORDS(keyword)) > 0) ON word = first_word
    WHERE regexp_replace(line, '\\s+', ' ') RLIKE concat('(?<![\\p{L}\\p{N}_])\\Q', regexp_replace(phrase, '\\s+', ' '), '\\E(?![\\p{L}\\p{N}_])')"""

SHARED = {
    "r23_batch_search": f"WITH {_BATCH} SELECT kw_id, doc_id, score, CAST(place AS BIGINT) AS place FROM r WHERE place <= 10",
    "r33_evaluation": f"""WITH {_BATCH}, g AS (SELECT kw_id, doc_id, place, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS rel FROM r WHERE place <= 100)
        SELECT kw_id, round(sum(CASE WHEN place <= 10 THEN rel / (ln(place + 1) / ln(2)) ELSE 0.0 END), 6) AS dcg10, round(sum(rel) / CAST(count(*) AS DOUBLE), 6) AS precision100 FROM g GROUP BY kw_id""",
    "r27_pseudo_ndcg": """WITH p AS (SELECT o_custkey, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS shown FROM {orders}), q AS (SELECT o_custkey, MEDIAN_AT(o_totalprice, 0.9) AS a, MEDIAN_AT(o_totalprice, 0.7) AS b, MEDIAN_AT(o_totalprice, 0.5) AS c FROM {orders} GROUP BY o_custkey),
        g AS (SELECT p.o_custkey, place, shown, CASE WHEN s >= a THEN 3 WHEN s >= b THEN 2 WHEN s >= c THEN 1 ELSE 0 END AS rel FROM p JOIN q ON p.o_custkey = q.o_custkey)
        SELECT o_custkey, round(sum(CASE WHEN shown <= 10 THEN (power(2, rel) - 1) / (ln(shown + 1) / ln(2)) ELSE 0.0 END) / sum(CASE WHEN place <= 10 THEN (power(2, rel) - 1) / (ln(place + 1) / ln(2)) ELSE 0.0 END), 6) AS ndcg FROM g GROUP BY o_custkey""",
    "r11_weighted_hybrid": f"WITH {_FUSED} SELECT coalesce(l.k, d.k) AS item, round(0.3 * coalesce(l.s, 0.0) + 0.4 * coalesce(d.s, 0.0) + 0.2 * coalesce(t.s, 0.0) + 0.1 * coalesce(f.s, 0.0), 6) AS score FROM lexical l FULL JOIN dense d ON l.k = d.k LEFT JOIN late t ON coalesce(l.k, d.k) = t.k LEFT JOIN rrf f ON coalesce(l.k, d.k) = f.k",
    "r22_alpha_hybrid": f"WITH {_FUSED} SELECT coalesce(l.k, d.k) AS item, round(0.4 * coalesce(l.s, 0.0) + 0.4 * coalesce(d.s, 0.0) + 0.2 * coalesce(t.s, 0.0), 6) AS score FROM lexical l FULL JOIN dense d ON l.k = d.k LEFT JOIN late t ON coalesce(l.k, d.k) = t.k",
    "r18_word_variants": "SELECT kw_id, word, concat(word, 's') AS plural, substr(word, 1, 5) AS stem FROM (SELECT kw_id, UNNEST(WORDS(keyword)) AS word FROM {keyword_lexicon})",
    "r20_objective_rerank": f"WITH {_FUSED}, w AS (SELECT avg(s) AS m, stddev_pop(s) AS sd FROM lexical) SELECT lexical.k AS item, round(0.7 * s + 0.3 / (1 + exp(-(s - m) / sd)), 6) AS score FROM lexical CROSS JOIN w",
    "t10_metadata": "SELECT doc_id, min(CAST(year AS INT)) AS first_year, max(CAST(year AS INT)) AS last_year FROM (SELECT doc_id, UNNEST(FINDALL(text, '20[0-9][0-9]')) AS year FROM {documents}) GROUP BY doc_id",
    "t14_fuzzy_sections": "SELECT a.kw_id AS id_a, b.kw_id AS id_b, CAST(levenshtein(lower(a.keyword), lower(b.keyword)) AS BIGINT) AS distance FROM {keyword_lexicon} a JOIN {keyword_lexicon} b ON a.kw_id < b.kw_id WHERE levenshtein(lower(a.keyword), lower(b.keyword)) <= 3",
    "e6_components": f"WITH {_EVIDENCE} SELECT question_id, evidence_id, round(least(1.0, relevance * 1.2), 6) AS relevance, round(CASE kind WHEN 'R' THEN 0.9 WHEN 'A' THEN 0.7 ELSE 0.5 END, 6) AS credibility, round(least(1.0, authority + 0.1), 6) AS authority FROM evidence",
    "a29_dimension_level": f"WITH {_SCORED} SELECT document, dimension, CAST(sum(evidence) AS BIGINT) AS evidence, round(sum(quality * (1 + evidence)) / sum(1 + evidence), 6) AS quality FROM scored GROUP BY document, dimension",
    "a37_standards": "SELECT channel, round((0.4 * count_if(lower(content) LIKE '%indicador%') + 0.3 * count_if(lower(content) LIKE '%meta%') + 0.3 * count_if(lower(content) LIKE '%línea base%')) / count(*), 6) AS compliance FROM {processed_chunk} GROUP BY channel",
    "a38_framework": "SELECT decalogo_point, round(100.0 * count(DISTINCT value_chain_link) / max(total), 6) AS compliance, CASE WHEN 100.0 * count(DISTINCT value_chain_link) / max(total) >= 90 THEN 'alto' WHEN 100.0 * count(DISTINCT value_chain_link) / max(total) >= 70 THEN 'medio' ELSE 'bajo' END AS level FROM {question_mapping} CROSS JOIN (SELECT count(DISTINCT value_chain_link) AS total FROM {question_mapping}) t GROUP BY decalogo_point",
    "a52_intent": "SELECT mapping_id, CASE WHEN scope + measure + cause = 0 THEN 'unknown' WHEN cause >= measure AND cause >= scope THEN 'causa' WHEN measure >= scope THEN 'medida' ELSE 'alcance' END AS intent FROM (SELECT mapping_id, LEN(FINDALL(question_text, 'cobertura|territorio|población')) AS scope, LEN(FINDALL(question_text, 'meta|indicador|cuánto')) AS measure, LEN(FINDALL(question_text, 'por qué|causa|depende')) AS cause FROM {question_mapping})",
    "a53_attention": f"WITH {_EVIDENCE} SELECT question_id, evidence_id, round(greatest(0.0, least(1.0, 0.4 * relevance + 0.2 * coalesce(lag(relevance) OVER w, relevance) + 0.2 * credibility + 0.2 * authority)), 6) AS attention FROM evidence WINDOW w AS (PARTITION BY question_id ORDER BY evidence_id, relevance, source, authority, credibility)",
    "a54_answer_coverage": f"WITH {_EVIDENCE} SELECT question_id, round(least(1.0, count(*) / 5.0), 6) AS density, round(count(DISTINCT source) / CAST(count(*) AS DOUBLE), 6) AS diversity, round(count(*) / CAST(count(DISTINCT dimension) AS DOUBLE), 6) AS depth, round(count(DISTINCT dimension) / CAST(4 AS DOUBLE), 6) AS breadth FROM evidence GROUP BY question_id",
    "a56_answer_confidence": f"WITH {_EVIDENCE}, c AS (SELECT question_id, greatest(0.0, least(1.0, 0.1 + 0.25 * least(1.0, count(*) / 5.0) + 0.2 * avg(relevance) + 0.15 * (1 - least(1.0, coalesce(var_samp(relevance), 0.0))) + 0.15 * avg(credibility) + 0.1 * avg(authority))) AS c FROM evidence GROUP BY question_id) SELECT question_id, round(c, 6) AS confidence, round(greatest(0.0, c - 0.1), 6) AS low, round(least(1.0, c + 0.1), 6) AS high FROM c",
    "a59_uniqueness": "WITH k AS (SELECT DISTINCT l_suppkey AS node, l_partkey AS made FROM {lineitem}), u AS (SELECT node, made, count(*) OVER (PARTITION BY made) AS makers FROM k) SELECT node, round(count_if(makers = 1) / CAST(count(*) AS DOUBLE), 6) AS uniqueness FROM u GROUP BY node",
    # every supplier meets each of the 25 nations, which is what a cost matrix is
    "o4_fused_cost": "SELECT s, n, round(0.5 * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + 0.5 * (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 6) AS cost FROM (SELECT s_suppkey AS s, n_nationkey AS n, CAST(abs(s_nationkey - n_nationkey) AS DOUBLE) AS a, abs(s_acctbal - n_nationkey * 100) AS b FROM {supplier} CROSS JOIN {nation})",
    "stat_p15_leave_one_out": f"WITH {_PAIRS}, l AS (SELECT kind, ((sum(truth) OVER p) - truth) / ((count(*) OVER p) - 1) AS loo, avg(truth) OVER p AS whole FROM pairs WINDOW p AS (PARTITION BY kind)) SELECT kind, round(max(whole) + MEDIAN_AT(loo - whole, 0.05), 9) AS low, round(max(whole) + MEDIAN_AT(loo - whole, 0.95), 9) AS high FROM l GROUP BY kind",
    "stat_p16_certificates": f"WITH {_PAIRS} SELECT kind, CAST(count(*) AS BIGINT) AS n, round(avg(abs(truth - predicted)), 6) AS risk, avg(abs(truth - predicted)) + sqrt(ln(20) / (2 * count(*))) <= 0.5 AS valid FROM pairs GROUP BY kind",
    "stat_p18_penalised": f"WITH {_POINTS} SELECT document, round(greatest(0.0, avg(score) - 0.1 * count_if(score < 0.25) - 0.05 * (4 - max(dimensions))), 6) AS predicted FROM points GROUP BY document",
    "stat_p9_prediction_sets": f"WITH {_SCORED}, c AS (SELECT document, dimension, avg(1 - score) AS s FROM scored GROUP BY document, dimension), m AS (SELECT document, dimension, s, min(s) OVER (PARTITION BY document) AS best FROM c) SELECT document, dimension FROM m WHERE round(s, 9) <= 0.4 OR s = best",
    "stat_p21_bridge_effect": "WITH b AS (SELECT floor(l_discount * 50) AS proxy, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS treated, l_quantity AS y FROM {lineitem}), g AS (SELECT proxy, avg(CASE WHEN treated = 1 THEN y END) - avg(CASE WHEN treated = 0 THEN y END) AS effect, count(*) AS n FROM b GROUP BY proxy) SELECT round(sum(effect * n) / sum(n), 6) AS effect FROM g",
    "g9_adjustment": f"WITH {_LINKS}, k AS (SELECT a, b FROM links WHERE round(confidence, 9) >= 0.5) SELECT DISTINCT a AS node FROM k WHERE b = 7 EXCEPT SELECT b FROM k WHERE a = 7",
    "g12_edges": f"WITH {_LINKS} SELECT a, b, round(confidence, 6) AS confidence FROM links WHERE round(confidence, 9) >= 0.4 AND n >= 2 AND a < b",
    "g15_relations": "SELECT x, y, CAST(count(*) AS BIGINT) AS n FROM (SELECT UNNEST(FINDALL(content, 'La [A-Z][a-záéíóú]+')) AS x, chunk_id FROM {processed_chunk}) l JOIN (SELECT UNNEST(FINDALL(content, 'El [A-Z][a-záéíóú]+')) AS y, chunk_id FROM {processed_chunk}) r ON l.chunk_id = r.chunk_id GROUP BY x, y",
    "g18_causal_patterns": "SELECT effect, cause, CAST(count(*) AS BIGINT) AS n FROM (SELECT PART1 AS effect, PART2 AS cause FROM {processed_chunk}) WHERE effect <> '' AND cause <> '' GROUP BY effect, cause",
    "h2_ranked": "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS BIGINT) AS place, coalesce(o_totalprice = lag(o_totalprice) OVER (ORDER BY o_totalprice DESC, o_orderkey), false) AS tied FROM {orders}",
    "h5_salted": "SELECT c_custkey, SHA(concat('salt|', c_name, '|', CAST(c_nationkey AS STRING))) AS hash FROM {customer}",
    "h13_derivations": "SELECT chunk_id, provenance.source_hash AS parent, md5(concat(coalesce(provenance.source_hash, ''), '|', content)) AS hash FROM (SELECT chunk_id, provenance, content, row_number() OVER (PARTITION BY chunk_id ORDER BY row_id) AS place FROM {processed_chunk}) WHERE place = 1",
    "h14_simplex": "WITH s AS (SELECT o_custkey, o_orderkey, v, sum(v) OVER w AS total, row_number() OVER w AS place FROM (SELECT o_custkey, o_orderkey, o_totalprice / 200000 AS v FROM {orders}) WINDOW w AS (PARTITION BY o_custkey ORDER BY v DESC, o_orderkey)), t AS (SELECT o_custkey, max(CASE WHEN v - (total - 1) / place > 0 THEN place END) AS rho FROM s GROUP BY o_custkey), c AS (SELECT s.o_custkey, (total - 1) / place AS theta FROM s JOIN t ON s.o_custkey = t.o_custkey AND place = rho) SELECT o_orderkey, round(greatest(0.0, v - theta), 6) AS weight FROM s JOIN c ON s.o_custkey = c.o_custkey",
    "h19_conditions": "SELECT l_orderkey, bool_and(l_quantity > 1) AND bool_or(l_discount > 0.05) AS holds FROM {lineitem} GROUP BY l_orderkey",
    "m12_bus": f"WITH {_METRICS} SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM m WHERE value > 10) WHERE place <= 1000",
    "m19_cooldown": f"WITH {_METRICS}, h AS (SELECT CAST(floor(UNIX(ts) / 3600) AS BIGINT) AS hour, avg(value) AS v FROM m GROUP BY CAST(floor(UNIX(ts) / 3600) AS BIGINT)), a AS (SELECT hour, v, lag(hour) OVER (ORDER BY hour) AS before_hour FROM h WHERE v > 20) SELECT hour, round(v, 6) AS v FROM a WHERE before_hour IS NULL OR hour - before_hour >= 2",
    "m22_categories": f"WITH {_METRICS} SELECT CASE WHEN event_type LIKE '%error%' THEN 'failure' WHEN value > 90 THEN 'slow' ELSE 'normal' END AS category, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1",
    "s8_features": "SELECT hash, word, n FROM (SELECT md5(text) AS hash, word, CAST(count(*) AS BIGINT) AS n FROM (SELECT text, UNNEST(WORDS(text)) AS word FROM {documents}) GROUP BY md5(text), word)",
    "s10_postings": f"WITH {_POSTINGS} SELECT t.word, t.doc_id, tf, dl FROM t JOIN d ON t.doc_id = d.doc_id",
    "s20_report": f"WITH {_POINTS} SELECT cluster, concat('# Cluster ', CAST(cluster AS STRING), chr(10), '- puntos: ', CAST(count(*) AS STRING)) AS markdown FROM points GROUP BY cluster",
    "x_answers": f"WITH {_ANSWERS} SELECT cluster, dimension, CAST(count(*) AS BIGINT) AS n FROM answers GROUP BY ROLLUP (cluster, dimension)",
}


def _own(sql: str, engine: int) -> str:
    for i in (1, 2):
        pattern = "depende (?:del|de la) ([a-záéíóúñ]+)" if i == 2 else "que (?:el|la) ([a-záéíóúñ]+)"
        sql = sql.replace(f"PART{i}", f"regexp_extract(content, '{pattern}', 1)")
    return sql


QUERIES = build({k: _own(v, 0) for k, v in SHARED.items()})[0]
ORACLES = build({k: _own(v, 1) for k, v in SHARED.items()})[1]
QUERIES["r25_pattern_matches"] = spark_query(_PHRASES)
ORACLES["r25_pattern_matches"] = r"""WITH m AS (SELECT mapping_id, lower(question_text) AS line FROM question_mapping), k AS (SELECT kw_id, lower(keyword) AS phrase FROM keyword_lexicon WHERE regexp_matches(keyword, '[\p{L}\p{N}_]'))
    SELECT mapping_id, kw_id, CASE WHEN contains(' ' || line || ' ', ' ' || phrase || ' ') THEN 1.0 ELSE 0.95 END::DOUBLE AS score FROM m, k
    WHERE regexp_matches(regexp_replace(line, '\s+', ' ', 'g'), '(^|[^\p{L}\p{N}_])' || regexp_escape(regexp_replace(phrase, '\s+', ' ', 'g')) || '($|[^\p{L}\p{N}_])')"""
del ORACLES["t14_fuzzy_sections"]  # DuckDB counts bytes in levenshtein, Spark characters; tested against brute force
