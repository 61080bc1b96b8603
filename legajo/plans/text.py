"""Text functions, chunking and lexical retrieval over documents and chunks."""

from __future__ import annotations

from legajo.plans.registry import build

# Stop words, certainty markers and classification keywords.
STOP = "'de','la','el','en','y','a','los','las','que','del','para','se','un','una','por','con','the','of','and','to','in','is'"
QUERY = "'agua','plan','derechos','mesa','víctimas'"

SHARED = {
    "t1_normalise": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(translate(text, '“”«»', '""""'), '[•▪·]', '-', 'g'), concat('-', chr(10)), ''), '[ \t]+', ' ', 'g'), '\n\n+', concat(chr(10), chr(10)), 'g')) AS clean FROM {documents}""",
    "t3_tokenise": "SELECT word, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM (SELECT doc_id, UNNEST(WORDS(text)) AS word FROM {documents}) GROUP BY word",
    "t4_alphabetic": "SELECT doc_id, CAST(LEN(FINDALL(text, '[a-zA-ZáéíóúñÁÉÍÓÚÑ]+')) AS BIGINT) AS words, CAST(LEN(DISTINCT_OF(FINDALL(text, '[a-zA-ZáéíóúñÁÉÍÓÚÑ]+'))) AS BIGINT) AS distinct_words FROM {documents}",
    "t5_sentences": "SELECT doc_id, CAST(count(*) AS BIGINT) AS sentences, CAST(max(length(s)) AS BIGINT) AS longest FROM (SELECT doc_id, UNNEST(SPLIT(text, '[.!?]+[ \\n]+')) AS s FROM {documents}) WHERE trim(s) <> '' GROUP BY doc_id",
    "t6_keywords": f"""SELECT doc_id, word, n, CAST(place AS BIGINT) AS place FROM (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS place FROM (
        SELECT doc_id, word, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, UNNEST(WORDS(text)) AS word FROM {{documents}}) WHERE length(word) > 2 AND word NOT IN ({STOP}) GROUP BY doc_id, word)) WHERE place <= 10""",
    "t7_metrics": "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(length(replace(text, ' ', '')) AS BIGINT) AS solid, CAST(LEN(WORDS(text)) AS BIGINT) AS words, CAST(LEN(SPLIT(text, '\\n')) AS BIGINT) AS lines, CAST(LEN(SPLIT(text, '\\n\\n')) AS BIGINT) AS paragraphs FROM {documents}",
    "t9_tf_vectors": """SELECT doc_id, word, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM (SELECT doc_id, word, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, UNNEST(WORDS(text)) AS word FROM {documents})
        WHERE word IN (SELECT word FROM (SELECT word, row_number() OVER (ORDER BY df DESC, word) AS place FROM (SELECT word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, UNNEST(WORDS(text)) AS word FROM {documents}) GROUP BY word)) WHERE place <= 1000) GROUP BY doc_id, word)""",
    "t11_metadata_flags": "SELECT doc_id, 1 - ((CASE WHEN lang IS NULL THEN 1 ELSE 0 END) + (CASE WHEN source IS NULL THEN 1 ELSE 0 END) + (CASE WHEN municipality_code IS NULL THEN 1 ELSE 0 END) + (CASE WHEN n_chars IS NULL THEN 1 ELSE 0 END)) / CAST(4 AS DOUBLE) AS completeness FROM {documents}",
    "t12_snippet": "SELECT doc_id, substr(text, CAST(greatest(1, strpos_at - 100) AS INT), 300) AS snippet FROM (SELECT doc_id, text, CAST(instr(lower(text), 'agua') AS INT) AS strpos_at FROM {documents}) WHERE strpos_at > 0",
    "t13_jaccard": """SELECT a.mapping_id AS id_a, b.mapping_id AS id_b, round(LEN(INTERSECT_OF(a.w, b.w)) / CAST(LEN(a.w) + LEN(b.w) - LEN(INTERSECT_OF(a.w, b.w)) AS DOUBLE), 6) AS jaccard
        FROM (SELECT mapping_id, question_id, DISTINCT_OF(WORDS(question_text)) AS w FROM {question_mapping}) a JOIN (SELECT mapping_id, question_id, DISTINCT_OF(WORDS(question_text)) AS w FROM {question_mapping}) b ON a.question_id = b.question_id AND a.mapping_id < b.mapping_id WHERE LEN(a.w) + LEN(b.w) > 0""",
    "t15_stable_id": "SELECT doc_id, concat('doc_', substr(SHA(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g'))), 1, 16)) AS stable_id FROM {documents}",
    "t17_responses": "SELECT event_id, CASE WHEN lower(event_type) IN ('view', 'click') THEN 'Sí' WHEN lower(event_type) IN ('add_to_cart', 'search') THEN 'Parcial' WHEN event_type IS NULL THEN 'NI' ELSE 'No' END AS response FROM {events}",
    "t18_clamp": "SELECT l_orderkey, l_linenumber, greatest(0.0, least(1.0, l_discount * 15 - 0.2)) AS clamped FROM {lineitem}",
    "t19_content_class": """SELECT doc_id, CASE WHEN tables > 0.1 * lines THEN 'table' WHEN lists > 0.05 * lines THEN 'list' WHEN words < 50 THEN 'short' WHEN words > 1000 THEN 'long' ELSE 'text' END AS class FROM (
        SELECT doc_id, LEN(WORDS(text)) AS words, LEN(SPLIT(text, '\\n')) AS lines, LEN(FINDALL(text, '[|;].*[|;]')) AS tables, LEN(FINDALL(text, '(^|\\n)[-*0-9]+[.)] ')) AS lists FROM {documents})""",
    "t20_temporal": "SELECT doc_id, year, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, UNNEST(FINDALL(text, '(?:19|20)[0-9][0-9]')) AS year FROM {documents}) GROUP BY doc_id, year",
    "c6_page_anchor": "SELECT chunk_id, CAST(floor(min(start_at) / 2000) + 1 AS BIGINT) AS page FROM (SELECT chunk_id, provenance.character_offsets[OFFSET0] AS start_at FROM {processed_chunk}) WHERE start_at IS NOT NULL GROUP BY chunk_id",
    "r1_bm25": f"""WITH t AS (SELECT doc_id, word, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, UNNEST(WORDS(text)) AS word FROM {{documents}}) GROUP BY doc_id, word),
        d AS (SELECT doc_id, sum(tf) AS dl FROM t GROUP BY doc_id), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
        f AS (SELECT word, count(*) AS df FROM t WHERE word IN ({QUERY}) GROUP BY word)
        SELECT doc_id, score FROM (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM (
          SELECT t.doc_id, round(sum(ln((s.n - f.df + 0.5) / (f.df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM t JOIN f ON t.word = f.word JOIN d ON t.doc_id = d.doc_id CROSS JOIN s GROUP BY t.doc_id)) WHERE place <= 10""",
    "r2_inverted_index": "SELECT word, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(tf) AS BIGINT) AS max_tf FROM (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, UNNEST(WORDS(text)) AS word FROM {documents}) GROUP BY doc_id, word) GROUP BY word",
    "r3_fielded_search": "SELECT mapping_id, dimension, sector FROM {question_mapping} WHERE (lower(question_text) LIKE '%agua%' OR lower(point_name) LIKE '%agua%') AND dimension IN ('DE-1', 'DE-2') AND sector IS NOT NULL",
    "r4_upsert": "SELECT chunk_id, row_id, received_at FROM (SELECT chunk_id, row_id, received_at, row_number() OVER (PARTITION BY chunk_id ORDER BY received_at DESC, row_id DESC) AS place FROM {processed_chunk}) WHERE place = 1",
    "r7_normalise_scores": "SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER p) / (max(o_totalprice) OVER p - min(o_totalprice) OVER p), 6) AS min_max, round((o_totalprice - avg(o_totalprice) OVER p) / stddev_pop(o_totalprice) OVER p, 6) AS z, round(o_totalprice / sqrt(sum(o_totalprice * o_totalprice) OVER p), 6) AS l2 FROM {orders} WINDOW p AS (PARTITION BY o_orderpriority)",
    "r8_rrf": """SELECT p_partkey, round(sum(CAST(1 AS DOUBLE) / (60 + place)), 9) AS rrf FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM {part} UNION ALL SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place FROM {part}) GROUP BY p_partkey""",
    "r10_softmax": "SELECT o_orderkey, round(exp((o_totalprice - max(o_totalprice) OVER p) / 50000.0) / sum(e) OVER p, 9) AS calibrated FROM (SELECT o_orderkey, o_custkey, o_totalprice, exp((o_totalprice - max(o_totalprice) OVER (PARTITION BY o_custkey)) / 50000.0) AS e FROM {orders}) WINDOW p AS (PARTITION BY o_custkey)",
    "r12_rank_correlation": "SELECT o_orderpriority, CAST(max(n) AS BIGINT) AS n, round(CASE WHEN max(n) < 2 THEN 0.0 ELSE 1 - 6 * sum(power(a - b, 2)) / (max(n) * (power(max(n), 2) - 1)) END, 6) AS rho FROM (SELECT o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS DOUBLE) AS a, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) AS DOUBLE) AS b, CAST(count(*) OVER (PARTITION BY o_orderpriority) AS DOUBLE) AS n FROM {orders}) GROUP BY o_orderpriority",
    "r13_fusion": """SELECT coalesce(a.k, b.k, c.k) AS item, round(0.5 * coalesce(a.s, 0) + 0.3 * coalesce(b.s, 0) + 0.2 * coalesce(c.s, 0), 6) AS score FROM (SELECT o_custkey AS k, avg(o_totalprice) / 500000 AS s FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey) a
        FULL JOIN (SELECT o_custkey AS k, count(*) / 100.0 AS s FROM {orders} WHERE o_orderstatus = 'O' GROUP BY o_custkey) b ON a.k = b.k FULL JOIN (SELECT c_custkey AS k, c_acctbal / 10000 AS s FROM {customer}) c ON coalesce(a.k, b.k) = c.k""",
    "r14_exclusions": "SELECT mapping_id, dimension, sector, weight FROM {question_mapping} WHERE NOT (coalesce(dimension = 'DE-4', false) OR coalesce(sector IN ('salud', 'paz'), false) OR coalesce(weight < 0.5, false))",
    "r15_hash_dedup": "SELECT hash, doc_id FROM (SELECT md5(text) AS hash, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY length(text) DESC, doc_id) AS place FROM {documents}) WHERE place = 1",
    "r16_snapshot_id": "SELECT substr(SHA(JOINED(SORTED(COLLECT(hash)), '|')), 1, 16) AS snapshot, CAST(count(*) AS BIGINT) AS buckets FROM (SELECT bucket, md5(JOINED(SORTED(COLLECT(h)), '|')) AS hash FROM (SELECT substr(md5(text), 1, 2) AS bucket, md5(text) AS h FROM {documents}) GROUP BY bucket)",
    "r21_entropy_kl": """WITH p AS (SELECT o_orderpriority AS k, count(*) / sum(count(*)) OVER () AS p FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_orderpriority), q AS (SELECT o_orderpriority AS k, count(*) / sum(count(*)) OVER () AS q FROM {orders} WHERE o_orderstatus = 'O' GROUP BY o_orderpriority)
        SELECT round(-sum(p * ln(p) / ln(2)), 6) AS entropy, round(sum(p * ln((p + 1e-12) / (q + 1e-12)) / ln(2)), 6) AS kl, round(0.5 * sum(abs(p - q)), 6) AS half_l1 FROM p JOIN q ON p.k = q.k""",
    "r24_patterns": "SELECT doc_id, pattern, CAST(count(*) AS BIGINT) AS hits FROM (SELECT doc_id, 'money' AS pattern, UNNEST(FINDALL(text, '[$] ?[0-9][0-9.]*')) AS hit FROM {documents} UNION ALL SELECT doc_id, 'percent' AS pattern, UNNEST(FINDALL(text, '[0-9]+[.,]?[0-9]* ?%')) AS hit FROM {documents}) GROUP BY doc_id, pattern",
    "r26_risk_filter": "SELECT o_orderkey, s FROM (SELECT o_orderkey, s, row_number() OVER (PARTITION BY g ORDER BY s, o_orderkey) - 1 AS place, least(n - 1, CAST(ceil((n + 1) * 0.9) AS BIGINT)) AS cut FROM (SELECT o_orderkey, o_custkey AS g, round(o_totalprice - ((sum(o_totalprice) OVER p) - o_totalprice) / ((count(*) OVER p) - 1), 3) AS s, count(*) OVER p AS n FROM {orders} WINDOW p AS (PARTITION BY o_custkey)) WHERE n > 1) WHERE place <= cut",
    "r30_repeated_evidence": "SELECT hash, CAST(n AS BIGINT) AS n, keeper FROM (SELECT md5(lower(trim(text))) AS hash, count(*) AS n, min(doc_id) AS keeper FROM {documents} GROUP BY md5(lower(trim(text)))) WHERE n > 1",
}


def _own(sql: str, engine: int) -> str:
    """Positions within arrays, which the engines enumerate in their own ways."""
    placed = ("posexplode(WORDS(text)) AS (place, word)", "unnest(range(len(WORDS(text)))) AS place, unnest(WORDS(text)) AS word")[engine]
    return sql.replace("PLACED_WORDS", placed).replace("OFFSET0", "01"[engine])


QUERIES = build({k: _own(v, 0) for k, v in SHARED.items()})[0]
ORACLES = build({k: _own(v, 1) for k, v in SHARED.items()})[1]
