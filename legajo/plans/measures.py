"""Text measures, citations, rerankings, resampling and classification scores, each with a twin written apart from it.

The Spark side works on whole arrays of a row or with an operator; the SQL side
unnests, so that an error of one is not an error of the other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.functions.session import cut_table, table
from legajo.operators.lineage import broken_links
from legajo.operators.ranks import order_statistics, places
from legajo.operators.vectors import top_similar

#: The words of the flagship query.
QUERY_WORDS = "agua plan derechos mesa víctimas".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query by its function's name, with its SQL twin."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def _count(text: str | Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


_DUCK_WORDS = r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents"

# ---- text -----------------------------------------------------------------------------------


@query(rf"""
    WITH t AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS letters, count(*) FILTER (length(w) >= 7) AS long FROM ({_DUCK_WORDS}) GROUP BY doc_id)
    SELECT d.doc_id, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text)::DOUBLE, 6) AS digits, round(length(regexp_replace(text, '[^.,;:!?]', '', 'g')) / length(text)::DOUBLE, 6) AS marks,
        round(length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) / length(text)::DOUBLE, 6) AS capitals, round(length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / length(text)::DOUBLE, 6) AS beyond_ascii,
        round(coalesce(letters / n::DOUBLE, 0), 6) AS word_length, round(coalesce(long / n::DOUBLE, 0), 6) AS long_words
    FROM documents d LEFT JOIN t USING (doc_id) WHERE length(text) > 0""")
def t8_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of digits, marks, capitals and characters beyond ASCII; mean word length and share of words of seven letters and more."""
    base = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "text", words("text").alias("w"))
    share = lambda pattern: F.round(_count("text", pattern) / F.length("text"), 6)
    many = F.size("w").cast("double")
    length = F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x))
    mean = lambda c: F.round(F.coalesce(F.try_divide(c, many), F.lit(0.0)), 6)
    return base.select("doc_id", share("[0-9]").alias("digits"), share("[.,;:!?]").alias("marks"), share(r"\p{Lu}").alias("capitals"), share(r"[^\x00-\x7F]").alias("beyond_ascii"), mean(length).alias("word_length"), mean(F.size(F.filter("w", lambda x: F.length(x) >= 7))).alias("long_words"))


@query(rf"""
    WITH s AS ({_DUCK_WORDS}),
    v AS (SELECT doc_id, w, greatest(1, len(regexp_extract_all(w, '[aeiouáéíóúü]+'))) AS syllables FROM s),
    t AS (SELECT doc_id, count(*)::DOUBLE AS n, sum(length(w))::DOUBLE AS chars, count(DISTINCT w) AS kinds, sum(syllables)::DOUBLE AS syl, count(*) FILTER (syllables >= 3)::DOUBLE AS complex FROM v GROUP BY doc_id),
    d AS (SELECT doc_id, n, chars, kinds, syl, complex, greatest(1, len(regexp_extract_all(text, '[.!?]+')))::DOUBLE AS sent FROM t JOIN documents USING (doc_id))
    SELECT doc_id, round(n / sent, 6) AS sentence_length, round(kinds / n, 6) AS type_token, round(4.71 * chars / n + 0.5 * n / sent - 21.43, 6) AS ari, round(0.0588 * 100 * chars / n - 0.296 * 100 * sent / n - 15.8, 6) AS coleman_liau,
        round(206.835 - 1.015 * n / sent - 84.6 * syl / n, 6) AS flesch, round(0.39 * n / sent + 11.8 * syl / n - 15.59, 6) AS kincaid, round(0.4 * (n / sent + 100 * complex / n), 6) AS fog, round(1.043 * sqrt(complex * 30 / sent) + 3.1291, 6) AS smog FROM d""")
def t8b_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability of texts with words; a syllable is a run of vowels, at least one for each word."""
    base = table(spark, sf_dir, "documents").select("doc_id", words("text").alias("w"), F.greatest(F.lit(1.0), _count("text", "[.!?]+")).alias("sent")).where("size(w) > 0")
    base = base.withColumn("v", F.transform("w", lambda x: F.greatest(F.lit(1), F.regexp_count(x, F.lit("[aeiouáéíóúü]+")))))
    base = base.select("doc_id", "sent", F.size("w").cast("double").alias("n"), F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)).alias("chars"), F.size(F.array_distinct("w")).alias("kinds"), F.aggregate("v", F.lit(0), lambda a, x: a + x).alias("syl"), F.size(F.filter("v", lambda x: x >= 3)).alias("complex"))
    per, asl = F.col("chars") / F.col("n"), F.col("n") / F.col("sent")
    forms = {
        "sentence_length": asl, "type_token": F.col("kinds") / F.col("n"), "ari": 4.71 * per + 0.5 * asl - 21.43, "coleman_liau": 5.88 * per - 29.6 / asl - 15.8,
        "flesch": 206.835 - 1.015 * asl - 84.6 * F.col("syl") / F.col("n"), "kincaid": 0.39 * asl + 11.8 * F.col("syl") / F.col("n") - 15.59, "fog": 0.4 * (asl + 100 * F.col("complex") / F.col("n")), "smog": 1.043 * F.sqrt(30 * F.col("complex") / F.col("sent")) + 3.1291,
    }
    return base.select("doc_id", *[F.round(v, 6).alias(k) for k, v in forms.items()])


# A few stop words of each language.
STOP_WORDS = {"es": "el los las del y en por con una según", "en": "the of and in to was for from with is", "pt": "o os do da em não foi uma com segundo", "fr": "le les des du et est une dans selon au", "ru": "и в на не по с для до к без", "hi": "का के की में को ने है पर और से", "ar": "في من على إلى لا أن إن متى قال دون"}
_STOP_ROWS = ", ".join(f"('{lang}', '{w}')" for lang, own in STOP_WORDS.items() for w in own.split())


@query(rf"""
    WITH h AS (SELECT doc_id, s.lang, count(*) AS hits FROM ({_DUCK_WORDS}) JOIN (VALUES {_STOP_ROWS}) s(lang, w) USING (w) GROUP BY ALL),
    p AS (SELECT doc_id, lang, hits / sum(hits) OVER (PARTITION BY doc_id) AS share FROM h)
    SELECT doc_id, lang, round(share, 6) AS probability FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, lang) <= 3""")
def t8c_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three likeliest languages of each text by hits of stop words; texts without a hit have none."""
    counted = table(spark, sf_dir, "documents").select("doc_id", words("text").alias("w"))

    def among(own: str) -> Column:
        return F.size(F.filter("w", lambda x: x.isin(*own.split()))).cast("double")

    hits = F.array(*[F.struct(F.lit(lang).alias("lang"), among(own).alias("hits")) for lang, own in sorted(STOP_WORDS.items())])
    scored = counted.select("doc_id", F.filter(hits, lambda s: s["hits"] > 0).alias("found")).withColumn("total", F.aggregate("found", F.lit(0.0), lambda a, s: a + s["hits"]))
    best = F.slice(F.array_sort("found", lambda a, b: F.when(a["hits"] != b["hits"], F.signum(b["hits"] - a["hits"]).cast("int")).when(a["lang"] < b["lang"], -1).otherwise(1)), 1, 3)
    return scored.select("doc_id", "total", F.explode(best).alias("s")).select("doc_id", "s.lang", F.round(F.col("s.hits") / F.col("total"), 6).alias("probability"))


@query(r"""
    WITH g AS (SELECT doc_id, regexp_extract_all(text, '[ \t\n\r]*[^ \t\n\r]+') AS parts FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS place FROM g),
    l AS (SELECT *, length(part) AS size, length(ltrim(part, chr(32) || chr(9) || chr(10) || chr(13))) AS own FROM u)
    SELECT doc_id, place::INTEGER AS place, (sum(size) OVER w - own)::INTEGER AS raw_start, (sum(own + 1) OVER w - own - 1)::INTEGER AS new_start, own::INTEGER AS size FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY place)""")
def t2_offset_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, place, raw_start, new_start, size): where each run of visible characters stands in the text and in the text with single blanks."""
    base = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")

    def starts(texts: pa.Array) -> pa.Array:
        import re

        run = re.compile(r"[^ \t\n\r]+")
        found, offsets = ([], [], []), [0]
        for text in texts.to_pylist():
            new = 0
            for m in run.finditer(text):
                size = m.end() - m.start()
                for column, value in zip(found, (m.start(), new, size), strict=True):
                    column.append(value)
                new += size + 1
            offsets.append(len(found[0]))
        rows = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in found], names=["raw_start", "new_start", "size"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    mapped = base.select("doc_id", F.posexplode(F.arrow_udf(starts, "array<struct<raw_start int, new_start int, size int>>")("text")).alias("place", "at"))
    return mapped.select("doc_id", "place", "at.raw_start", "at.new_start", "at.size")


@query(r"""
    SELECT doc_id, concat(coalesce(source, 'Unknown Author'), ' (', coalesce(strftime(published_at, '%Y'), 'n.d.'), '). ', string_split(text, chr(10))[1], '.') AS apa,
        concat(coalesce(source, 'Unknown Author'), '. "', string_split(text, chr(10))[1], '." ', coalesce(strftime(published_at, '%d %b %Y'), 'n.d.'), '.') AS mla FROM documents WHERE text IS NOT NULL""")
def t16_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in both styles; the first line is the title."""
    author, title = F.coalesce("source", F.lit("Unknown Author")), F.substring_index("text", "\n", 1)
    dated = lambda form: F.coalesce(F.date_format("published_at", form), F.lit("n.d."))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(author, F.lit(" ("), dated("yyyy"), F.lit("). "), title, F.lit(".")).alias("apa"), F.concat(author, F.lit('. "'), title, F.lit('." '), dated("dd MMM yyyy"), F.lit(".")).alias("mla"))


@query(r"""
    WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, any_value(text) AS text, count(*)::DOUBLE AS lines, count(*) FILTER (contains(line, '|') OR contains(line, chr(9))) AS tables, count(*) FILTER (regexp_matches(line, '^ *([-*•]|[0-9]+[.)]) ')) AS lists FROM l GROUP BY doc_id)
    SELECT doc_id, contains(text, 'rn') AS merged, length(text) - length(replace(text, '|', '')) > length(text) / 100.0 AS pipes, length(text) - length(replace(text, '1', '')) > length(text) / 50.0 AS ones, tables > 0.1 * lines AS tabular, lists > 0.05 * lines AS listed FROM c""")
def t19_content_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of character recognition, tables and lists."""
    base = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.split("text", "\n", -1).alias("l"))
    lines = F.size("l")
    tables = F.size(F.filter("l", lambda x: x.rlike(r"[|\t]")))
    lists = F.size(F.filter("l", lambda x: x.rlike(r"^ *(?:[-*•]|[0-9]+[.)]) ")))
    return base.select("doc_id", F.contains("text", F.lit("rn")).alias("merged"), (_count("text", r"\|") > F.length("text") / 100).alias("pipes"), (_count("text", "1") > F.length("text") / 50).alias("ones"), (tables > 0.1 * lines).alias("tabular"), (lists > 0.05 * lines).alias("listed"))


_MONTHS = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
_PHRASES = "primer semestre|segundo semestre|último año|cuatrienio|vigencia|bienio"


@query(rf"""
    WITH u AS (SELECT doc_id, 'year' AS kind, unnest(regexp_extract_all(text, '(?:19|20)[0-9][0-9]')) AS found FROM documents UNION ALL SELECT doc_id, 'quarter', unnest(regexp_extract_all(lower(text), 'trimestre')) FROM documents
        UNION ALL SELECT doc_id, 'month', unnest(regexp_extract_all(lower(text), '{_MONTHS}')) FROM documents UNION ALL SELECT doc_id, 'phrase', unnest(regexp_extract_all(lower(text), '{_PHRASES}')) FROM documents)
    SELECT doc_id, kind, found, count(*) AS n FROM u GROUP BY ALL""")
def t20_temporal_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, quarters, months and phrases of time, with their number."""
    kinds = {"year": ("text", "((?:19|20)[0-9][0-9])"), "quarter": (F.lower("text"), "(trimestre)"), "month": (F.lower("text"), f"({_MONTHS})"), "phrase": (F.lower("text"), f"({_PHRASES})")}

    def marked(kind: str, text: str | Column, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("found")))

    found = F.concat(*[marked(k, c, p) for k, (c, p) in kinds.items()])
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("m")).groupBy("doc_id", "m.kind", "m.found").agg(F.count("*").alias("n"))


# Words left out of a comparison.
_IGNORED = "'de', 'la', 'el', 'los', 'las', 'en', 'y', 'a', 'del', 'que', 'se', 'por', 'con', 'para', 'un', 'una', 'lo', 'su'"


def _question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one question, held against each other once: (id_a, id_b, a, b) of words in their order."""
    own = table(spark, sf_dir, "question_mapping").where("question_text is not null").select("mapping_id", "question_id", words("question_text").alias("w"))
    other = own.select(F.col("mapping_id").alias("id_b"), "question_id", F.col("w").alias("b"))
    return own.withColumnsRenamed({"mapping_id": "id_a", "w": "a"}).join(other, "question_id").where("id_a < id_b").select("id_a", "id_b", "a", "b")


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(both, F.size(F.array_union(a, b))), F.lit(0.0))


def _couples(w: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get(w, i), x)))


@query(rf"""
    WITH w AS (SELECT mapping_id, question_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM (SELECT mapping_id, question_id, regexp_extract_all(lower(question_text), '[\p{{L}}\p{{N}}_]+') AS t FROM question_mapping WHERE question_text IS NOT NULL)),
    pairs AS (SELECT a.mapping_id AS id_a, b.mapping_id AS id_b FROM question_mapping a JOIN question_mapping b ON a.question_id = b.question_id AND a.mapping_id < b.mapping_id WHERE a.question_text IS NOT NULL AND b.question_text IS NOT NULL),
    one AS (SELECT DISTINCT mapping_id, w FROM w WHERE w NOT IN ({_IGNORED})), two AS (SELECT DISTINCT x.mapping_id, x.w || ' ' || y.w AS w FROM w x JOIN w y ON x.mapping_id = y.mapping_id AND y.i = x.i + 1),
    j AS (SELECT id_a, id_b, count(*) FILTER (n = 2) / count(*)::DOUBLE AS j FROM (SELECT id_a, id_b, w, count(*) AS n FROM (SELECT id_a, id_b, w FROM pairs JOIN one ON mapping_id = id_a UNION ALL SELECT id_a, id_b, w FROM pairs JOIN one ON mapping_id = id_b) GROUP BY ALL) GROUP BY ALL),
    k AS (SELECT id_a, id_b, count(*) FILTER (n = 2) / count(*)::DOUBLE AS k FROM (SELECT id_a, id_b, w, count(*) AS n FROM (SELECT id_a, id_b, w FROM pairs JOIN two ON mapping_id = id_a UNION ALL SELECT id_a, id_b, w FROM pairs JOIN two ON mapping_id = id_b) GROUP BY ALL) GROUP BY ALL)
    SELECT id_a, id_b, round(coalesce(j, 0), 6) AS jaccard, round(coalesce(k, 0), 6) AS bigrams FROM pairs LEFT JOIN j USING (id_a, id_b) LEFT JOIN k USING (id_a, id_b)""")
def t21_bigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and word-pair overlap of texts of one question; pairs of words in their order."""
    kept = lambda c: F.filter(c, lambda x: ~x.isin(*[w.strip(" '") for w in _IGNORED.split(",")]))
    return _question_pairs(spark, sf_dir).select("id_a", "id_b", F.round(_jaccard(kept("a"), kept("b")), 6).alias("jaccard"), F.round(_jaccard(_couples(F.col("a")), _couples(F.col("b"))), 6).alias("bigrams"))


#: Pairs of texts whose scores a join may broadcast.
BROADCAST_PAIRS = 2_000_000
#: Parts of the pairs of one question, and tasks for all of them.
PARTS, TASKS = 8, 96


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; the row of the usual table is one number, a bit for each place of ``b`` that doesn't add one."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        met = row & places.get(x, 0)
        row = (row + met | row - met) & full
    return len(b) - row.bit_count()


def _lexical(a: str, b: str) -> Column:
    """Half word overlap, three tenths pairs of words, two tenths the longest common subsequence."""

    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([2.0 * longest_common(x, y) / (len(x) + len(y)) if x or y else 0.0 for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    kept = lambda c: F.filter(c, lambda x: ~x.isin(*[w.strip(" '") for w in _IGNORED.split(",")]))
    return F.round(0.5 * _jaccard(kept(a), kept(b)) + 0.3 * _jaccard(_couples(F.col(a)), _couples(F.col(b))) + 0.2 * F.arrow_udf(common, "double")(a, b), 6)


def _dealt_pairs(own: DataFrame, text: str) -> DataFrame:
    """(id_a, id_b, a, b) of the rows (mapping_id, question_id, text) of one question; a question's pairs are dealt to several tasks, however few bytes its rows have."""
    part = F.pmod(F.xxhash64("mapping_id"), F.lit(PARTS)).cast("int")
    left = own.select("question_id", part.alias("part"), F.col("mapping_id").alias("id_a"), F.col(text).alias("a")).repartition(TASKS, "question_id", "part")
    right = own.select("question_id", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.col("mapping_id").alias("id_b"), F.col(text).alias("b")).repartition(TASKS, "question_id", "part")
    return left.join(right.hint("merge"), ["question_id", "part"]).where("id_a < id_b").select("id_a", "id_b", "a", "b")


@query()
def t21_lexical_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half word overlap, three tenths pairs of words, two tenths the longest common subsequence.

    Texts recur under many ids; where there are few, each two of them are scored once.
    """
    own = table(spark, sf_dir, "question_mapping").where("question_text is not null").select("mapping_id", "question_id", words("question_text").alias("w"))
    texts = cut_table(own.select("w").distinct())
    n = texts.count()
    if n * (n + 1) // 2 > BROADCAST_PAIRS:
        return _dealt_pairs(own, "w").select("id_a", "id_b", _lexical("a", "b").alias("similarity"))
    texts = cut_table(texts.coalesce(1).select("w", F.monotonically_increasing_id().alias("t")))
    place = F.greatest("a", "b") * (F.greatest("a", "b") + 1) / 2 + F.least("a", "b")
    each = texts.repartition(TASKS, "t").select(F.col("w").alias("x"), F.col("t").alias("a")).join(F.broadcast(texts.select(F.col("w").alias("y"), F.col("t").alias("b"))), F.col("b") <= F.col("a"))
    scores = cut_table(each.select(place.cast("bigint").alias("place"), _lexical("x", "y").alias("similarity")))
    numbered = cut_table(own.join(F.broadcast(texts), "w").select("mapping_id", "question_id", "t"))
    pairs = _dealt_pairs(numbered, "t").select("id_a", "id_b", place.cast("bigint").alias("place"))
    return pairs.join(F.broadcast(scores), "place").select("id_a", "id_b", "similarity")


_ASKING = "qué cuál cuánto cuánta cómo dónde quién cuándo existe incluye define".split()


@query(rf"""
    WITH t AS (SELECT mapping_id, lower(question_text) AS q, lower(point_name) AS p FROM question_mapping WHERE question_text IS NOT NULL AND point_name IS NOT NULL),
    w AS (SELECT mapping_id, count(*) FILTER (n = 2) / count(*)::DOUBLE AS words FROM (SELECT mapping_id, w, count(*) AS n FROM (SELECT DISTINCT mapping_id, 1 AS side, unnest(regexp_extract_all(q, '[\p{{L}}\p{{N}}_]+')) AS w FROM t UNION ALL SELECT DISTINCT mapping_id, 2, unnest(regexp_extract_all(p, '[\p{{L}}\p{{N}}_]+')) FROM t) GROUP BY ALL) GROUP BY mapping_id),
    k AS (SELECT mapping_id, count(*) FILTER (contains(q, f) AND contains(p, f)) / nullif(count(*) FILTER (contains(q, f) OR contains(p, f)), 0)::DOUBLE AS forms FROM t, (SELECT unnest(string_split('{" ".join(_ASKING)}', ' ')) AS f) GROUP BY mapping_id)
    SELECT mapping_id, round(0.7 * coalesce(words, 0) + 0.3 * coalesce(forms, 0), 6) AS alignment FROM t LEFT JOIN w USING (mapping_id) LEFT JOIN k USING (mapping_id)""")
def t22_syntactic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven tenths word overlap, three tenths overlap of the forms of asking."""
    forms = lambda c: F.filter(F.array(*map(F.lit, _ASKING)), lambda f: F.contains(F.lower(c), f))
    base = table(spark, sf_dir, "question_mapping").where("question_text is not null and point_name is not null")
    return base.select("mapping_id", F.round(0.7 * _jaccard(words("question_text"), words("point_name")) + 0.3 * _jaccard(forms("question_text"), forms("point_name")), 6).alias("alignment"))


@query(r"""
    WITH t AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS w FROM documents)),
    g AS (SELECT doc_id, i // 128 AS chunk, count(*) AS tokens, string_agg(w, ' ' ORDER BY i) AS text, any_value(n) AS n FROM t GROUP BY doc_id, i // 128)
    SELECT doc_id, chunk::INTEGER AS chunk, tokens::INTEGER AS tokens, text FROM g WHERE tokens >= 50 OR n <= 128""")
def c3_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 128 tokens; a last one of fewer than 50 is dropped unless it is the only one."""
    base = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"([^ \t\n\r]+)"), F.lit(1)).alias("w")).where("size(w) > 0")
    parts = F.transform(F.sequence(F.lit(0), F.expr("(size(w) - 1) div 128").cast("int")), lambda i: F.slice("w", i * 128 + 1, F.lit(128)))
    cut = base.select("doc_id", F.size("w").alias("n"), F.posexplode(parts).alias("chunk", "part")).where("size(part) >= 50 or n <= 128")
    return cut.select("doc_id", "chunk", F.size("part").alias("tokens"), F.array_join("part", " ").alias("text"))


@query(r"""
    WITH c AS (SELECT chunk_id, string_split_regex(any_value(content), '[.!?]+\s+') AS s FROM (SELECT DISTINCT chunk_id, content FROM processed_chunk WHERE content IS NOT NULL) GROUP BY chunk_id HAVING count(*) = 1),
    u AS (SELECT chunk_id, s, unnest(s) AS one, unnest(range(1, len(s) + 1)) AS i FROM c), f AS (SELECT chunk_id, any_value(s) AS s, min(i) FILTER (contains(lower(one), 'indicador')) AS i FROM u GROUP BY chunk_id)
    SELECT chunk_id, CASE WHEN i > 1 THEN s[i - 1] ELSE '' END AS before_text, s[i] AS item, coalesce(s[i + 1], '') AS after_text FROM f WHERE i IS NOT NULL""")
def c7_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence that names an indicator, with the sentences beside it; chunks of one content only."""
    chunks = table(spark, sf_dir, "processed_chunk").where("content is not null").groupBy("chunk_id").agg(F.min("content").alias("content"), F.max("content").alias("other")).where("content = other")
    split = chunks.select("chunk_id", F.split("content", r"[.!?]+\s+", -1).alias("s"))
    at = F.array_position(F.transform("s", lambda x: F.contains(F.lower(x), F.lit("indicador"))), True).cast("int")
    known = split.withColumn("at", at).where("at > 0")
    return known.select("chunk_id", F.coalesce(F.expr("get(s, at - 2)"), F.lit("")).alias("before_text"), F.expr("get(s, at - 1)").alias("item"), F.coalesce(F.expr("get(s, at)"), F.lit("")).alias("after_text"))


@query(r"""
    WITH l AS (SELECT DISTINCT dimension AS class, array_to_string(regexp_extract_all(lower(k), '[\p{L}\p{N}_]+'), ' ') AS k FROM (SELECT dimension, unnest(keywords) AS k FROM question_mapping) WHERE dimension IS NOT NULL AND regexp_matches(k, '[\p{L}\p{N}_]')),
    n AS (SELECT class, count(*) AS n FROM l GROUP BY class), q AS (SELECT mapping_id, ' ' || array_to_string(regexp_extract_all(lower(question_text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS line FROM question_mapping),
    h AS (SELECT mapping_id, class, count(*) / any_value(n)::DOUBLE AS score FROM q JOIN l ON contains(line, ' ' || k || ' ') JOIN n USING (class) GROUP BY mapping_id, class)
    SELECT mapping_id, class, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'alta' WHEN score >= 0.4 THEN 'media' WHEN score >= 0.2 THEN 'baja' ELSE 'nula' END AS relevance FROM h QUALIFY row_number() OVER (PARTITION BY mapping_id ORDER BY score DESC, class) = 1""")
def e1_keyword_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class whose keywords a question holds the greatest part of; keywords are met by their first word, then as a whole."""
    mapping = table(spark, sf_dir, "question_mapping")
    keywords = mapping.where("dimension is not null").select(F.col("dimension").alias("class"), F.explode("keywords").alias("k")).select("class", words("k").alias("w")).where("size(w) > 0").distinct()
    keywords = keywords.select("class", F.array_join("w", " ").alias("k"), F.get("w", F.lit(0)).alias("first"))
    sizes = keywords.groupBy("class").agg(F.count("*").alias("n"))
    lines = mapping.select("mapping_id", words("question_text").alias("w")).select("mapping_id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("line"), F.explode(F.array_distinct("w")).alias("first"))
    held = lines.join(keywords, "first").where(F.contains("line", F.concat(F.lit(" "), "k", F.lit(" ")))).groupBy("mapping_id", "class").agg(F.count("*").alias("hits"))
    scored = held.join(F.broadcast(sizes), "class").withColumn("score", F.col("hits") / F.col("n"))  # one row for each dimension
    best = scored.groupBy("mapping_id").agg(F.min_by(F.struct("class", "score"), F.struct(-F.col("score"), "class")).alias("b")).select("mapping_id", "b.*")
    level = F.when(F.col("score") >= 0.7, "alta").when(F.col("score") >= 0.4, "media").when(F.col("score") >= 0.2, "baja").otherwise("nula")
    return best.select("mapping_id", "class", F.round("score", 6).alias("score"), level.alias("relevance"))


# ---- retrieval ------------------------------------------------------------------------------

_COSINES = """q AS (SELECT vec_id AS query_id, embedding AS e, label AS query FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT query_id, query, vec_id, label, round(list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM q, embeddings)"""


@query(f"""WITH {_COSINES}, m AS (SELECT query, query_id, vec_id // 8 AS document, greatest(0, max(score)) AS best FROM c GROUP BY ALL)
    SELECT query, document, round(avg(best) + 1e-9, 4) AS score FROM m GROUP BY query, document""")
def r9_late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over a query's vectors of the best cosine (not below 0) among a document's vectors.

    The stated query vectors (ids divisible by 20) meet all vectors in blocks:
    a task holds one block of each side and keeps a maximum for each document.
    """
    vectors = table(spark, sf_dir, "embeddings")
    return max_similarity(vectors.where("vec_id % 20 = 0").select("vec_id", "embedding", F.col("label").alias("query")), vectors.select("embedding", F.expr("vec_id div 8").alias("document")))


def max_similarity(queries: DataFrame, documents: DataFrame, block: int = 2048) -> DataFrame:
    """(query, document, score) of late interaction, from (vec_id, embedding, query) and (embedding, document)."""
    import pandas as pd

    sides = [queries.select("vec_id", "query", F.col("embedding").cast("array<double>").alias("e")), documents.select("document", F.col("embedding").cast("array<double>").alias("e"))]
    sides = [s.where("size(e) > 0") for s in sides]
    blocks = [max(1, -(-s.count() // block)) for s in sides]
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = sides[0].withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(blocks[0]))).withColumn("db", spread(blocks[1]))
    # a document's vectors may lie in several blocks, so a large one is not one task's
    right = sides[1].withColumn("db", F.pmod(F.xxhash64("e"), F.lit(blocks[1]))).withColumn("qb", spread(blocks[0]))

    def best(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "document": pd.Series(dtype="int64"), "best": pd.Series(dtype="float64")})]
        d = d.sort_values("document")
        for size, own in q.groupby(q["e"].map(len)):
            others = d[d["e"].map(len) == size]
            if not len(others):
                continue
            a, b = np.stack(own["e"].to_numpy()), np.stack(others["e"].to_numpy())
            norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
            scores = np.round(np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0), 6)
            names = others["document"].to_numpy()
            first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            tops = np.maximum(np.maximum.reduceat(scores, first, axis=1), 0.0)
            out.append(pd.DataFrame({"query": np.repeat(own["query"].to_numpy(), len(first)), "vec_id": np.repeat(own["vec_id"].to_numpy(), len(first)), "document": np.tile(names[first], len(own)), "best": tops.ravel()}))
        return pd.concat(out)

    met = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInPandas(best, "query bigint, vec_id bigint, document bigint, best double")
    return met.groupBy("query", "vec_id", "document").agg(F.max("best").alias("best")).groupBy("query", "document").agg(F.round(F.avg("best") + 1e-9, 4).alias("score"))


@query(f"""WITH {_COSINES}, n AS (SELECT query_id, query, label FROM c WHERE query_id <> vec_id AND score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5 AND score > 0.7)
    SELECT query_id, string_agg(DISTINCT 'termino_' || label, ' ' ORDER BY 'termino_' || label) AS expansion FROM n WHERE label <> query GROUP BY query_id""")
def r19_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New terms of the five nearest patterns with a cosine above .7, in order; queries without any are left out."""
    vectors = table(spark, sf_dir, "embeddings")
    near = top_similar(vectors, vectors.where("vec_id % 20 = 0"), 5).where("score > 0.7")
    terms = vectors.select("vec_id", F.concat(F.lit("termino_"), F.col("label").cast("string")).alias("term"))
    own = terms.select(F.col("vec_id").alias("query_id"), F.col("term").alias("own"))
    # at most five terms for each query
    return near.join(terms, "vec_id").join(own, "query_id").where("term <> own").groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("term")), " ").alias("expansion"))


#: Distinct words of all queries up to which they are sought within the arrays of words; beyond, by a join.
FILTER_WORDS = 2000


def bm25(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, words, doc_id, held, score): BM25 of the texts (doc_id, text) that hold a word of a query (query, word, words).

    Texts are cut into words once; a text's length is their number, and only
    words that are asked for are counted and shuffled.
    """
    tokens = documents.select("doc_id", words("text").alias("w")).where("size(w) > 0").select("doc_id", F.size("w").alias("dl"), "w")
    wanted = [r.word for r in asked.select("word").distinct().limit(FILTER_WORDS + 1).collect()]
    if len(wanted) <= FILTER_WORDS:  # few words: left in the array before it is taken apart
        met = tokens.select("doc_id", "dl", F.explode_outer(F.filter("w", lambda x: x.isin(wanted))).alias("word"))
    else:
        known = asked.select(F.col("word").alias("asked_word")).distinct()
        met = tokens.select("doc_id", "dl", F.explode("w").alias("w")).join(known, F.col("w") == F.col("asked_word"), "left").select("doc_id", "dl", F.col("asked_word").alias("word"))
    # one pass: a row for each word asked for, and one of no word for each text's length
    counted = cut_table(met.groupBy("doc_id", "dl", "word").agg(F.count("*").alias("tf")))
    sized = counted.select("doc_id", "dl").distinct().agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    hits = counted.where("word is not null")
    known = hits.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("mean")))
    joined = hits.join(known, "word").join(asked, "word").crossJoin(F.broadcast(sized))  # sized is one row
    return joined.groupBy("query", "words", "doc_id").agg(F.count("*").alias("held"), F.round(1e-9 + F.sum(part), 6).alias("score"))


def _lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "keyword_lexicon").select("kw_id", F.array_distinct(words("keyword")).alias("w")).where("size(w) > 0")
    asked = wanted.select(F.col("kw_id").alias("query"), F.size("w").alias("words"), F.explode("w").alias("word"))
    return bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), asked).withColumnRenamed("query", "kw_id")


@query()
def r23_batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best texts for each keyword of the lexicon; its twin is the SQL text of the other module."""
    ranked = _lexicon_scores(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("kw_id").orderBy(F.desc("score"), "doc_id")).cast("bigint"))
    return ranked.where("place <= 10").select("kw_id", "doc_id", "score", "place")


@query()
def r1_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best texts for the flagship query; its twin is the SQL text of the other module."""
    asked = spark.createDataFrame([(0, w, len(QUERY_WORDS)) for w in QUERY_WORDS], "query int, word string, words int")
    scored = bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), asked)
    return scored.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", "score")


@query(r"""
    WITH t AS (SELECT doc_id, w, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents) GROUP BY ALL), d AS (SELECT doc_id, sum(tf) AS dl FROM t GROUP BY doc_id), s AS (SELECT count(*) AS n, avg(dl) AS mean FROM d),
    k AS (SELECT kw_id, unnest(list_distinct(regexp_extract_all(lower(keyword), '[\p{L}\p{N}_]+'))) AS w FROM keyword_lexicon), f AS (SELECT w, count(*) AS df FROM t GROUP BY w), z AS (SELECT kw_id, count(*) AS words FROM k GROUP BY kw_id),
    b AS (SELECT kw_id, doc_id, count(*) AS held, round(sum(ln((s.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM k JOIN f USING (w) JOIN t USING (w) JOIN d USING (doc_id), s GROUP BY kw_id, doc_id),
    r AS (SELECT kw_id, (held = words)::INTEGER AS rel, row_number() OVER (PARTITION BY kw_id ORDER BY score DESC, doc_id) AS place, sum((held = words)::INTEGER) OVER (PARTITION BY kw_id) AS known FROM b JOIN z USING (kw_id)),
    i AS (SELECT j, sum(1 / log2(i + 1)) AS ideal FROM range(1, 11) a(i), range(1, 11) c(j) WHERE i <= j GROUP BY j)
    SELECT kw_id, round(sum(rel / log2(place + 1)) FILTER (place <= 10) / any_value(ideal), 6) AS ndcg10, round(sum(rel) FILTER (place <= 10) / max(known)::DOUBLE, 6) AS recall10, round(sum(rel) FILTER (place <= 100) / max(known)::DOUBLE, 6) AS recall100
    FROM r JOIN i ON j = least(10, known) WHERE known > 0 GROUP BY kw_id""")
def r33_ndcg_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG and recall of the keyword rankings; a text is relevant that holds all words of the keyword. Keywords without a relevant text are left out."""
    relevant = cut_table(_lexicon_scores(spark, sf_dir).withColumn("rel", (F.col("held") == F.col("words")).cast("int")))
    totals = relevant.groupBy("kw_id").agg(F.sum("rel").alias("known")).where("known > 0")
    ranked = relevant.withColumn("place", F.row_number().over(Window.partitionBy("kw_id").orderBy(F.desc("score"), "doc_id"))).where("place <= 100")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.max("known")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    gain = F.sum(F.when(F.col("place") <= 10, F.col("rel") / F.log2(F.col("place") + 1.0)))
    return ranked.join(F.broadcast(totals), "kw_id").groupBy("kw_id").agg(F.round(gain / ideal, 6).alias("ndcg10"), F.round(F.sum(F.when(F.col("place") <= 10, F.col("rel"))) / F.max("known"), 6).alias("recall10"), F.round(F.sum("rel") / F.max("known"), 6).alias("recall100"))


@query("""WITH r AS (SELECT DISTINCT chunk_id FROM processed_chunk WHERE channel = 'portal' UNION ALL SELECT 'unknown')
    SELECT (SELECT count(*) FROM r) AS requested, (SELECT count(DISTINCT chunk_id) FROM processed_chunk p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.chunk_id = p.chunk_id)) AS remaining""")
def r4_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting the portal chunks and an unknown id from the index: the number asked for, and what is left."""
    chunks = table(spark, sf_dir, "processed_chunk").select("chunk_id", "channel").where("chunk_id is not null")
    asked = chunks.where("channel = 'portal'").select("chunk_id").distinct().unionByName(spark.createDataFrame([("unknown",)], "chunk_id string"))
    left = chunks.join(asked, "chunk_id", "left_anti").agg(F.count_distinct("chunk_id").alias("remaining"))
    return asked.agg(F.count("*").alias("requested")).crossJoin(left)  # one row each


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), p AS (SELECT vec_id, j, sum(x * sin(42 + i * 8 + j)) AS y FROM x, range(8) r(j) GROUP BY vec_id, j)
    SELECT vec_id, j AS dim, round(greatest(0, y + 0.1 * j), 4) AS value FROM p""")
def r17_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ReLU(xW + b) with a seeded matrix, W(i, j) = sin(seed + 8 i + j), b(j) = j / 10."""

    def project(vectors: pa.Array) -> pa.Array:
        rows = vectors.to_pylist()
        sizes = {len(r) for r in rows if r}
        matrices = {n: np.sin(42 + np.arange(n)[:, None] * 8 + np.arange(8)[None, :]) for n in sizes}
        return pa.array([np.round(np.maximum(0.0, np.array(r, dtype=float) @ matrices[len(r)] + 0.1 * np.arange(8)), 4).tolist() if r else None for r in rows], pa.list_(pa.float64()))

    projected = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.arrow_udf(project, "array<double>")("embedding")).alias("dim", "value"))
    return projected.select("vec_id", F.col("dim").cast("bigint").alias("dim"), "value")


@query("""WITH v AS (SELECT doc_id, i, ('0x' || substr(md5(text || '|' || i), 1, 8))::BIGINT / 4294967296.0 * 2 - 1 AS v FROM documents, range(16) r(i) WHERE text IS NOT NULL)
    SELECT doc_id, i AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM v""")
def r32_synthetic_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors that the hash of a text seeds."""
    base = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    raw = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(F.md5(F.concat("text", F.lit("|"), i.cast("string"))), 1, 8), 16, 10).cast("bigint") / 4294967296.0 * 2 - 1)
    known = base.select("doc_id", raw.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    return known.select("doc_id", "norm", F.posexplode("v").alias("dim", "x")).select("doc_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("x") / F.col("norm"), 6).alias("value"))


@query(f"""WITH {_COSINES}, n AS (SELECT query_id, vec_id, score FROM c WHERE query_id <> vec_id AND score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10),
    e AS (SELECT least(query_id, vec_id) AS a, greatest(query_id, vec_id) AS b, max(score) AS w FROM n GROUP BY ALL), d AS (SELECT v, sum(w) AS d FROM (SELECT a AS v, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY v)
    SELECT a, b, round(-w / sqrt(x.d * y.d), 6) AS value FROM e JOIN d x ON x.v = a JOIN d y ON y.v = b UNION ALL SELECT v, v, 1.0 FROM d""")
def r28_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised Laplacian of the graph of nearest neighbours of the stated queries: the diagonal and the upper half."""
    vectors = table(spark, sf_dir, "embeddings")
    near = top_similar(vectors, vectors.where("vec_id % 20 = 0"))
    edges = cut_table(near.groupBy(F.least("query_id", "vec_id").alias("a"), F.greatest("query_id", "vec_id").alias("b")).agg(F.max("score").alias("w")))
    degrees = edges.select(F.col("a").alias("v"), "w").unionByName(edges.select(F.col("b").alias("v"), "w")).groupBy("v").agg(F.sum("w").alias("d"))
    at = lambda v, d: degrees.select(F.col("v").alias(v), F.col("d").alias(d))
    upper = edges.join(at("a", "da"), "a").join(at("b", "db"), "b").select("a", "b", F.round(-F.col("w") / F.sqrt(F.col("da") * F.col("db")), 6).alias("value"))
    return upper.unionByName(degrees.select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(1.0).alias("value")))


@query("SELECT vec_id, len(embedding)::INTEGER AS dims, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings WHERE embedding IS NOT NULL")
def s9_embedding_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of unit vectors written as a table and read back: size and former length of each."""
    vectors = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    known = vectors.withColumn("norm", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)))
    stored = cut_table(known.select("vec_id", F.transform("e", lambda x: F.try_divide(x, F.col("norm"))).alias("unit"), "norm"))
    return stored.select("vec_id", F.size("unit").alias("dims"), F.round("norm", 5).alias("norm"))


@query(r"""
    WITH t AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents) GROUP BY ALL), f AS (SELECT w, count(*) AS df FROM t GROUP BY w), d AS (SELECT doc_id, sum(tf) AS dl FROM t GROUP BY doc_id), s AS (SELECT count(*) AS n FROM d)
    SELECT w AS word, doc_id, tf, dl::BIGINT AS dl, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM t JOIN f USING (w) JOIN d USING (doc_id), s""")
def s10_lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with length and inverse document frequency, written as a table and read back."""
    tokens = table(spark, sf_dir, "documents").select("doc_id", words("text").alias("w")).where("size(w) > 0")
    postings = cut_table(tokens.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("word")).groupBy("word", "doc_id", "dl").agg(F.count("*").alias("tf")))
    n = tokens.count()
    idf = postings.groupBy("word").agg(F.count("*").alias("df")).select("word", F.round(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))
    return cut_table(postings.join(idf, "word").select("word", "doc_id", "tf", F.col("dl").cast("bigint").alias("dl"), "idf"))


@query(r"""
    WITH t AS (SELECT doc_id, md5(text) AS hash, w, count(*) AS tf FROM (SELECT doc_id, text, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents) GROUP BY ALL), u AS (SELECT DISTINCT hash, w, tf FROM t), f AS (SELECT w, count(*) AS df FROM u GROUP BY w), s AS (SELECT count(DISTINCT hash) AS n FROM u)
    SELECT hash, w AS word, round(tf * (ln((1 + n) / (1.0 + df)) + 1), 6) AS weight FROM u JOIN f USING (w), s""")
def s8_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed TF-IDF weights of distinct texts in long form, sorted within files and written compressed."""
    texts = table(spark, sf_dir, "documents").where("text is not null").select(F.md5("text").alias("hash"), words("text").alias("w")).where("size(w) > 0").dropDuplicates(["hash"])
    counts = cut_table(texts.select("hash", F.explode("w").alias("word")).groupBy("hash", "word").agg(F.count("*").alias("tf")))
    n = texts.count()
    idf = counts.groupBy("word").agg(F.count("*").alias("df")).select("word", (F.log((1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = counts.join(idf, "word").select("hash", "word", F.round(F.col("tf") * F.col("idf"), 6).alias("weight"))
    return cut_table(weighed.repartitionByRange("hash").sortWithinPartitions("hash", "word"))


# ---- statistics -----------------------------------------------------------------------------


@query("""
    WITH r AS (SELECT i, c_acctbal AS x, ('0x' || substr(md5(c_custkey || '|' || i), 1, 8))::BIGINT / 4294967296.0 AS u FROM customer, range(50) t(i)),
    w AS (SELECT i, x, CASE WHEN u < 0.367879 THEN 0 WHEN u < 0.735759 THEN 1 WHEN u < 0.919699 THEN 2 WHEN u < 0.981012 THEN 3 ELSE 4 END AS n FROM r), m AS (SELECT i, sum(n * x) / sum(n) AS m FROM w GROUP BY i)
    SELECT round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def stat_p5_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and interval of the mean over fifty resamples; hashes give each row its number of copies, so that nothing is shuffled but sums."""
    u = F.conv(F.substring(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit("|"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    # fixed values: limits of the Poisson distribution of mean one
    copies = sum((F.when(F.col("u") >= limit, 1).otherwise(0) for limit in (0.367879, 0.735759, 0.919699, 0.981012)), F.lit(0))
    drawn = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i")).withColumn("u", u).withColumn("n", copies)
    means = drawn.groupBy("i").agg((F.sum(F.col("n") * F.col("c_acctbal")) / F.sum("n")).alias("m"))
    return means.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("std"), F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"))


_CLASSES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("""
    WITH k AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS c), z AS (SELECT o_custkey, c, count(*) FILTER (o_orderpriority = c)::DOUBLE AS z FROM orders, k GROUP BY ALL), y AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS y FROM orders GROUP BY o_custkey),
    p AS (SELECT o_custkey, c, z, exp(z / 2) / sum(exp(z / 2)) OVER (PARTITION BY o_custkey) AS p FROM z), t AS (SELECT p.*, y FROM p JOIN y USING (o_custkey)), own AS (SELECT o_custkey, p AS py, z AS zy FROM t WHERE c = y)
    SELECT o_custkey, round(1 - any_value(py), 6) AS softmax, round(max(p) FILTER (c <> y) - any_value(py), 6) AS margin, round(-sum(p * ln(p)), 6) AS entropy, round(max(z) - any_value(zy), 6) AS logit, count(*) FILTER (round(p, 9) > round(py, 9)) + 1 AS rank FROM t JOIN own USING (o_custkey) GROUP BY o_custkey""")
def stat_p7_class_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nonconformity of the true class by softmax, margin, entropy, logit and rank at temperature 2; counts of a customer's priorities are the logits, the last priority the truth."""
    known = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array(*[F.count_if(F.col("o_orderpriority") == c).cast("double") for c in _CLASSES]).alias("z"), F.max_by("o_orderpriority", "o_orderkey").alias("y"))
    known = known.withColumn("e", F.transform("z", lambda v: F.exp(v / 2))).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, v: a + v)).withColumn("p", F.transform("e", lambda v: v / F.col("total")))
    known = known.withColumn("at", F.array_position(F.array(*map(F.lit, _CLASSES)), F.col("y")).cast("int")).where("at > 0").withColumn("py", F.expr("get(p, at - 1)"))
    others = F.expr("filter(p, (v, i) -> i <> at - 1)")
    entropy = -F.aggregate("p", F.lit(0.0), lambda a, v: a + v * F.log(v))
    return known.select(
        "o_custkey", F.round(1 - F.col("py"), 6).alias("softmax"), F.round(F.array_max(others) - F.col("py"), 6).alias("margin"), F.round(entropy, 6).alias("entropy"), F.round(F.array_max("z") - F.expr("get(z, at - 1)"), 6).alias("logit"),
        (F.size(F.filter("p", lambda v: F.round(v, 9) > F.round(F.col("py"), 9))) + 1).cast("bigint").alias("rank"),
    )


@query("""
    WITH f AS (SELECT o_orderkey % 5 AS fold, count(*) AS n, count(*) FILTER (abs(o_totalprice / 500000 - 0.3) <= 0.25) AS hit FROM orders GROUP BY 1)
    SELECT fold, round(hit / n::DOUBLE, 6) AS coverage, round((hit / n::DOUBLE + 1.9208 / n - 1.96 * sqrt(hit / n::DOUBLE * (1 - hit / n::DOUBLE) / n + 0.9604 / (n::DOUBLE * n))) / (1 + 3.8416 / n), 6) AS low, round((hit / n::DOUBLE + 1.9208 / n + 1.96 * sqrt(hit / n::DOUBLE * (1 - hit / n::DOUBLE) / n + 0.9604 / (n::DOUBLE * n))) / (1 + 3.8416 / n), 6) AS high FROM f""")
def stat_p14_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a fixed interval in each fold with its Wilson bounds."""
    folds = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 5).alias("fold")).agg(F.count("*").cast("double").alias("n"), F.avg((F.abs(F.col("o_totalprice") / 500000 - 0.3) <= 0.25).cast("double")).alias("p"))
    z = 1.96
    centre = F.col("p") + z * z / (2 * F.col("n"))
    spread = z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))
    scale = 1 + z * z / F.col("n")
    return folds.select("fold", F.round("p", 6).alias("coverage"), F.round((centre - spread) / scale, 6).alias("low"), F.round((centre + spread) / scale, 6).alias("high"))


# ---- lineage and graphs ---------------------------------------------------------------------


@query("""
    WITH c AS (SELECT chunk_id, any_value(provenance.source_document) AS source, min(metadata.chunk_index) AS i, min(provenance.source_hash) AS h, min(metadata.source_bundle_id) AS b FROM processed_chunk WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
    l AS (SELECT *, lag(h) OVER (PARTITION BY source ORDER BY i, chunk_id) AS expected FROM c WHERE source IS NOT NULL)
    SELECT chunk_id, h AS stored, expected FROM l WHERE expected IS NOT NULL AND h IS DISTINCT FROM expected""")
def h8_chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose stored hash of the source is not that of the chunk before them: where the chain of a source breaks."""
    chunks = table(spark, sf_dir, "processed_chunk").where("chunk_id is not null").groupBy("chunk_id").agg(F.min("provenance.source_document").alias("source"), F.min("metadata.chunk_index").alias("i"), F.min("provenance.source_hash").alias("h"))
    broken = broken_links(chunks.where("source is not null"), "source", ["i", "chunk_id"], "h", "h")
    return broken.select("chunk_id", F.col("h").alias("stored"), "expected")


@query("""SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')""")
def g17_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to nodes that are not there, by an anti join that either side may be shuffled for."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")


@query("SELECT provenance.source_document AS subject, count(DISTINCT provenance.source_hash) AS objects FROM processed_chunk WHERE provenance.source_document IS NOT NULL GROUP BY 1 HAVING count(DISTINCT provenance.source_hash) > 1")
def g17_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with several objects of a functional relation: sources with several hashes."""
    facts = table(spark, sf_dir, "processed_chunk").select(F.col("provenance.source_document").alias("subject"), F.col("provenance.source_hash").alias("object")).where("subject is not null and object is not null").distinct()
    return facts.groupBy("subject").agg(F.count("*").alias("objects")).where("objects > 1")


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c_acctbal > 0 AND c_custkey = o_custkey)""")
def s5_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose key is not in the cache of unexpired entries."""
    cache = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.md5(F.col("c_custkey").cast("string")).alias("key"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.col("o_custkey").cast("string")).alias("key")).join(cache, "key", "left_anti").select("o_orderkey")


# ---- operations -----------------------------------------------------------------------------


@query("""
    WITH m AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS source, epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER w / 1e6 AS wait FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT source, event_type AS target, count(*) AS n, round(avg(wait), 3) AS mean_wait, round(max(wait), 3) AS longest FROM m WHERE source IS NOT NULL GROUP BY ALL""")
def m20_edge_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traversals of each edge between kinds of events of a user, with the seconds between them."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").where("ts is not null").select(F.lag("event_type").over(order).alias("source"), F.col("event_type").alias("target"), ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)) / 1e6).alias("wait"))
    return steps.where("source is not null").groupBy("source", "target").agg(F.count("*").alias("n"), F.round(F.avg("wait"), 3).alias("mean_wait"), F.round(F.max("wait"), 3).alias("longest"))


_RULES = [("r1", "click", ">", 50.0), ("r2", "view", ">=", 90.0), ("r3", "purchase", "<", 5.0), ("r4", "click", "<=", 1.0), ("r5", "error", "==", 0.0), ("r6", "error", "!=", 0.0)]


@query(f"""
    WITH r(rule, event_type, op, bound) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in _RULES)}),
    h AS (SELECT rule, event_id, user_id, ts, CASE op WHEN '>' THEN value > bound WHEN '>=' THEN value >= bound WHEN '<' THEN value < bound WHEN '<=' THEN value <= bound WHEN '==' THEN value = bound ELSE value <> bound END AS high FROM events JOIN r USING (event_type) WHERE ts IS NOT NULL AND value IS NOT NULL),
    s AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY rule, user_id ORDER BY ts, event_id), false) AS was FROM h)
    SELECT rule, event_id, CASE WHEN high AND NOT was THEN 'fire' WHEN high THEN 'update' ELSE 'resolve' END AS state FROM s WHERE high OR was""")
def m7_rule_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of alerts by a table of rules with six comparisons, one alert for each rule and user."""
    rules = spark.createDataFrame(_RULES, "rule string, event_type string, op string, bound double")
    met = table(spark, sf_dir, "events").where("ts is not null and value is not null").join(F.broadcast(rules), "event_type")  # the few rules of a setting
    compare = {">": F.col("value") > F.col("bound"), ">=": F.col("value") >= F.col("bound"), "<": F.col("value") < F.col("bound"), "<=": F.col("value") <= F.col("bound"), "==": F.col("value") == F.col("bound")}
    high = F.col("value") != F.col("bound")
    for op, test in compare.items():
        high = F.when(F.col("op") == op, test).otherwise(high)
    was = F.coalesce(F.lag("high").over(Window.partitionBy("rule", "user_id").orderBy("ts", "event_id")), F.lit(False))
    state = met.withColumn("high", high).withColumn("was", was).where("high or was")
    return state.select("rule", "event_id", F.when(F.col("high") & ~F.col("was"), "fire").when(F.col("high"), "update").otherwise("resolve").alias("state"))


@query("""
    WITH h AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS n, count(*) FILTER (event_type = 'error' OR value > 90) AS bad FROM events WHERE ts IS NOT NULL GROUP BY 1)
    SELECT minute, n, round(bad / n::DOUBLE, 6) AS error_rate, round(sum(n) OVER (ORDER BY minute RANGE BETWEEN INTERVAL 59 MINUTE PRECEDING AND CURRENT ROW) / 60.0, 6) AS per_minute FROM h""")
def m22_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors over operations of each minute, and operations a minute over the trailing hour.

    The window runs over minutes, not events; it is split by hour, each minute
    being copied to the hour after it as well, so no task orders all of them.
    """
    minutes = table(spark, sf_dir, "events").where("ts is not null").groupBy(F.expr("unix_micros(cast(ts as timestamp)) div 60000000").alias("m")).agg(F.count("*").alias("n"), F.count_if((F.col("event_type") == "error") | (F.col("value") > 90)).alias("bad"))
    copies = minutes.withColumn("hour", F.explode(F.array(F.expr("m div 60"), F.expr("m div 60") + 1)))
    over = Window.partitionBy("hour").orderBy("m").rangeBetween(-59, 0)
    known = copies.withColumn("trailing", F.sum("n").over(over)).where("hour = m div 60")
    return known.select(F.expr("cast(timestamp_micros(m * 60000000) as timestamp_ntz)").alias("minute"), "n", F.round(F.col("bad") / F.col("n"), 6).alias("error_rate"), F.round(F.col("trailing") / 60.0, 6).alias("per_minute"))


# ---- roll-ups -------------------------------------------------------------------------------


@query("""
    WITH e AS (SELECT l_orderkey AS question_id, l_quantity / 50.0 AS s, 0.1 + l_tax * 10 AS w, l_linenumber AS i FROM lineitem)
    SELECT question_id, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN sum(s * w) / sum(w) ELSE 0 END, 6) AS weighted, round(CASE WHEN count(*) >= 3 THEN quantile_cont(s, 0.5) ELSE 0 END, 6) AS majority, round(CASE WHEN count(*) >= 3 THEN sum(s * w) / sum(w) ELSE 0 END, 6) AS confidence,
        round(CASE WHEN count(*) >= 3 THEN first(s ORDER BY round(w, 9) DESC, i, s DESC) ELSE 0 END, 6) AS hierarchical FROM e GROUP BY question_id""")
def a12_group_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ways to sum up the evidence of a question; fewer than three items give 0, of equal weights the first item counts."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), (F.col("l_quantity") / 50).alias("s"), (F.col("l_tax") * 10 + 0.1).alias("w"), F.col("l_linenumber").alias("i"))
    enough = lambda c: F.round(F.when(F.count("*") >= 3, c).otherwise(0.0), 6)
    mean = F.sum(F.col("s") * F.col("w")) / F.sum("w")
    return items.groupBy("question_id").agg(F.count("*").alias("n"), enough(mean).alias("weighted"), enough(F.percentile("s", 0.5)).alias("majority"), enough(mean).alias("confidence"), enough(F.max_by("s", F.struct(F.round("w", 9), -F.col("i"), "s"))).alias("hierarchical"))


@query(r"""
    WITH d AS (SELECT question_id, mapping_id, list_distinct(regexp_extract_all(lower(question_text), '[\p{L}\p{N}_]+')) AS w, weight, question_text FROM question_mapping WHERE question_text IS NOT NULL),
    p AS (SELECT a.question_id, avg(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0)::DOUBLE) AS consistency FROM d a JOIN d b ON a.question_id = b.question_id AND a.mapping_id < b.mapping_id GROUP BY 1)
    SELECT question_id, count(*) AS workers, round(avg(weight), 6) AS mean_quality, round(coalesce(any_value(consistency), 1), 6) AS consistency, arg_max(question_text, (length(question_text), mapping_id)) AS longest FROM d LEFT JOIN p USING (question_id) GROUP BY question_id""")
def a43_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several results for one question: mean weight, mean pairwise overlap of words (1 for a single result), the longest text."""
    known = table(spark, sf_dir, "question_mapping").where("question_text is not null").select("question_id", "mapping_id", "weight", "question_text", F.array_distinct(words("question_text")).alias("w"))
    other = known.select("question_id", F.col("mapping_id").alias("m"), F.col("w").alias("v"))
    overlap = known.join(other, "question_id").where("mapping_id < m").groupBy("question_id").agg(F.avg(F.try_divide(F.size(F.array_intersect("w", "v")), F.size(F.array_union("w", "v")))).alias("consistency"))
    sums = known.groupBy("question_id").agg(F.count("*").alias("workers"), F.round(F.avg("weight"), 6).alias("mean_quality"), F.max_by("question_text", F.struct(F.length("question_text"), "mapping_id")).alias("longest"))
    return sums.join(overlap, "question_id", "left").select("question_id", "workers", "mean_quality", F.round(F.coalesce("consistency", F.lit(1.0)), 6).alias("consistency"), "longest")


# ---- orders over all rows ---------------------------------------------------------------------
# The twins of these are the SQL texts in the other modules.


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, predicted = F.col("o_totalprice") / 500000, (150000 + (F.col("o_custkey") % 100) * 100) / F.lit(500000.0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), truth.alias("truth"), predicted.alias("predicted"), F.abs(truth - predicted).alias("s"))


def _quantiles(pairs: DataFrame) -> DataFrame:
    at = lambda level: F.least(F.col("n"), F.ceil((F.col("n") + 1) * level)) - 1
    return order_statistics(pairs, "kind", "s", {"q90": at(0.9), "q95": at(0.95)}, ("id",))


@query()
def stat_p2_conformal_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantiles(_calibration(spark, sf_dir)).select("kind", F.round(1e-9 + F.col("q90"), 6).alias("q90"), F.round(1e-9 + F.col("q95"), 6).alias("q95"))


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _calibration(spark, sf_dir)
    # one row for each kind of question
    joined = pairs.join(_quantiles(pairs).select("kind", "q90"), "kind")
    return joined.withColumn("low", F.greatest(F.lit(0.0), F.col("predicted") - F.col("q90"))).withColumn("high", F.least(F.lit(1.0), F.col("predicted") + F.col("q90")))


@query()
def stat_p3_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir).select("id", F.round(1e-9 + F.col("low"), 6).alias("low"), F.round(1e-9 + F.col("high"), 6).alias("high"))


@query()
def stat_p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.avg((F.abs(F.col("truth") - F.col("predicted")) <= F.col("q90")).cast("double"))
    return _intervals(spark, sf_dir).groupBy("kind").agg(F.round(1e-9 + held, 6).alias("coverage"), F.round(1e-9 + F.avg(F.col("high") - F.col("low")), 6).alias("width"))


@query()
def m6_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("ts is not null").select("event_type", F.coalesce("value", F.lit(0.0)).alias("value"), "event_id")
    at = {f"p{round(100 * q)}": F.floor(F.col("n") * q) for q in (0.5, 0.95, 0.99)}
    return order_statistics(events, "event_type", "value", at, ("event_id",)).select("event_type", *at)


@query()
def h1_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vec"), "o_totalprice")
    return places(orders, [F.col("o_totalprice").desc_nulls_last(), F.col("vec")]).select("vec", (F.col("place") + 1).alias("place"))


@query()
def h2_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    tied = F.row_number().over(Window.partitionBy("o_totalprice").orderBy("o_orderkey")) > 1
    return places(orders.withColumn("tied", tied), [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")]).select("o_orderkey", "place", "tied")


@query()
def r8_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    lists = [places(parts.select("p_partkey", c), [F.col(c).desc(), F.col("p_partkey")]).select("p_partkey", (1.0 / (61 + F.col("place"))).alias("s")) for c in ("p_retailprice", "p_size")]
    return lists[0].unionByName(lists[1]).groupBy("p_partkey").agg(F.round(1e-9 + F.sum("s"), 9).alias("rrf"))


# ---- twins of queries elsewhere, from the formula and not from the query's text ----------------

ORACLES["a39_coverage_matrix"] = """
    WITH d AS (SELECT c_nationkey AS point, o_orderkey % 4 + 1 AS d, least(count(*) / 2.0, 1.0)::DOUBLE AS share FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT point, coalesce(max(share) FILTER (d = 1), 0.0) AS de1, coalesce(max(share) FILTER (d = 2), 0.0) AS de2, coalesce(max(share) FILTER (d = 3), 0.0) AS de3, coalesce(max(share) FILTER (d = 4), 0.0) AS de4 FROM d GROUP BY point"""
