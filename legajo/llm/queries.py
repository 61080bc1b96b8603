"""Named queries of the training-text operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions.session import cut_table, table
from legajo.llm.confusables import confusable_tokens, form_classes, keyword_matches, same_looking, with_visible_form
from legajo.llm.mixing import mixed, reached_shares
from legajo.llm.packing import pack, usage
from legajo.llm.repeated_lines import repeated_lines, without_repeated_lines, without_repeated_passages
from legajo.llm.scans import ScanRepair
from legajo.llm.sentences import fit_on, sentences
from legajo.llm.stuffing import spam_shares, stuffed_pages
from legajo.llm.splitting import oversized_chunks, split_oversized
from legajo.llm.tokens import token_sizes


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = keyword_matches(table(spark, sf_dir, "question_mapping"), table(spark, sf_dir, "keyword_lexicon"))
    texts = same_looking(table(spark, sf_dir, "processed_chunk"))
    found = words.select(F.lit("keyword").alias("kind"), F.col("kw_id").alias("key_a"), F.col("mapping_id").alias("key_b"), "pos")
    return found.unionByName(texts.select(F.lit("content").alias("kind"), "key_a", "key_b", F.lit(-1).alias("pos")))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "processed_chunk").select("row_id", "chunk_id", "content")
    return with_visible_form(chunks, "content", "content")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_classes(table(spark, sf_dir, "processed_chunk")).select(F.hex("form").alias("form"), F.hex("spelling").alias("spelling"), "id")


def p1_confusable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusable_tokens(table(spark, sf_dir, "processed_chunk"), "content")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized_chunks(table(spark, sf_dir, "processed_chunk"), table(spark, sf_dir, "chunk_config"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "processed_chunk"), table(spark, sf_dir, "chunk_config"))


def _flowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose line breaks end paragraphs, for fitting."""
    return table(spark, sf_dir, "processed_chunk").where("channel is null or channel <> 'pdf_scan'")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "processed_chunk").where("metadata.policy = 'sentence_boundaries'")
    return sentences(chunks, fit_on(_flowing(spark, sf_dir))).select("chunk_id", "end_char").distinct()


def p3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "processed_chunk").withColumn("scanned", F.col("channel") == "pdf_scan")
    return sentences(chunks, fit_on(_flowing(spark, sf_dir)), soft_lines="scanned").distinct()


def _scans(spark: SparkSession, sf_dir: str) -> ScanRepair:
    chunks = table(spark, sf_dir, "processed_chunk").where("channel = 'pdf_scan'")
    return ScanRepair(chunks.select("chunk_id", F.col("provenance.source_document").alias("source"), F.col("metadata.chunk_index").alias("chunk_index"), "content", F.col("page_anchors").alias("anchors")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).found()


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).paragraphs()


def _portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "processed_chunk").where("channel = 'portal'").select("chunk_id", F.col("provenance.source_document").alias("source"), "content")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(_portal(spark, sf_dir))


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(_portal(spark, sf_dir))


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_passages(_portal(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_sizes(table(spark, sf_dir, "documents"))
    return pack(spark, sizes, table(spark, sf_dir, "container_spec"))


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(p8_containers(spark, sf_dir), table(spark, sf_dir, "container_spec"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_sizes(table(spark, sf_dir, "documents"), keep=("source",))
    return mixed(sizes, table(spark, sf_dir, "mix_target"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = table(spark, sf_dir, "mix_target")
    sizes = cut_table(token_sizes(table(spark, sf_dir, "documents"), keep=("source",)))
    return reached_shares(mixed(sizes, mix), sizes, mix)


def p9_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of the mixes that are only as large as every cap allows."""
    mix = table(spark, sf_dir, "mix_target")
    sizes = cut_table(token_sizes(table(spark, sf_dir, "documents"), keep=("source",)))
    return reached_shares(mixed(sizes, mix, exact_shares=True), sizes, mix, exact_shares=True)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages(table(spark, sf_dir, "documents"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_shares(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms, "p1_classes": p1_classes, "p1_confusable_tokens": p1_confusable_tokens, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_sentences": p3_sentences, "p4_found": p4_found, "p4_paragraphs": p4_paragraphs, "p6_found": p6_found, "p6_cleaned": p6_cleaned, "p6_passages": p6_passages, "p8_containers": p8_containers, "p8_usage": p8_usage, "p9_selection": p9_selection, "p9_shares": p9_shares, "p9_exact_shares": p9_exact_shares, "p10_found": p10_found, "p10_shares": p10_shares}

_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

ORACLES = {
    "p2_found": f"""
        SELECT DISTINCT chunk_id FROM processed_chunk JOIN chunk_config USING (config_id)
        WHERE max_tokens > 0 AND len(regexp_extract_all(content, '[^{_SPACE}]+')) > max_tokens""",
    "p6_found": """
        WITH c AS (SELECT DISTINCT chunk_id, provenance.source_document AS source, content FROM processed_chunk WHERE channel = 'portal'),
        l AS (SELECT chunk_id, source, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM c),
        k AS (SELECT chunk_id, source, line_no, regexp_replace(lower(line), '[^\\p{L}]', '', 'g') AS key FROM l),
        n AS (SELECT source, count(DISTINCT chunk_id) AS documents FROM c GROUP BY source),
        r AS (SELECT source, key FROM k JOIN n USING (source) WHERE key <> '' GROUP BY source, key
              HAVING count(DISTINCT chunk_id) >= greatest(5, 0.1 * max(documents)))
        SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN r USING (source, key)""",
}
