"""Registered queries of the training-data operators: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import bloom_lm, filter_audit, fingerprints, html_text, line_dedup, mixing, ngram_join, packing, quality_cnn, quality_rules, spelling, token_counts, toxicity
from tenure.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("epochs")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_document_fingerprints,
        op3_ngram_jaccard_join,
        op4_line_dedup,
        op5_best_fit_packing,
        op6_toxicity,
        op7_html_extraction,
        op8_quality_rules,
        op9_quality_classifier,
        op10_source_mixing,
        op11_spelling_variants,
        op12_filter_audit,
        op13_lm_scoring,
    )
}
ORACLES: dict[str, str] = {
    "op10_source_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
            FROM documents),
        summed AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        weighed AS (
            SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM summed),
        levelled AS (
            SELECT *, source_size * 2 / w AS full_at,
                   ((sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE - coalesce(sum(source_size) OVER filling, 0)::BIGINT * 2)
                   / ((sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER filling, 0)::BIGINT) AS level
            FROM weighed
            WINDOW filling AS (ORDER BY source_size * 2 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        targets AS (
            SELECT source, source_size,
                   least(source_size * 2.0::DOUBLE, coalesce((SELECT arg_min(level, full_at) FROM levelled WHERE level * w <= source_size * 2) * w, 0)) AS target
            FROM levelled),
        ranked AS (
            SELECT doc_id, size, source_size, target,
                   sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
                   CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (size * least(whole + CASE WHEN upto * 2 - size <= (target - whole * source_size) * 2 THEN 1 ELSE 0 END, 2))::BIGINT AS taken
        FROM ranked""",
    "op12_filter_audit": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        judged AS (
            SELECT doc_id, part,
                   (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                   + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
                   + 8 * regexp_matches(text, '[#$%&*|]')::INT
                   + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM texts),
        known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        counts AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
            FROM judged LEFT JOIN known USING (doc_id) GROUP BY part, mask),
        f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        orders AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31),
        steps AS (
            SELECT filter_order, step::INT AS step, b AS bit,
                   (SELECT coalesce(sum(x.b), 0) FROM f x WHERE contains(substr(filter_order, 1, step::INT - 1), x.l))::INT AS before
            FROM orders, range(1, 6) r(step), f WHERE f.l = substr(filter_order, step::INT, 1)),
        stepped AS (
            SELECT part, filter_order, step, bit,
                   coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
                   coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
            FROM counts, steps GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM stepped""",
}
