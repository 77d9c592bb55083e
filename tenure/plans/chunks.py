"""Queries of chunks and role rows of career documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions import patterns, rules
from tenure.operators import chunking
from tenure.sources.careers import CAREER_SQL, TODAY, career_lines
from tenure.stages import stage


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all career documents, written once for the steps of one query."""
    return stage(chunking.chunks(career_lines(spark, sf_dir), TODAY), "chunks")


def career_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunks(career_lines(spark, sf_dir), TODAY)
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select("resume_id", "sequence", F.coalesce("parent_sequence", F.lit(-1)).alias("parent_sequence"), "chunk_type", "section", none("company").alias("company"), none("role").alias("role"), none("start_date").alias("start_date"), none("end_date").alias("end_date"), "is_current", F.sha2("text", 256).alias("text_sha256"))


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = career_lines(spark, sf_dir)
    rows = chunking.chunks(lines, TODAY).join(chunking.candidate_name(lines), "resume_id", "left")
    return rows.select("resume_id", "sequence", "name", F.sha2(chunking.embedding_text(F.col("name")), 256).alias("embedding_sha256"))


def career_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.role_rows(chunking.chunks(career_lines(spark, sf_dir), TODAY))
    quantified = F.size(F.filter("responsibilities", lambda s: s.rlike(patterns.METRIC))).cast("long")
    return rows.select("resume_id", "place", "company", "title", "start_date", "end_date", "is_current", "months", F.array_join("responsibilities", "|").alias("responsibilities"), F.array_join("technologies", "|").alias("technologies"), "confidence", quantified.alias("quantified"))


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [F.coalesce(c, F.lit(False)) for c in chunking.presence_flags()]
    rows = chunking.chunks(career_lines(spark, sf_dir), TODAY).groupBy("resume_id").agg(chunking.text_of_type("SUMMARY").alias("summary"), F.sha2(chunking.text_of_type("EXPERIENCE_RESPONSIBILITY"), 256).alias("bullets_sha256"), F.bool_or(F.col("chunk_type") == "EDUCATION").alias("education"), *[f.alias(n) for f, n in zip(flags, ("project", "certification", "achievement"), strict=True)])
    return rows


QUERIES = {"chk14_chk15_chunk_texts": chunk_texts, "chk1_to_chk12_career_chunks": career_chunks, "chk13_txt8_embedding_texts": embedding_texts, "exp1_exp2_exp3_exp9_exp10_career_roles": career_roles}

#: Common table expression chunks.
CHUNKS_SQL = rf"""{CAREER_SQL},
heads AS (SELECT *, CASE WHEN length(trim(text)) BETWEEN 1 AND 60 AND NOT regexp_matches(trim(text), '^[-*o]\s') THEN {rules.sql_case("upper(trim(text))", rules.section_patterns())} END AS s FROM career),
lined AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER w, 'CONTACT') AS section, count(s) OVER w AS island FROM heads WINDOW w AS (PARTITION BY resume_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
body AS (SELECT resume_id, section, island, line_no, text, CASE WHEN section = 'EXPERIENCE' THEN text LIKE 'Client: %' ELSE section = 'EDUCATION' AND text NOT LIKE '- %' END AS opens FROM lined WHERE s IS NULL),
parts AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY resume_id, island ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS part FROM body),
pieces AS (SELECT resume_id, island, part, 0 AS kind, 0 AS line_no, section, CASE section WHEN 'SKILLS' THEN 'SKILL_SECTION' ELSE section END AS chunk_type, string_agg(regexp_replace(text, '^- ', ''), chr(10) ORDER BY line_no) AS text FROM parts WHERE section <> 'EXPERIENCE' GROUP BY ALL
  UNION ALL SELECT resume_id, island, part, 0, 0, section, 'EXPERIENCE_ROLE', max(text) FILTER (opens) || chr(10) || max(text) FILTER (text LIKE 'Role: %') FROM parts WHERE section = 'EXPERIENCE' GROUP BY ALL
  UNION ALL SELECT resume_id, island, part, 1, line_no, section, 'EXPERIENCE_RESPONSIBILITY', substr(text, 3) FROM parts WHERE section = 'EXPERIENCE' AND text LIKE '- %'
  UNION ALL SELECT resume_id, island, part, 2, line_no, section, 'EXPERIENCE_TECHNOLOGY', substr(text, 14) FROM parts WHERE section = 'EXPERIENCE' AND text LIKE 'Environment: %'),
anchors AS (SELECT resume_id, island, part, (line_no - 1000) // 100 AS role_id FROM parts WHERE section = 'EXPERIENCE' AND opens),
numbered AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY island, part, kind, line_no, text) - 1 AS sequence FROM pieces),
chunks AS (SELECT n.resume_id, sequence, CASE WHEN kind > 0 THEN min(sequence) OVER (PARTITION BY n.resume_id, n.island, n.part) END AS parent_sequence, chunk_type, section, company, title AS role, start_date,
  CASE WHEN is_current THEN DATE '{TODAY}' ELSE end_date END AS end_date, coalesce(is_current, false) AS is_current, text
  FROM numbered n LEFT JOIN anchors a ON n.section = 'EXPERIENCE' AND n.resume_id = a.resume_id AND n.island = a.island AND n.part = a.part LEFT JOIN titled t ON a.role_id = t.role_id)"""
_NAME = "CASE WHEN c_custkey % 3 = 0 THEN 'Ann Number' || translate(c_name, '0123456789#', 'abcdefghij ') END"

ORACLES = {
    "chk14_chk15_chunk_texts": f"""WITH {CHUNKS_SQL} SELECT resume_id, string_agg(text, chr(10) ORDER BY sequence) FILTER (chunk_type = 'SUMMARY') AS summary,
  sha256(coalesce(string_agg(text, chr(10) ORDER BY sequence) FILTER (chunk_type = 'EXPERIENCE_RESPONSIBILITY'), '')) AS bullets_sha256, bool_or(chunk_type = 'EDUCATION') AS education, false AS project, false AS certification, false AS achievement FROM chunks GROUP BY 1""",
    "chk1_to_chk12_career_chunks": f"WITH {CHUNKS_SQL} SELECT resume_id, sequence, coalesce(parent_sequence, -1) AS parent_sequence, chunk_type, section, coalesce(company, '') AS company, coalesce(role, '') AS role, coalesce(CAST(start_date AS VARCHAR), '') AS start_date, coalesce(CAST(end_date AS VARCHAR), '') AS end_date, is_current, sha256(text) AS text_sha256 FROM chunks",
    "chk13_txt8_embedding_texts": f"""WITH {CHUNKS_SQL} SELECT resume_id, sequence, {_NAME} AS name, sha256(concat_ws(chr(10) || chr(10), 'Candidate:' || chr(10) || {_NAME}, 'Company:' || chr(10) || company, 'Role:' || chr(10) || role,
  'Dates:' || chr(10) || start_date || ' to ' || CASE WHEN is_current THEN 'Present' ELSE CAST(end_date AS VARCHAR) END, 'Section:' || chr(10) || section, 'Chunk Type:' || chr(10) || chunk_type, 'Original Text:' || chr(10) || text)) AS embedding_sha256
FROM chunks JOIN customer ON resume_id = c_custkey""",
    "exp1_exp2_exp3_exp9_exp10_career_roles": rf"""WITH {CAREER_SQL}, b AS (SELECT role_id, string_agg(text, '|' ORDER BY n, text) AS responsibilities, count(*) FILTER (text LIKE '%30\%%' ESCAPE '\') AS quantified FROM bullets GROUP BY 1),
e AS (SELECT * REPLACE (CASE WHEN is_current THEN DATE '{TODAY}' ELSE end_date END AS end_date) FROM titled)
SELECT resume_id, row_number() OVER (PARTITION BY resume_id ORDER BY start_date, role_id) AS place, company, title, start_date, end_date, is_current,
  CASE WHEN end_date < start_date THEN 0 ELSE (year(end_date) - year(start_date)) * 12 + month(end_date) - month(start_date) + 1 END AS months,
  coalesce(responsibilities, '') AS responsibilities, 'Spark|SQL|' || tool AS technologies, 1.0::DOUBLE AS confidence, coalesce(quantified, 0) AS quantified FROM e LEFT JOIN b USING (role_id)""",
}
