"""Queries of lines, words and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions import rules
from tenure.operators import text
from tenure.sources.tables import read


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.block_ids(_paged(spark, sf_dir))
    return rows.select("block_id", "sequence", F.sha2(text.normalized(F.col("text")), 256).alias("line_sha256"))


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents on pages of four."""
    return text.lines(read(spark, sf_dir, "documents")).withColumn("page", (F.floor(F.col("line_no") / 4) + 1).cast("int"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    pages = _paged(spark, sf_dir).groupBy("doc_id", "page").agg(raw.alias("raw")).withColumn("normalized", text.normalized(F.col("raw")))
    rows = text.document_texts(pages)
    return rows.select("doc_id", "n_pages", F.sha2("raw_text", 256).alias("raw_sha256"), F.sha2("normalized_text", 256).alias("normalized_sha256"))


def unrecognized_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all whole lines, and of each line's first words as a line of its own: as they are, in title case and in capitals, by line number."""
    rows = text.lines(read(spark, sf_dir, "documents")).withColumn("text", F.translate("text", "ß", "s"))  # engines differ on its capital
    n, start = F.col("line_no") % 3, F.regexp_extract("text", r"^\S+(?: \S+){0,3}", 0)
    first = F.when(n == 0, start).when(n == 1, F.upper(start)).otherwise(F.concat(F.upper(F.substring(start, 1, 1)), F.lower(F.expr("substring(regexp_extract(text, '^[^ ]+', 0), 2)"))))
    whole = F.when(n == 1, F.upper("text")).otherwise(F.col("text"))
    both = F.array(F.struct(F.lit("whole").alias("part"), whole.alias("text")), F.struct(F.lit("first").alias("part"), first.alias("text")))
    rows = rows.select("doc_id", "line_no", F.explode(both).alias("x")).select("doc_id", "line_no", "x.*")
    return text.unrecognized_headings(rows, "doc_id").select("doc_id", "line_no", "part", "text")


def hyphen_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.lines(read(spark, sf_dir, "documents"))
    n = F.col("line_no")
    marked = F.when(n % 7 == 3, F.concat("text", F.lit("-"))).when(n % 7 == 4, F.concat(F.lower(F.substring("text", 1, 1)), F.expr("substring(text, 2)"))).otherwise(F.col("text"))
    return text.merge_hyphens(rows.withColumn("text", marked)).select("doc_id", "line_no", F.sha2("text", 256).alias("text_sha256"))


def _placed_words(spark: SparkSession, sf_dir: str, page=None, bottom=lambda n: n) -> DataFrame:
    """(doc_id, words): a document's words with their places, and with ``page(line_no)``; lines are 12 apart."""

    def word(n, i, w):
        x0, low = i * 10, (bottom(n) * 12 + i % 3 - 1).cast("double")
        pages = [page(n).alias("page")] if page else []
        return F.struct(*pages, x0.alias("x0"), (x0 + 1 + F.length(w) % 9).alias("x1"), (low - 8).alias("top"), low.alias("bottom"), w.alias("text"))

    return read(spark, sf_dir, "documents").select("doc_id", text.listed_words(F.col("text"), word).alias("words"))


def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.cluster_listed_words(_placed_words(spark, sf_dir))
    return rows.select("doc_id", F.col("line_key").cast("long").alias("line_key"), "box.*", "n_words", F.sha2("text", 256).alias("text_sha256"))


def page_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by document and page: a hyphen at a page's end stays."""
    rows = _paged(spark, sf_dir)
    n = F.col("line_no")
    marked = F.when(n % 7 < 5, F.concat("text", F.lit("-"))).when(n % 7 == 5, F.concat(F.lower(F.substring("text", 1, 1)), F.expr("substring(text, 2)"))).otherwise(F.col("text"))
    rows = rows.withColumn("text", F.when(n % 7 == 4, F.concat(F.lower(F.substring("text", 1, 1)), F.expr("substring(text, 2)"), F.lit("-"))).otherwise(marked))
    return text.merge_hyphens(rows, ["doc_id", "page"]).select("doc_id", "page", "line_no", F.sha2("text", 256).alias("text_sha256"))


def page_word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose places start anew on each page: lines of two pages at one height don't meet."""
    words = _placed_words(spark, sf_dir, lambda n: (F.floor(n / 4) + 1).cast("int"), lambda n: n % 4)
    rows = text.cluster_listed_words(words, page="page")
    return rows.select("doc_id", "page", F.col("line_key").cast("long").alias("line_key"), "box.*", "n_words", F.sha2("text", 256).alias("text_sha256"))


def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with the page of their heading, or of their first line."""
    rows = _resume_lines(spark, sf_dir).withColumn("page", (F.floor(F.col("line_no") / 3) % 1000 + 1).cast("int"))
    return text.sections(rows, page="page").select("resume_id", "place", "section", "page", "n_lines")


def _resume_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a career document per customer: contact, summary, a role per order, education."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id"), "c_name", "c_mktsegment")
    fixed = ((0, F.col("c_name")), (1, F.lit("phone 555-0100")), (2, F.lit("Professional Summary")), (3, F.concat(F.lit("Worked for years in "), F.lower("c_mktsegment")))
             , (4, F.lit("Work History")), (1_000_000_000, F.lit("Education")), (1_000_000_001, F.lit("State College, 1990")))
    lines = c.select("resume_id", F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("line_no"), t.alias("text")) for n, t in fixed])).alias("x")).select("resume_id", "x.*")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("resume_id"), (F.col("o_orderkey") + 5).alias("line_no"), F.concat(F.lit("Client: "), "o_orderpriority", F.lit(" since "), F.year("o_orderdate").cast("string")).alias("text"))
    return lines.unionByName(o)


def resume_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.sections(_resume_lines(spark, sf_dir)).withColumn("blocks", F.array_join(F.col("blocks").cast("array<string>"), ","))


def sections_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.present_sections(text.sections(_resume_lines(spark, sf_dir)), ["CONTACT", "EXPERIENCE", "SKILLS", "EDUCATION"])


QUERIES = {"txt7_document_texts": document_texts, "sec3_unrecognized_headings": unrecognized_headings, "sec7_sections_present": sections_present, "txt4_page_hyphens": page_hyphens, "txt1_txt2_page_word_lines": page_word_lines, "sec5_section_pages": section_pages, "txt3_txt5_txt6_document_lines": document_lines, "txt4_hyphen_merge": hyphen_merge, "txt1_txt2_word_lines": word_lines, "sec1_to_sec6_resume_sections": resume_sections}

_LINES = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
full_lines AS (SELECT * FROM lines WHERE regexp_matches(text, '\S'))"""
_CASE = rules.sql_case("upper(trim(text))", rules.section_patterns())

_SECTIONED = rf"""WITH l AS (
  SELECT c_custkey AS resume_id, unnest([0, 1, 2, 3, 4, 1000000000, 1000000001]) AS line_no, unnest([c_name, 'phone 555-0100', 'Professional Summary', 'Worked for years in ' || lower(c_mktsegment), 'Work History', 'Education', 'State College, 1990']) AS text FROM customer
  UNION ALL SELECT o_custkey, o_orderkey + 5, 'Client: ' || o_orderpriority || ' since ' || year(o_orderdate) FROM orders),
h AS (SELECT *, CASE WHEN length(trim(text)) BETWEEN 1 AND 60 AND NOT regexp_matches(trim(text), '^[-*o•●▪]\s') THEN {_CASE} END AS s FROM l),
i AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER w, 'CONTACT') AS section, count(s) OVER w AS island FROM h WINDOW w AS (PARTITION BY resume_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
"""

ORACLES = {
    "txt4_page_hyphens": rf"""WITH {_LINES}, m AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(line_no // 4 + 1 AS INTEGER) AS page,
  CASE WHEN line_no % 7 = 4 THEN lower(substr(text, 1, 1)) || substr(text, 2) || '-' WHEN line_no % 7 < 4 THEN text || '-' WHEN line_no % 7 = 5 THEN lower(substr(text, 1, 1)) || substr(text, 2) ELSE text END AS text FROM full_lines),
p AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS b FROM m),
g AS (SELECT *, sum(CASE WHEN coalesce(b LIKE '%-' AND b NOT LIKE '%--' AND regexp_matches(text, '^\p{{Ll}}'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS i FROM p)
SELECT doc_id, page, min(line_no) AS line_no, sha256(string_agg(text, '' ORDER BY line_no)) AS text_sha256 FROM g GROUP BY doc_id, page, i""",
    "txt1_txt2_page_word_lines": rf"""WITH {_LINES}, w AS (SELECT doc_id, line_no, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM full_lines),
k AS (SELECT doc_id, CAST(line_no // 4 + 1 AS INTEGER) AS page, text, i * 10 AS x0, line_no % 4 * 12 + i % 3 - 1 AS bottom, CAST(round_even((line_no % 4 * 12 + i % 3 - 1) / 4.0, 0) * 4 AS BIGINT) AS line_key FROM w)
SELECT doc_id, page, line_key, CAST(min(x0) AS INTEGER) AS x0, CAST(max(x0 + 1 + length(text) % 9) AS INTEGER) AS x1, CAST(min(bottom) - 8 AS DOUBLE) AS top, CAST(max(bottom) AS DOUBLE) AS bottom, count(*) AS n_words,
  sha256(string_agg(text, ' ' ORDER BY x0, text)) AS text_sha256 FROM k GROUP BY doc_id, page, line_key HAVING trim(string_agg(text, ' ')) <> ''""",
    "sec5_section_pages": f"""WITH {_SECTIONED.removeprefix("WITH ")} SELECT resume_id, row_number() OVER (PARTITION BY resume_id ORDER BY island) - 1 AS place, any_value(section) AS section, CAST(arg_min(line_no // 3 % 1000 + 1, line_no) AS INTEGER) AS page,
  count(*) FILTER (s IS NULL) AS n_lines FROM i GROUP BY resume_id, island HAVING count(*) FILTER (s IS NULL) > 0""",

    "txt3_txt5_txt6_document_lines": rf"""WITH {_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS sequence FROM full_lines)
SELECT doc_id || ':p' || (line_no // 4 + 1) || ':b' || sequence AS block_id, sequence, sha256(trim(regexp_replace(text, '[ \t]+', ' ', 'g'))) AS line_sha256 FROM n""",
    "txt7_document_texts": rf"""WITH {_LINES}, p AS (SELECT doc_id, line_no // 4 + 1 AS page, string_agg(text, chr(10) ORDER BY line_no) AS raw,
  trim(string_agg(trim(regexp_replace(text, '[ \t]+', ' ', 'g')), chr(10) ORDER BY line_no)) AS normal FROM full_lines GROUP BY ALL)
SELECT doc_id, count(*) AS n_pages, sha256(string_agg('--- PAGE ' || page || ' ---' || chr(10) || raw, chr(10) ORDER BY page)) AS raw_sha256, sha256(string_agg(normal, chr(10) || chr(10) ORDER BY page)) AS normalized_sha256 FROM p GROUP BY 1""",
    "sec3_unrecognized_headings": rf"""WITH {_LINES}, s AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, replace(text, 'ß', 's') AS l, regexp_extract(replace(text, 'ß', 's'), '^\S+(?: \S+){{0,3}}') AS b, regexp_extract(replace(text, 'ß', 's'), '^[^ ]+') AS w FROM full_lines),
t AS (SELECT doc_id, line_no, 'first' AS part, CASE line_no % 3 WHEN 0 THEN b WHEN 1 THEN upper(b) ELSE upper(substr(b, 1, 1)) || lower(substr(w, 2)) END AS text FROM s
  UNION ALL SELECT doc_id, line_no, 'whole', CASE line_no % 3 WHEN 1 THEN upper(l) ELSE l END FROM s)
SELECT * FROM t WHERE length(trim(text)) BETWEEN 1 AND 40 AND NOT regexp_matches(trim(text), '[@\d]|[.,;:]$') AND NOT regexp_matches(trim(text), '^[-*o•●▪]\s') AND len(regexp_split_to_array(trim(text), '\s+')) <= 5
  AND (trim(text) = upper(trim(text)) OR (regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(text, '(^|\P{{L}})\p{{Ll}}|\p{{L}}\p{{Lu}}'))) AND {rules.sql_case("upper(text)", rules.section_patterns())} IS NULL""",
    "txt4_hyphen_merge": rf"""WITH {_LINES}, m AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN line_no % 7 = 3 THEN text || '-' WHEN line_no % 7 = 4 THEN lower(substr(text, 1, 1)) || substr(text, 2) ELSE text END AS text FROM full_lines),
p AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM m),
g AS (SELECT *, sum(CASE WHEN coalesce(b LIKE '%-' AND b NOT LIKE '%--' AND regexp_matches(text, '^\p{{Ll}}'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS i FROM p)
SELECT doc_id, min(line_no) AS line_no, sha256(string_agg(text, '' ORDER BY line_no)) AS text_sha256 FROM g GROUP BY doc_id, i""",
    "txt1_txt2_word_lines": rf"""WITH {_LINES}, w AS (SELECT doc_id, line_no, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM full_lines),
k AS (SELECT doc_id, text, i * 10 AS x0, line_no * 12 + i % 3 - 1 AS bottom, CAST(round_even((line_no * 12 + i % 3 - 1) / 4.0, 0) * 4 AS BIGINT) AS line_key FROM w)
SELECT doc_id, line_key, CAST(min(x0) AS INTEGER) AS x0, CAST(max(x0 + 1 + length(text) % 9) AS INTEGER) AS x1, CAST(min(bottom) - 8 AS DOUBLE) AS top, CAST(max(bottom) AS DOUBLE) AS bottom, count(*) AS n_words, sha256(string_agg(text, ' ' ORDER BY x0, text)) AS text_sha256 FROM k GROUP BY doc_id, line_key HAVING trim(string_agg(text, ' ')) <> ''""",
    "sec1_to_sec6_resume_sections": rf"""{_SECTIONED}SELECT resume_id, row_number() OVER (PARTITION BY resume_id ORDER BY island) - 1 AS place, any_value(section) AS section, CASE WHEN island = 0 THEN 0.5::DOUBLE ELSE 0.95::DOUBLE END AS confidence, count(*) AS n_lines,
  string_agg(line_no, ',' ORDER BY line_no) AS blocks, string_agg(text, chr(10) ORDER BY line_no) AS text
FROM i WHERE s IS NULL GROUP BY resume_id, island""",
    "sec7_sections_present": "SELECT c_custkey AS resume_id, true AS has_contact, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_experience, false AS has_skills, true AS has_education FROM customer",
}
