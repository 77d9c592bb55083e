"""Queries of result tables, re-indexing, catalog roles, nested documents, requests to a model, and bookkeeping of failures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.operators import catalog, chunking, discovery, intake, narrative, roles, sink, verdicts
from tenure.plans import timeline
from tenure.plans.findings import TOOLS
from tenure.sources.careers import CAREER_SQL, TODAY, career_lines, pick, sql_pick
from tenure.sources.tables import read, role_intervals
from tenure.stages import shared_folder, stage

CATEGORIES = ("completeness", "growth", "evidence", "experience")
STRENGTHS = ("WEAK", "STRONG", "NONE")
#: A role catalog over the titles of the career documents: id, title, family, level.
ROLE_CATALOG = (("r1", "Developer", "Engineering", None), ("r2", "Vice President", "Leadership", "Director"), ("r3", "Lead Engineer", "Engineering", "Principal"))
ROLE_ALIASES = (("r2", "Head of Data"),)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def committed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits: all evaluations and their totals, then the second version's totals anew. Readers get the last state of both tables."""
    path = _folder(spark, "results")
    n = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(n.alias("resume_id"), "c_mktsegment", F.when(n % 3 == 0, "scoring-v2").otherwise("scoring-v1").alias("scoring_version"))
    sink.write_results(path, evaluations=rows, totals=rows.select("resume_id", "scoring_version", (F.col("resume_id") % 50).alias("total")))
    sink.write_results(path, totals=rows.where("scoring_version = 'scoring-v2' and resume_id % 2 = 0").select("resume_id", "scoring_version", (F.col("resume_id") % 50 + 100).alias("total")))
    return sink.read_results(spark, path, "evaluations").join(sink.read_results(spark, path, "totals").drop("scoring_version"), "resume_id", "left").select("resume_id", "c_mktsegment", "scoring_version", F.coalesce("total", F.lit(-1)).alias("total"))


def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index a quarter of which has an older embedding version: that part is embedded anew (here: turned round), the rest goes on."""
    path = _folder(spark, "index")
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    old = {**narrative.VERSIONS, "embedding_version": "embedding-v0"}
    sink.write_index(e.where("id % 4 = 0"), path, old)
    sink.write_index(e.where("id % 4 <> 0"), path)
    index, anew = sink.reindex(spark, path, lambda rows: rows.withColumn("vector", F.transform("vector", lambda x: -x)))
    rows = index.join(anew.select("id", F.lit(True).alias("anew")), "id", "left")
    first = F.round(F.get("vector", F.lit(0)).cast("double").cast("decimal(18,8)"), 4).cast("double")
    return rows.select("id", "label", first.alias("first"), "embedding_version", "chunking_version", "vector_index_version", F.coalesce("anew", F.lit(False)).alias("anew"))


def catalog_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(chunking.role_rows(chunking.chunks(career_lines(spark, sf_dir), TODAY)).select("resume_id", "place", "title"), "roles")
    known = spark.createDataFrame(ROLE_CATALOG, "entity string, title string, family string, level string")
    out = roles.with_catalog_roles(rows, known, spark.createDataFrame(ROLE_ALIASES, "entity string, alias string"))
    none = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return out.select("resume_id", "place", "title", none("role_id"), none("canonical_title"), none("family"), "level", "level_source", "ambiguous")


def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, o = F.col("c_custkey"), F.col("o_orderkey")
    half = lambda k: (n % k / 2).alias
    evaluations = read(spark, sf_dir, "customer").select(n.alias("resume_id"), F.when(n % 5 == 0, "PARTIAL").otherwise("COMPLETED").alias("status"), half(7)("completeness"), half(11)("growth"), half(13)("evidence"), half(17)("experience"), half(19)("total"))
    orders = read(spark, sf_dir, "orders")
    parts = orders.select(F.col("o_custkey").alias("resume_id"), pick(CATEGORIES, o).alias("category"), o.cast("int").alias("place"), F.col("o_orderpriority").alias("sub_dimension"), (o % 10 / 2).alias("points"))
    advice = orders.where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("resume_id"), o.cast("int").alias("priority"), F.col("o_orderpriority").alias("title"), F.lit("GROWTH").alias("category"), F.col("o_orderstatus").alias("description"), F.lit("CANDIDATE").alias("audience"))
    return narrative.result_documents(evaluations, parts, advice)


def validation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    option = lambda k: F.struct(F.lit(k + 1).alias("rank"), pick(TOOLS, o + k).alias("skill"), F.lit(0.9).alias("confidence"), F.lit("FUZZY").alias("method"))
    ambiguous = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("resume_id"), F.concat(F.lit("text "), o.cast("string")).alias("text"), o.alias("sequence"), F.lit(0).alias("place"), F.array(option(0), option(1)).alias("candidates"))
    described = spark.createDataFrame([(t, f"about {t}") for t in TOOLS[::2]], "skill string, description string")
    return discovery.validation_requests(ambiguous, described)


def evidence_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    graded = read(spark, sf_dir, "customer").select(n.alias("resume_id"), F.explode(F.array(F.struct(F.lit("aws").alias("skill"), pick(STRENGTHS, n).alias("strength")), F.struct(F.lit("spark").alias("skill"), pick(STRENGTHS, n + 1).alias("strength")))).alias("x")).select("resume_id", "x.*")
    o = F.col("o_orderkey")
    hits = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("resume_id"), F.when(o % 2 == 0, "aws").otherwise("spark").alias("skill"), o.alias("sequence"), (o % 3).cast("double").alias("score"), F.col("o_orderpriority").alias("text"))
    return verdicts.evidence_requests(verdicts.evidence_passages(graded, hits))


def growth_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id"))
    r = F.col("role_id")
    rows = role_intervals(spark, sf_dir).select("resume_id", r.alias("place"), F.concat(F.lit("Firm "), (r % 7).cast("string")).alias("company"), F.lit("Developer").alias("title"), F.col("start").alias("start_date"), F.col("end").alias("end_date"), (r % 36 == 35).alias("is_current"),
                                                F.array(F.concat(F.lit("did "), (r % 3).cast("string"))).alias("responsibilities"), F.array(F.lit("Spark")).alias("technologies"))
    skills = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("resume_id"), F.col("o_orderpriority").alias("skill"))
    return narrative.growth_requests(spine, rows, skills, timeline.career_gaps(spark, sf_dir))


def completeness_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(n.alias("resume_id"), F.when(n % 4 > 0, F.col("c_mktsegment")).alias("summary"), F.col("c_name").alias("recent_title"), F.lit("Engineering").alias("recent_family"), (n % 90).alias("total_months"), (n % 2 == 0).alias("certification"), F.when(n % 3 > 0, n % 3 == 1).alias("project"), (n % 5 == 0).alias("achievement"))
    return narrative.completeness_requests(rows)


def narrative_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    texts = lambda k, w: F.when(n % k > 0, F.transform(F.sequence(F.lit(1), (n % k).cast("int")), lambda i: F.concat(F.lit(w), i.cast("string"))))
    half = lambda k: (n % k / 2)
    rows = read(spark, sf_dir, "customer").select(n.alias("resume_id"), half(7).alias("completeness"), half(11).alias("growth"), half(13).alias("evidence"), half(17).alias("experience"), half(19).alias("total"), texts(3, "warned ").alias("warnings"), texts(4, "grew ").alias("observations"), texts(2, "proved ").alias("highlights"), F.col("c_name").alias("experience_sentence"))
    return narrative.narrative_requests(rows)


def failed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose property isn't a small number fail their stage; the others go on."""
    k = F.get_json_object("props", "$.k")
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(k, F.lit("x"))).otherwise(k).alias("k"))
    out = narrative.isolated(rows, "parse", F.expr("try_cast(k as int)"), F.concat(F.lit("not a number: "), "k"))
    return out.select("event_id", F.coalesce("result", F.lit(-1)).alias("result"), F.coalesce("failed_stage", F.lit("")).alias("failed_stage"), F.coalesce("failure_reason", F.lit("")).alias("failure_reason"))


def inserted_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as a dimension: those of the seed that aren't there yet come in once, the others stay as they are."""
    p = read(spark, sf_dir, "part")
    table = p.where("p_partkey % 3 = 0").groupBy("p_brand").agg(F.min("p_partkey").alias("first_part"))
    return catalog.insert_missing(table, p.groupBy("p_brand").agg(F.min("p_partkey").alias("first_part")), "p_brand").withColumn("first_part", F.col("first_part").cast("long"))


def skill_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored skills as readers see them: removed ones are out, no chunks are an empty list."""
    o = F.col("o_orderkey")
    stored = read(spark, sf_dir, "orders").select(o.alias("row_id"), pick(TOOLS, o).alias("skill"), F.col("o_orderpriority").alias("text"), F.lit(0.5).alias("confidence"), F.lit("EXACT").alias("method"), pick(("AUTO_CONFIRMED", "USER_REMOVED", "USER_CONFIRMED"), o).alias("status"), F.when(o % 2 == 0, F.array(o)).alias("chunks"), (o % 3 == 2).alias("user_modified"))
    rows = intake.skill_view(stored)
    return rows.withColumn("source_chunk_ids", F.array_join(F.col("source_chunk_ids").cast("array<string>"), ","))


def undated_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Career documents whose work history has no dates: one role without a header of its own, a piece for each line."""
    fixed = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id"), F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("line_no"), F.col("c_name").alias("text")), F.struct(F.lit(-1).cast("long").alias("line_no"), F.lit("Work History").alias("text")))).alias("x")).select("resume_id", "x.*")
    lines = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("resume_id"), F.col("o_orderkey").alias("line_no"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "- ").otherwise(""), F.lit("Handled "), F.lower("o_orderpriority")).alias("text"))
    lines = lines.withColumn("text", F.regexp_replace("text", r"\d-", ""))
    rows = chunking.chunks(fixed.unionByName(lines), TODAY)
    return rows.select("resume_id", "sequence", F.coalesce("parent_sequence", F.lit(-1)).alias("parent_sequence"), "chunk_type", F.coalesce("start_date", F.lit("0001-01-01").cast("date")).cast("string").alias("since"), "is_current", "text")


QUERIES = {
    "io11_committed_results": committed_results, "run3_ret11_ret12_reindexed": reindexed, "exp8_catalog_roles": catalog_roles, "io12_result_documents": result_documents, "dsc6_validation_requests": validation_requests,
    "evd4_evidence_requests": evidence_requests, "scr18_growth_requests": growth_requests, "scr21_completeness_requests": completeness_requests, "jus4_narrative_requests": narrative_requests,
    "run2_failed_categories": failed_categories, "io6_inserted_dimensions": inserted_dimensions, "io13_skill_views": skill_views, "chk10_undated_sections": undated_sections,
}

_R4 = "CAST(round(CAST({x} AS DECIMAL(18,8)), 4) AS DOUBLE)"
_NONE = "[]::STRUCT(sub_dimension VARCHAR, points DOUBLE)[]"
_SUBS = ", ".join(f"'{c}': coalesce((SELECT list({{'sub_dimension': sub_dimension, 'points': points}} ORDER BY place) FROM p WHERE p.resume_id = c_custkey AND category = '{c}'), {_NONE})" for c in CATEGORIES)
_HALVES = ", ".join(f"'{c}': (c_custkey % {k}) / 2::DOUBLE" for c, k in zip((*CATEGORIES, "total"), (7, 11, 13, 17, 19), strict=True))

ORACLES = {
    "io11_committed_results": """SELECT c_custkey AS resume_id, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'scoring-v2' ELSE 'scoring-v1' END AS scoring_version,
  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 50 WHEN c_custkey % 2 = 0 THEN c_custkey % 50 + 100 ELSE -1 END AS total FROM customer""",
    "run3_ret11_ret12_reindexed": f"""SELECT vec_id AS id, label, {_R4.format(x="CASE WHEN vec_id % 4 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END")} AS first, 'embedding-v1' AS embedding_version, 'chunking-v1' AS chunking_version,
  'vector-index-v1' AS vector_index_version, vec_id % 4 = 0 AS anew FROM embeddings""",
    "exp8_catalog_roles": f"""WITH {CAREER_SQL}, known(role_id_, t, family, given) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in ROLE_CATALOG)}),
r AS (SELECT resume_id, role_id, title, row_number() OVER w AS place, {timeline._LEVEL} AS own FROM titled WINDOW w AS (PARTITION BY resume_id ORDER BY start_date, role_id)),
c AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY resume_id ORDER BY place ROWS UNBOUNDED PRECEDING), 'Mid-Level') AS carried FROM r)
SELECT resume_id, place, title, coalesce(role_id_, '') AS role_id, coalesce(t, '') AS canonical_title, coalesce(family, '') AS family, coalesce(given, carried) AS level,
  CASE WHEN given IS NOT NULL THEN 'catalog' WHEN own IS NOT NULL THEN 'rule' ELSE 'inherited' END AS level_source, own IS NULL AS ambiguous
FROM c LEFT JOIN known ON t = CASE title WHEN 'Head of Data' THEN 'Vice President' ELSE title END""",
    "io12_result_documents": f"""WITH p AS (SELECT o_custkey AS resume_id, {sql_pick(CATEGORIES, "o_orderkey")} AS category, o_orderkey AS place, o_orderpriority AS sub_dimension, (o_orderkey % 10) / 2::DOUBLE AS points FROM orders),
a AS (SELECT o_custkey AS resume_id, list({{'priority': o_orderkey::INT, 'title': o_orderpriority, 'category': 'GROWTH', 'description': o_orderstatus, 'audience': 'CANDIDATE'}} ORDER BY o_orderkey) AS advice FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
SELECT c_custkey AS resume_id, CAST(to_json({{'status': CASE WHEN c_custkey % 5 = 0 THEN 'PARTIAL' ELSE 'COMPLETED' END, 'scores': {{{_HALVES}}}, 'sub_scores': {{{_SUBS}}},
  'recommendations': coalesce(advice, [])}}) AS VARCHAR) AS document FROM customer LEFT JOIN a ON resume_id = c_custkey""",
    "dsc6_validation_requests": f"""WITH t AS (SELECT o_custkey AS resume_id, o_orderkey, {sql_pick(TOOLS, "o_orderkey")} AS a, {sql_pick(TOOLS, "(o_orderkey + 1)")} AS b FROM orders)
SELECT resume_id, CAST(to_json({{'items': list({{'detected_text': 'text ' || o_orderkey, 'candidates': [{{'canonical_name': a, 'description': CASE WHEN a IN {TOOLS[::2]} THEN 'about ' || a ELSE '' END}},
  {{'canonical_name': b, 'description': CASE WHEN b IN {TOOLS[::2]} THEN 'about ' || b ELSE '' END}}]}} ORDER BY o_orderkey)}}) AS VARCHAR) AS request FROM t GROUP BY 1""",
    "evd4_evidence_requests": f"""WITH g AS (SELECT c_custkey AS resume_id, unnest(['aws', 'spark']) AS skill, unnest([{sql_pick(STRENGTHS, "c_custkey")}, {sql_pick(STRENGTHS, "(c_custkey + 1)")}]) AS strength FROM customer),
h AS (SELECT o_custkey AS resume_id, CASE WHEN o_orderkey % 2 = 0 THEN 'aws' ELSE 'spark' END AS skill, o_orderkey, o_orderpriority AS text FROM orders),
p AS (SELECT h.*, row_number() OVER (PARTITION BY resume_id, skill ORDER BY o_orderkey % 3 DESC, o_orderkey) - 1 AS i FROM h JOIN g USING (resume_id, skill) WHERE strength <> 'STRONG'),
s AS (SELECT resume_id, skill, list({{'passage_index': i, 'text': text}} ORDER BY i) AS passages FROM p GROUP BY 1, 2)
SELECT resume_id, CAST(to_json({{'skills': list({{'skill': skill, 'passages': passages}} ORDER BY skill)}}) AS VARCHAR) AS request FROM s GROUP BY 1""",
    "scr18_growth_requests": f"""WITH {timeline._UNION}, o AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY start_date, role_id) - 1 AS i FROM roles),
r AS (SELECT resume_id, list({{'sequence': i, 'company': 'Firm ' || (role_id % 7), 'title': 'Developer', 'start_date': start_date, 'end_date': end_date, 'is_current': role_id % 36 = 35, 'responsibilities': ['did ' || (role_id % 3)], 'technologies': ['Spark']}} ORDER BY i) AS roles FROM o GROUP BY 1),
s AS (SELECT o_custkey AS resume_id, list_sort(list(DISTINCT o_orderpriority)) AS skills FROM orders GROUP BY 1),
n AS (SELECT *, lag(end_date) OVER (PARTITION BY resume_id ORDER BY start_date, end_date, role_id) AS p FROM roles),
d AS (SELECT resume_id, p AS a, start_date AS b, (year(start_date) - year(p)) * 12 + month(start_date) - month(p) AS m FROM n WHERE start_date > p AND (year(start_date) - year(p)) * 12 + month(start_date) - month(p) >= 6),
g AS (SELECT resume_id, list({{'gap_start': a, 'gap_end': b, 'duration_months': m}} ORDER BY a, b, m) AS gaps FROM d GROUP BY 1)
SELECT c_custkey AS resume_id, CAST(to_json({{'roles': coalesce(r.roles, []), 'verified_skills': coalesce(skills, []), 'documented_gaps': coalesce(gaps, [])}}) AS VARCHAR) AS request
FROM customer LEFT JOIN r ON c_custkey = r.resume_id LEFT JOIN s ON c_custkey = s.resume_id LEFT JOIN g ON c_custkey = g.resume_id""",
    "scr21_completeness_requests": """SELECT c_custkey AS resume_id, CAST(to_json({'summary_text': CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE '' END, 'most_recent_title': c_name, 'most_recent_role_family': 'Engineering',
  'actual_total_years_experience': CAST(CAST(round((c_custkey % 90) / 12, 1) AS DECIMAL(10,1)) AS VARCHAR), 'sections_absent': list_filter([CASE WHEN c_custkey % 2 <> 0 THEN 'certifications' END, CASE WHEN c_custkey % 3 <> 1 THEN 'projects' END,
  CASE WHEN c_custkey % 5 <> 0 THEN 'achievements' END], lambda x: x IS NOT NULL)}) AS VARCHAR) AS request FROM customer""",
    "jus4_narrative_requests": f"""SELECT c_custkey AS resume_id, CAST(to_json({{'scores': {{{_HALVES}}}, 'completeness_warnings': list_transform(range(1, c_custkey % 3 + 1), lambda i: 'warned ' || i), 'growth_observations': list_transform(range(1, c_custkey % 4 + 1), lambda i: 'grew ' || i),
  'evidence_highlights': list_transform(range(1, c_custkey % 2 + 1), lambda i: 'proved ' || i), 'experience_summary': c_name}}) AS VARCHAR) AS request FROM customer""",
    "run2_failed_categories": """WITH k AS (SELECT event_id, json_extract_string(props, '$.k') || CASE WHEN event_id % 3 = 0 THEN 'x' ELSE '' END AS k FROM events)
SELECT event_id, coalesce(try_cast(k AS INTEGER), -1) AS result, CASE WHEN try_cast(k AS INTEGER) IS NULL THEN 'parse' ELSE '' END AS failed_stage, CASE WHEN try_cast(k AS INTEGER) IS NULL THEN coalesce('not a number: ' || k, '') ELSE '' END AS failure_reason FROM k""",
    "io6_inserted_dimensions": "SELECT p_brand, coalesce(min(p_partkey) FILTER (p_partkey % 3 = 0), min(p_partkey)) AS first_part FROM part GROUP BY 1",
    "io13_skill_views": f"""SELECT o_orderkey AS resume_skill_id, {sql_pick(TOOLS, "o_orderkey")} AS canonical_name, o_orderpriority AS detected_text, 0.5::DOUBLE AS confidence, 'EXACT' AS detection_method,
  CASE o_orderkey % 3 WHEN 0 THEN 'AUTO_CONFIRMED' ELSE 'USER_CONFIRMED' END AS verification_status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE '' END AS source_chunk_ids, o_orderkey % 3 = 2 AS user_modified FROM orders WHERE o_orderkey % 3 <> 1""",
    "chk10_undated_sections": """WITH l AS (SELECT o_custkey AS resume_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, 'Handled ' || regexp_replace(lower(o_orderpriority), '\\d-', '') AS text FROM orders)
SELECT c_custkey AS resume_id, 0 AS sequence, -1 AS parent_sequence, 'CONTACT' AS chunk_type, '0001-01-01' AS since, false AS is_current, c_name AS text FROM customer
UNION ALL SELECT DISTINCT resume_id, 1, -1, 'EXPERIENCE_ROLE', '0001-01-01', false, '(Undated experience entries)' FROM l
UNION ALL SELECT resume_id, i + 1, 1, 'EXPERIENCE_RESPONSIBILITY', '0001-01-01', false, text FROM l""",
}
