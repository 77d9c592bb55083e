"""Queries of ambiguous skills and verdicts, evidence verdicts, gap notes, recommendations, narratives and result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.operators import chunking, discovery, intervals, narrative, scoring, verdicts
from tenure.plans import assessment, entities, timeline
from tenure.sources.careers import TODAY, pick, sql_pick
from tenure.sources.tables import ROLES_SQL, read, role_intervals
from tenure.stages import stage

TOOLS = ("docker", "kubernetes", "aws", "mysql", "oracle-database", "spark")
GIVEN = ("STRONG", "MODERATE", "WEAK", "NONE", "odd")


def _misspelt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Skills sections with a part's name less its third letter, and the catalog of names."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    name = F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)"))
    chunked = read(spark, sf_dir, "customer").join(part, F.col("c_custkey") == F.col("p_partkey")).select(F.col("c_custkey").alias("resume_id"), F.lit(0).cast("long").alias("sequence"), F.lit("SKILL_SECTION").alias("chunk_type"), name.alias("text"))
    return chunked, part.select(F.col("p_name").alias("skill")).distinct()


def judged_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked, names = _misspelt(spark, sf_dir)
    n = F.col("resume_id") % 3
    given = chunked.select("resume_id", "text", n.alias("n")).join(names.select("skill", F.concat(F.substring("skill", 1, 2), F.expr("substring(skill, 4)")).alias("text")), "text")
    given = given.groupBy("resume_id", "text", "n").agg(F.min("skill").alias("chosen")).where("n > 0").select("resume_id", "text", F.when(F.col("n") == 2, F.col("chosen")).alias("chosen"), F.when(F.col("resume_id") % 2 == 0, 0.9).alias("confidence"))
    found = discovery.stored_skills(discovery.discover(chunked, names, verdicts=given))
    return found.select("resume_id", "row_id", "skill", "text", F.round(F.col("confidence").cast("decimal(18,8)"), 4).cast("double").alias("confidence"), "method", "status", F.size("chunks").alias("n_chunks"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    graded = read(spark, sf_dir, "customer").select(n.alias("resume_id"), pick(TOOLS, n).alias("skill"), F.lit(0).alias("sources"), pick(verdicts.STRENGTHS, n).alias("strength"), F.lit("SKILLS_SECTION_ONLY").alias("kind"), F.when(n % 4 > 0, F.array(*[n * 10 + k for k in range(5)])).otherwise(F.array().cast("array<bigint>")).alias("evidence"))
    hits = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("resume_id"), pick(TOOLS, F.col("o_custkey")).alias("skill"), F.col("o_orderkey").alias("sequence"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("text"))
    passages = verdicts.evidence_passages(graded, hits)
    answers = graded.select("resume_id", "skill", pick(GIVEN, F.col("resume_id")).alias("strength"), (F.col("resume_id") % 9 - 1).cast("int").alias("passage_index"), F.concat(F.lit("Used "), pick(TOOLS, F.col("resume_id") + F.col("resume_id") % 2)).alias("explanation"))
    checked = verdicts.checked_verdicts(answers, passages, verdicts.sibling_groups(spark))
    return verdicts.evidence_rows(verdicts.upgraded(graded, checked))


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).withColumn("explanation", F.coalesce("explanation", F.lit("")))


def skill_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_orderkey")
    rows = read(spark, sf_dir, "lineitem").select(n.alias("resume_id"), F.concat(F.lit("s"), (F.col("l_linenumber") % 2).cast("string")).alias("skill"), pick(("EXPLICIT_IMPLEMENTATION", "RESPONSIBILITY_USAGE", "INFERRED", "SKILLS_SECTION_ONLY"), n + F.col("l_linenumber")).alias("kind"))
    return verdicts.skill_flags(rows)


def _gaps(spark, sf_dir):
    return intervals.gaps(role_intervals(spark, sf_dir), "resume_id", order=("role_id",))


def gap_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = _gaps(spark, sf_dir)
    said = gaps.groupBy("resume_id").agg(F.array(F.concat(F.lit("Ask about "), F.min("gap_start").cast("string"))).alias("notes")).where("resume_id % 2 = 0")
    rows = narrative.with_gap_notes(said, gaps)
    return rows.select("resume_id", F.size("notes").alias("n_notes"), F.array_join("notes", "|").alias("notes"))


def _assessed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunked, skills = assessment._skills(spark, sf_dir)
    spine = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id"))
    graded = discovery.grade_skills(skills, chunked)
    facts = stage(scoring.facts(spine, chunked, stage(chunking.role_rows(chunked), "roles"), graded), "facts")
    growth = entities.growth_scores(spark, sf_dir).withColumn("leadership", F.when(F.col("resume_id") % 2 == 0, "LOW").otherwise("HIGH"))
    n = F.col("resume_id")
    given = spine.select("resume_id", (n % 2 == 0).alias("summary_outdated"), (n % 3 == 0).alias("summary_generic"), F.when(n % 4 == 0, "Old summary.").alias("summary_reason"), F.when(n % 5 == 0, F.array(F.lit("projects"), F.lit("certifications"))).alias("not_expected"), F.when(n % 7 == 0, F.array(F.lit("Dates differ."))).alias("contradictions"))
    return scoring.with_verdicts(facts, given), graded, scoring.assess(facts, TODAY, growth, verdicts=given)


def judged_sub_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.sub_scores(_assessed(spark, sf_dir)[0], TODAY).select("resume_id", "category", "sub_dimension", "points")


def recommendation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = narrative.recommendations(_assessed(spark, sf_dir)[2])
    return rows.select("resume_id", "priority", "title", "category", "audience", "description")


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the timeline, merged with a model's narrative for every third document."""
    rows = role_intervals(spark, sf_dir).groupBy("resume_id").agg(F.count("*").alias("roles")).join(timeline.total_experience(spark, sf_dir), "resume_id")
    strong = narrative.highlights(read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("resume_id"), F.col("o_orderpriority").alias("skill")).agg(F.when(F.count("*") > 2, "STRONG").otherwise("WEAK").alias("strength")), most=2)
    warned = F.array(*[F.lit(f"w{k}") for k in range(5)])
    n = F.col("resume_id")
    rows = rows.join(strong, "resume_id").select("resume_id", narrative.experience_sentence(F.col("total_months"), F.col("roles")).alias("experience_sentence"), "highlights", F.when(n % 2 == 0, F.array(F.lit("Grew."), F.lit("Led."), F.lit("More."))).alias("observations"), warned.alias("warnings"), F.array(F.lit("note")).alias("notes"))
    given = rows.where("resume_id % 3 = 0").select("resume_id", F.when(n % 2 == 1, "Fine.").alias("overall_assessment"), F.array(F.lit("s")).alias("strengths"), F.lit(None).cast("array<string>").alias("weaknesses"), F.array(F.lit("k")).alias("key_risks"))
    out = narrative.narratives(rows, given)
    return out.select("resume_id", "overall_assessment", *[F.array_join(c, "|").alias(c) for c in ("strengths", "weaknesses", "key_risks", "interview_preparation")])


QUERIES = {
    "dsc4_dsc7_dsc8_dsc10_judged_skills": judged_skills, "evd4_to_evd8_evidence_rows": evidence_rows, "evd9_skill_flags": skill_flags, "scr19_gap_notes": gap_notes,
    "scr9_scr13_judged_sub_scores": judged_sub_scores, "rec2_to_rec5_recommendation_texts": recommendation_texts, "jus1_jus2_jus3_narratives": narratives,
}

_R4 = "CAST(round(CAST({x} AS DECIMAL(18,8)), 4) AS DOUBLE)"
_ROLES = ROLES_SQL.format(spread=36)
_GAPS = f"""{_ROLES}, n AS (SELECT *, lag(end_date) OVER (PARTITION BY resume_id ORDER BY start_date, end_date, role_id) AS p FROM roles),
gaps AS (SELECT resume_id, p AS a, start_date AS b, (year(start_date) - year(p)) * 12 + month(start_date) - month(p) AS m FROM n WHERE start_date > p AND (year(start_date) - year(p)) * 12 + month(start_date) - month(p) >= 6)"""
_S = "list_position(['NONE', 'WEAK', 'MODERATE', 'STRONG'], {x})"
_EXPECTED = "this is typically expected for this candidate''s profile."

# all parts of the three fixed categories, with the verdicts of the query
_p = assessment._p
_DAYS = f"date_diff('day', last_end, DATE '{TODAY}')"
_IF = "CASE WHEN roles > 0 THEN {x} ELSE 0 END"
_SKILLED = "CASE WHEN skills > 0 THEN {x} ELSE 0 END"
_SUB_SCORES = (
    ("experience", "documented_magnitude", _IF.format(x=_p("8 * (0.5 + 0.5 * least(1.0::DOUBLE, total_months / 24.0::DOUBLE))"))), ("experience", "role_depth", _IF.format(x=_p("5 * least(1.0::DOUBLE, depth / 5)"))),
    ("experience", "skill_supported_experience", _IF.format(x=_p("CASE WHEN skills > 0 THEN 5.0::DOUBLE * (strong + moderate) / skills END"))),
    ("experience", "current_freshness", _IF.format(x=_p(f"CASE WHEN cur OR {_DAYS} < 180 THEN 4.0::DOUBLE ELSE greatest(0.0::DOUBLE, 4 * (1 - {_DAYS} / 365.0::DOUBLE / 3)) END"))),
    ("experience", "claimed_consistency", _IF.format(x="CASE WHEN abs(total_months / 12.0::DOUBLE - claimed) >= 3 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END")),
    ("evidence", "core_skill_evidence", _SKILLED.format(x=_p("12.0::DOUBLE * strong / skills"))), ("evidence", "supporting_evidence", _SKILLED.format(x=_p("8.0::DOUBLE * (strong + moderate) / skills"))),
    ("evidence", "project_evidence", _SKILLED.format(x="CASE WHEN strong >= 3 THEN 5 WHEN strong >= 1 THEN 3 ELSE 2 END")),
    ("completeness", "contact", "CASE WHEN resume_id % 4 = 0 THEN 0 ELSE 2 END"), ("completeness", "summary_quality", "3 - CASE WHEN resume_id % 2 = 0 THEN 1.5::DOUBLE ELSE 0 END - CASE WHEN resume_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END"),
    ("completeness", "experience_detail", _IF.format(x="5")), ("completeness", "technical_skills", "least(3, skills)"), ("completeness", "education_present", "2"),
    *[("completeness", d, "CASE WHEN resume_id % 5 = 0 THEN 1.4::DOUBLE ELSE 0 END") for d in ("projects", "certifications")], ("completeness", "achievements", "0"), ("completeness", "clarity", _IF.format(x="2")),
    ("completeness", "freshness_consistency", f"CASE WHEN {assessment._YEARS} - claimed >= 3 THEN 1.5::DOUBLE ELSE 3.0::DOUBLE END - CASE WHEN resume_id % 7 = 0 THEN 0.5::DOUBLE ELSE 0 END"),
)

ORACLES = {
    "dsc4_dsc7_dsc8_dsc10_judged_skills": rf"""WITH names AS (SELECT DISTINCT p_name AS skill, replace(p_name, ' ', '') AS k FROM part), c AS (SELECT c_custkey AS resume_id, substr(p_name, 1, 2) || substr(p_name, 4) AS text FROM customer JOIN part ON p_partkey = c_custkey),
t AS (SELECT DISTINCT text, lower(replace(text, ' ', '')) AS k FROM c), f AS (SELECT text, skill, 1 - levenshtein(t.k, n.k) / greatest(length(t.k), length(n.k))::DOUBLE AS r FROM t, names n),
b AS (SELECT text, arg_min(skill, (-r, skill)) AS skill, max(r) AS r FROM f WHERE r >= 0.88 GROUP BY 1),
a AS (SELECT substr(skill, 1, 2) || substr(skill, 4) AS text, min(skill) AS chosen FROM names GROUP BY 1)
SELECT resume_id, 0 AS row_id, b.skill, c.text, CASE WHEN r >= 0.92 THEN {_R4.format(x="r")} WHEN resume_id % 3 = 0 THEN {_R4.format(x="CAST(round(CAST(r AS DECIMAL(18,8)), 4) AS DOUBLE) * 0.8::DOUBLE")} WHEN resume_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
  CASE WHEN r >= 0.92 OR resume_id % 3 = 0 THEN 'FUZZY' ELSE 'MODEL_VALIDATED' END AS method, 'AUTO_CONFIRMED' AS status, 1 AS n_chunks
FROM c JOIN b ON c.text = b.text JOIN a ON a.text = c.text WHERE r >= 0.92 OR resume_id % 3 = 0 OR (resume_id % 3 = 2 AND chosen = b.skill)""",
    "evd4_to_evd8_evidence_rows": f"""WITH g AS (SELECT c_custkey AS resume_id, {sql_pick(TOOLS, "c_custkey")} AS skill, {sql_pick(verdicts.STRENGTHS, "c_custkey")} AS strength, {sql_pick(GIVEN, "c_custkey")} AS given, {sql_pick(TOOLS, "(c_custkey + c_custkey % 2)")} AS named, c_custkey % 9 - 1 AS p FROM customer),
h AS (SELECT o_custkey AS resume_id, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS hits FROM orders GROUP BY 1),
v AS (SELECT g.*, CASE WHEN strength IN ('WEAK', 'NONE') AND hits IS NOT NULL AND given IN ('MODERATE', 'WEAK') AND NOT (named <> skill AND ((skill IN ('docker', 'kubernetes') AND named IN ('docker', 'kubernetes')) OR (skill IN ('mysql', 'oracle-database') AND named IN ('mysql', 'oracle-database')))) THEN given END AS ok,
  CASE WHEN p BETWEEN 0 AND len(hits) - 1 THEN hits[p + 1] ELSE hits[1] END AS judged FROM g LEFT JOIN h USING (resume_id)),
u AS (SELECT *, ok IS NOT NULL AND {_S.format(x="ok")} > {_S.format(x="strength")} AS raised FROM v), w AS (SELECT resume_id, skill, CASE WHEN raised THEN 'INFERRED' ELSE 'SKILLS_SECTION_ONLY' END AS kind, CASE WHEN raised THEN ok ELSE strength END AS strength, ok, judged, named FROM u)
SELECT resume_id, skill, judged AS sequence, kind, strength, 'Used ' || named AS explanation, 0.6::DOUBLE AS confidence FROM w WHERE ok IS NOT NULL
UNION ALL SELECT resume_id, skill, resume_id * 10 + unnest([0, 1, 2]), kind, strength, '', 1.0::DOUBLE FROM w WHERE resume_id % 4 > 0""",
    "evd9_skill_flags": f"""WITH r AS (SELECT l_orderkey AS resume_id, 's' || (l_linenumber % 2) AS skill, {sql_pick(("EXPLICIT_IMPLEMENTATION", "RESPONSIBILITY_USAGE", "INFERRED", "SKILLS_SECTION_ONLY"), "(l_orderkey + l_linenumber)")} AS kind FROM lineitem)
SELECT resume_id, skill, bool_or(kind = 'EXPLICIT_IMPLEMENTATION') AS project_backed, bool_or(kind IN ('EXPLICIT_IMPLEMENTATION', 'RESPONSIBILITY_USAGE')) AS experience_linked FROM r GROUP BY 1, 2""",
    "scr19_gap_notes": f"""WITH {_GAPS}, f AS (SELECT resume_id, min(a) AS x FROM gaps GROUP BY 1),
s AS (SELECT g.*, x, 'The resume indicates a career gap from ' || a || ' to ' || b || ' (' || m || ' months); no reason is documented, so be prepared to explain this during interviews.' AS t FROM gaps g JOIN f USING (resume_id)),
k AS (SELECT *, resume_id % 2 = 0 AND a = x OR EXISTS (SELECT 1 FROM gaps o WHERE o.resume_id = s.resume_id AND (o.a, o.b) < (s.a, s.b) AND NOT (s.resume_id % 2 = 0 AND o.a = s.x) AND (o.a = s.a OR o.b = s.b OR o.b = s.a)) AS known FROM s),
j AS (SELECT resume_id, any_value(x) AS x, string_agg(t, '|' ORDER BY a, b) FILTER (NOT known) AS added, count(*) FILTER (NOT known) AS n FROM k GROUP BY 1)
SELECT resume_id, CAST(n + CASE WHEN resume_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_notes, concat_ws('|', CASE WHEN resume_id % 2 = 0 THEN 'Ask about ' || x END, added) AS notes FROM j""",
    "scr9_scr13_judged_sub_scores": f"""WITH {assessment._ASSESS}, each_part AS (SELECT resume_id, unnest([{", ".join(f"{{'c': '{c}', 'd': '{d}', 'p': CAST({x} AS DOUBLE)}}" for c, d, x in _SUB_SCORES)}]) AS x FROM f)
SELECT resume_id, x.c AS category, x.d AS sub_dimension, x.p AS points FROM each_part""",
    "rec2_to_rec5_recommendation_texts": f"""WITH {assessment._ASSESS}
SELECT resume_id, 1 AS priority, '{narrative.RECOMMENDATIONS[1][0]}' AS title, 'EVIDENCE' AS category, 'CANDIDATE' AS audience, '{narrative.WEAK_TEXT[0]}' || replace(weak, ',', ', ') || '{narrative.WEAK_TEXT[1]}' AS description FROM f WHERE weak IS NOT NULL
UNION ALL SELECT resume_id, 2, 'Quantify impact with metrics', 'COMPLETENESS', 'CANDIDATE', '{narrative.RECOMMENDATIONS[2][3]}' FROM f WHERE bullets > 0 AND quantified / bullets < 0.2
UNION ALL SELECT c_custkey, 3, 'Highlight leadership and architectural decisions', 'GROWTH', 'CANDIDATE', '{narrative.RECOMMENDATIONS[3][3]}' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 4, 'Consider adding relevant certifications', 'COMPLETENESS', 'CANDIDATE', 'No certifications found; {_EXPECTED}' FROM customer WHERE c_custkey % 5 <> 0""",
    "jus1_jus2_jus3_narratives": f"""WITH {timeline._UNION}, r AS (SELECT o_custkey AS resume_id, count(*) AS roles FROM orders GROUP BY 1), s AS (SELECT o_custkey AS resume_id, o_orderpriority AS skill, CASE WHEN count(*) > 2 THEN 'STRONG' ELSE 'WEAK' END AS g FROM orders GROUP BY 1, 2),
h AS (SELECT resume_id, arg_min(skill || ': ' || g, skill) AS one FROM s GROUP BY 1), d AS (SELECT *, resume_id % 6 = 3 AS said FROM totals JOIN r USING (resume_id) JOIN h USING (resume_id))
SELECT resume_id, CASE WHEN said THEN 'Fine.' ELSE 'The candidate has approximately ' || concat_ws(' ', CASE WHEN total_months // 12 > 0 THEN (total_months // 12) || ' year' || CASE WHEN total_months // 12 > 1 THEN 's' ELSE '' END END,
  CASE WHEN total_months % 12 > 0 THEN (total_months % 12) || ' month' || CASE WHEN total_months % 12 > 1 THEN 's' ELSE '' END END) || ' of documented professional experience across ' || roles || ' role(s). ' || one || CASE WHEN resume_id % 2 = 0 THEN ' Growth: Grew.' ELSE '' END END AS overall_assessment,
  CASE WHEN said THEN 's' WHEN resume_id % 2 = 0 THEN 'Grew.|Led.' ELSE '' END AS strengths, CASE WHEN said THEN '' ELSE 'w0|w1|w2' END AS weaknesses, CASE WHEN said THEN 'k' ELSE 'w3|w4' END AS key_risks, 'note' AS interview_preparation FROM d""",
}
