"""Queries of discovered skills, their evidence, category scores and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions import words
from tenure.operators import chunking, discovery, review, scoring
from tenure.plans import entities
from tenure.plans.chunks import CHUNKS_SQL, stored_chunks
from tenure.sources.careers import CAREER_SQL, TODAY, career_lines
from tenure.sources.tables import read
from tenure.stages import stage


def _skills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunked = stored_chunks(spark, sf_dir)
    catalog = read(spark, sf_dir, "part").select(F.col("p_name").alias("skill")).distinct()
    return chunked, discovery.discover(chunked, catalog)


def _csv(c: str) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), ",")


def discovered_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skills(spark, sf_dir)[1].select("resume_id", "skill", "text", "confidence", "method", _csv("chunks").alias("chunks"))


def skill_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked, skills = _skills(spark, sf_dir)
    return discovery.grade_skills(skills, chunked).withColumn("evidence", _csv("evidence"))


def plausible_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each distinct line is taken apart once, for as often as it stands there; "outer" keeps Catalyst from doing so twice for a filter
    lines = career_lines(spark, sf_dir).groupBy("text").agg(F.count("*").alias("lines"))
    parts = lines.select("lines", F.explode_outer(words.skill_candidates(F.col("text"))).alias("part")).where("part is not null")
    return parts.groupBy("part").agg(F.sum("lines").alias("n")).select("part", "n", words.is_plausible_skill(F.col("part")).alias("plausible"))


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked, skills = _skills(spark, sf_dir)
    spine = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id"))
    facts = scoring.facts(spine, chunked, stage(chunking.role_rows(chunked), "roles"), discovery.grade_skills(skills, chunked))
    growth = entities.growth_scores(spark, sf_dir).where("resume_id % 5 <> 0").withColumn("leadership", F.when(F.col("resume_id") % 2 == 0, "LOW").otherwise("HIGH"))
    rows = scoring.assess(facts, TODAY, growth)
    return rows.withColumns({"failed": _csv("failed"), "warnings": F.array_join("warnings", "|"), "priorities": _csv("priorities"), "weak_named": _csv("weak_named")})


QUERIES = {"dsc1_dsc2_dsc3_dsc5_dsc9_discovered_skills": discovered_skills, "evd1_evd2_evd3_skill_evidence": skill_evidence, "cat4_plausible_texts": plausible_texts, "scr1_to_scr16_scr20_rec1_to_rec4_run1_assessments": assessments}

_SKILLS = f"""{CHUNKS_SQL},
mentions AS (SELECT resume_id, sequence, p_name AS skill, 0 AS rank FROM chunks JOIN part ON p_partkey = resume_id WHERE chunk_type = 'SKILL_SECTION'
  UNION SELECT resume_id, sequence, 'red ring', 0 FROM chunks WHERE chunk_type = 'SKILL_SECTION' AND EXISTS (SELECT 1 FROM part WHERE p_name = 'red ring')
  UNION SELECT resume_id, sequence, regexp_extract(text, ' for (.+)$', 1), 1 FROM chunks WHERE chunk_type = 'EXPERIENCE_RESPONSIBILITY' AND text LIKE '% for %' AND regexp_extract(text, ' for (.+)$', 1) <> 'none'),
skills AS (SELECT resume_id, skill, skill AS text, CASE WHEN min(rank) = 0 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS confidence, list_sort(list(DISTINCT sequence)) AS chunk_list FROM mentions GROUP BY 1, 2),
firsts AS (SELECT m.resume_id, skill, company, chunk_type, min(m.sequence) AS sequence FROM mentions m JOIN chunks c ON m.resume_id = c.resume_id AND m.sequence = c.sequence GROUP BY ALL),
graded AS (SELECT resume_id, skill, count(*) FILTER (chunk_type = 'EXPERIENCE_RESPONSIBILITY') AS sources, list_sort(list(sequence) FILTER (chunk_type = 'EXPERIENCE_RESPONSIBILITY'))[1:3] AS uses, min(sequence) AS any_chunk FROM firsts GROUP BY 1, 2),
strengths AS (SELECT *, CASE WHEN sources >= 2 THEN 'STRONG' WHEN sources = 1 THEN 'MODERATE' ELSE 'WEAK' END AS strength, CASE WHEN sources >= 2 THEN 'EXPLICIT_IMPLEMENTATION' WHEN sources = 1 THEN 'RESPONSIBILITY_USAGE' ELSE 'SKILLS_SECTION_ONLY' END AS kind FROM graded)"""
_P = "CAST(round(CAST(coalesce({x}, 0) AS DECIMAL(18,8)), 2) AS DOUBLE)"


def _p(x: str) -> str:
    return _P.format(x=x)


_YEARS = "round(CAST(total_months / 12.0::DOUBLE AS DECIMAL(18,8)), 1)"
_ASSESS = f"""{_SKILLS},
spans AS (SELECT resume_id, role_id, start_date AS s, CASE WHEN is_current THEN DATE '{TODAY}' ELSE end_date END AS e, is_current FROM titled),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY resume_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM spans),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY resume_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM marked),
merged AS (SELECT resume_id, i, min(s) AS s, max(e) AS e FROM islands GROUP BY ALL),
months AS (SELECT resume_id, sum((year(e) - year(s)) * 12 + month(e) - month(s) + 1) AS total_months FROM merged GROUP BY 1),
counted AS (SELECT role_id, count(*) AS n, count(*) FILTER (text LIKE '%30!%%' ESCAPE '!') AS q FROM bullets GROUP BY 1),
role_facts AS (SELECT resume_id, count(*) AS roles, avg(coalesce(n, 0)) AS depth, max(e) AS last_end, bool_or(is_current) AS cur, sum(coalesce(n, 0)) AS bullets, sum(coalesce(q, 0)) AS quantified FROM spans LEFT JOIN counted USING (role_id) GROUP BY 1),
skill_facts AS (SELECT resume_id, count(*) AS skills, count(*) FILTER (strength = 'STRONG') AS strong, count(*) FILTER (strength = 'MODERATE') AS moderate,
  string_agg(skill, ',' ORDER BY skill) FILTER (strength = 'WEAK' AND place <= 5) AS weak FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, strength ORDER BY skill) AS place FROM strengths) GROUP BY 1),
growth AS (SELECT resume_id, CAST(round(CAST(sum([4, 5, 4, 3, 3, 2, 2, 1, 1][d] * [0, 0.25, 0.5, 0.8, 1, 0][(resume_id + d) % 6 + 1]) AS DECIMAL(18,8)), 2) AS DOUBLE) AS growth, CASE WHEN resume_id % 2 = 0 THEN 'LOW' ELSE 'HIGH' END AS leadership
  FROM (SELECT c_custkey AS resume_id, unnest(range(1, 10)) AS d FROM customer WHERE c_custkey % 5 <> 0) GROUP BY 1),
f AS (SELECT c_custkey AS resume_id, coalesce(roles, 0) AS roles, depth, last_end, cur, bullets, quantified, coalesce(total_months, 0) AS total_months, coalesce(skills, 0) AS skills, coalesce(strong, 0) AS strong, coalesce(moderate, 0) AS moderate, weak,
  growth, leadership, c_custkey % 20 AS claimed FROM customer LEFT JOIN role_facts ON c_custkey = role_facts.resume_id LEFT JOIN months ON c_custkey = months.resume_id LEFT JOIN skill_facts ON c_custkey = skill_facts.resume_id LEFT JOIN growth ON c_custkey = growth.resume_id),
scored AS (SELECT *, CASE WHEN roles = 0 THEN 0 ELSE {_p("8 * (0.5 + 0.5 * least(1.0::DOUBLE, total_months / 24.0::DOUBLE))")} + {_p("5 * least(1.0::DOUBLE, depth / 5)")} + {_p("CASE WHEN skills > 0 THEN 5.0::DOUBLE * (strong + moderate) / skills END")}
    + {_p(f"CASE WHEN cur OR date_diff('day', last_end, DATE '{TODAY}') < 180 THEN 4.0::DOUBLE ELSE greatest(0.0::DOUBLE, 4 * (1 - date_diff('day', last_end, DATE '{TODAY}') / 365.0::DOUBLE / 3)) END")}
    + CASE WHEN abs(total_months / 12.0::DOUBLE - claimed) >= 3 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END END AS ex,
  CASE WHEN skills = 0 THEN 0 ELSE {_p("12.0::DOUBLE * strong / skills")} + {_p("8.0::DOUBLE * (strong + moderate) / skills")} + CASE WHEN strong >= 3 THEN 5 WHEN strong >= 1 THEN 3 ELSE 2 END END AS ev,
  CASE WHEN resume_id % 4 = 0 THEN 0 ELSE 2 END + 3 + CASE WHEN roles > 0 THEN 7 ELSE 0 END + least(3, skills) + 2 + CASE WHEN {_YEARS} - claimed >= 3 THEN 1.5::DOUBLE ELSE 3.0::DOUBLE END AS co FROM f),
totals AS (SELECT *, least(25.0::DOUBLE, {_p("ex")}) AS experience, least(25.0::DOUBLE, {_p("ev")}) AS evidence, least(25.0::DOUBLE, {_p("co")}) AS completeness FROM scored)"""

_BARRED_TEXTS = str([*words.GENERIC, *words.NON_TECHNICAL, *words.LOCATIONS, *words.HOBBIES])
_BARRED_WORDS = str([*words.INSTITUTIONS, *words.FRAGMENTS])

ORACLES = {
    "dsc1_dsc2_dsc3_dsc5_dsc9_discovered_skills": f"WITH {_SKILLS} SELECT resume_id, skill, text, confidence, 'EXACT' AS method, array_to_string(chunk_list, ',') AS chunks FROM skills",
    "evd1_evd2_evd3_skill_evidence": f"WITH {_SKILLS} SELECT resume_id, skill, sources, strength, kind, CASE WHEN sources > 0 THEN array_to_string(uses, ',') ELSE CAST(any_chunk AS VARCHAR) END AS evidence FROM strengths",
    "scr1_to_scr16_scr20_rec1_to_rec4_run1_assessments": f"""WITH {_ASSESS} SELECT resume_id, experience, evidence, completeness, coalesce(growth, 0) AS growth, {_p("experience + evidence + completeness + coalesce(growth, 0)")} AS total,
  CASE WHEN growth IS NULL THEN 'PARTIAL' ELSE 'COMPLETED' END AS status, CASE WHEN growth IS NULL THEN 'GROWTH' ELSE '' END AS failed,
  concat_ws('|', CASE WHEN roles = 0 THEN 'No employment history found.' END, 'No projects found; this is typically expected for this candidate''s profile.', 'No certifications found; this is typically expected for this candidate''s profile.',
    'No achievements found; this is typically expected for this candidate''s profile.',
    CASE WHEN {_YEARS} - claimed >= 3 THEN 'Summary claims ' || claimed || '+ years of experience, but documented experience totals approximately ' || CAST({_YEARS} AS DECIMAL(10,1)) || ' years -- a discrepancy worth clarifying.' END) AS warnings,
  concat_ws(',', CASE WHEN weak IS NOT NULL THEN '1' END, CASE WHEN bullets > 0 AND quantified / bullets < 0.2 THEN '2' END, CASE WHEN leadership = 'LOW' THEN '3' END, '4') AS priorities, coalesce(weak, '') AS weak_named FROM totals""",
    "cat4_plausible_texts": rf"""WITH {CAREER_SQL}, cut AS (SELECT unnest(regexp_split_to_array(regexp_replace(text, '\b(\w{{1,4}})\s*/\s*(\w{{1,4}})\b', '\1/\2', 'g'), '[\r\n,•▪●|\t;]+')) AS raw FROM career),
parts AS (SELECT regexp_replace(raw, '^[ .;:()\-•]+|[ .;:()\-•]+$', '', 'g') AS part FROM cut),
counted AS (SELECT part, count(*) AS n, list_filter(string_split(trim(part), ' '), lambda w: w <> '') AS w FROM parts WHERE length(part) BETWEEN 2 AND 60 GROUP BY part)
SELECT part, n, NOT list_contains({_BARRED_TEXTS}, lower(trim(part))) AND length(trim(part)) BETWEEN 2 AND 60 AND NOT regexp_matches(part, '^\d+$') AND NOT (regexp_matches(part, '\b(19|20)\d{{2}}\b') AND len(w) <= 2)
  AND length(replace(part, '(', '')) = length(replace(part, ')', '')) AND NOT list_has_any(list_transform(w, lambda x: lower(trim(x, '(),.'))), {_BARRED_WORDS}) AND NOT (len(w) >= 2 AND part = upper(part) AND regexp_matches(part, '\p{{L}}')) AND len(w) <= 6 AS plausible FROM counted""",
}
