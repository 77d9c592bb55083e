"""Requests to a model, its merged narrative, recommendations, and the result documents of evaluations. All model answers are input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions import dates

# Recommendations by priority: title, category, audience, text (None: see the code).
RECOMMENDATIONS = {
    1: ("Strengthen evidence for listed skills", "EVIDENCE", "CANDIDATE", None),
    2: ("Quantify impact with metrics", "COMPLETENESS", "CANDIDATE", "Most responsibility bullets lack quantifiable outcomes (percentages, counts, dollar amounts). Adding concrete metrics makes impact easier to assess."),
    3: ("Highlight leadership and architectural decisions", "GROWTH", "CANDIDATE", "The resume shows limited explicit evidence of mentoring, leading others, or architecture-level decision-making. If applicable, make this scope visible."),
    4: ("Consider adding relevant certifications", "COMPLETENESS", "CANDIDATE", None),
}
WEAK_TEXT = ("The following verified skills have little or no supporting evidence in the experience/project text: ", ". Add specific examples of how these were used.")
# Versions that stamp an evaluation; those of the first three gate what is embedded anew.
VERSIONS = {
    "chunking_version": "chunking-v1", "embedding_version": "embedding-v1", "vector_index_version": "vector-index-v1", "model_version": "model-v1", "prompt_version": "prompts-v1",
    "skill_taxonomy_version": "skill-taxonomy-v1", "role_taxonomy_version": "role-taxonomy-v1", "normalization_version": "normalization-v1", "agent_version": "agents-v1", "scoring_version": "scoring-v1",
}
INDEX_VERSIONS = tuple(VERSIONS)[:3]


def recommendations(assessed: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, priority, title, category, audience, description) of assessed rows (key, priorities, weak_named, warnings)."""
    fixed = F.create_map(*[x for p, r in RECOMMENDATIONS.items() for x in (F.lit(p), F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("title", "category", "audience", "text"), r, strict=True)]))])
    rows = assessed.select(key, "weak_named", "warnings", F.explode("priorities").alias("priority")).withColumn("r", F.element_at(fixed, F.col("priority")))
    weak = F.concat(F.lit(WEAK_TEXT[0]), F.array_join("weak_named", ", "), F.lit(WEAK_TEXT[1]))
    certification = F.get(F.filter("warnings", lambda w: F.contains(F.lower(w), F.lit("certification"))), F.lit(0))
    text = F.when(F.col("priority") == 1, weak).when(F.col("priority") == 4, certification).otherwise(F.col("r.text"))
    return rows.select(key, "priority", "r.title", "r.category", "r.audience", text.alias("description"))


def _filled(rows: DataFrame, *columns: str) -> DataFrame:
    """Empty arrays for null ones."""
    return rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in columns})


def growth_requests(spine: DataFrame, roles: DataFrame, skills: DataFrame, gaps: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, request): JSON of a document's roles in order of time, its verified skills by name, and its gaps."""
    role = F.struct(F.coalesce("start_date", F.lit("0001-01-01").cast("date")).alias("_from"), F.col("place").alias("_place"), "company", "title", "start_date", "end_date", "is_current", "responsibilities", "technologies")
    per_role = roles.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(role)), lambda r, i: F.struct(i.alias("sequence"), *[r[c].alias(c) for c in ("company", "title", "start_date", "end_date", "is_current", "responsibilities", "technologies")])).alias("roles"))
    per_skill = skills.groupBy(key).agg(F.sort_array(F.collect_set("skill")).alias("verified_skills"))
    per_gap = gaps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("gap_start", "gap_end", F.col("gap_months").alias("duration_months")))).alias("documented_gaps"))
    rows = spine.select(key).join(per_role, key, "left").join(per_skill, key, "left").join(per_gap, key, "left")
    rows = _filled(rows, "roles", "verified_skills", "documented_gaps")
    return rows.select(key, F.to_json(F.struct("roles", "verified_skills", "documented_gaps")).alias("request"))


def with_gap_notes(notes: DataFrame, gaps: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, notes): interview notes (key, notes: array of text) with one more for each gap that no note dates, in order of time."""
    listed = gaps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("gap_start").cast("string").alias("a"), F.col("gap_end").cast("string").alias("b"), F.col("gap_months").alias("n")))).alias("gaps"))
    rows = notes.join(listed, key, "full_outer").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))
    text = lambda g: F.concat(F.lit("The resume indicates a career gap from "), g["a"], F.lit(" to "), g["b"], F.lit(" ("), g["n"].cast("string"), F.lit(" months); no reason is documented, so be prepared to explain this during interviews."))
    known = lambda said, g: F.exists(said, lambda s: F.contains(s, g["a"]) | F.contains(s, g["b"]))
    add = lambda said, g: F.when(known(said, g), said).otherwise(F.concat(said, F.array(text(g))))
    return rows.select(key, F.when(F.col("gaps").isNull(), F.col("notes")).otherwise(F.aggregate("gaps", F.col("notes"), add)).alias("notes"))


def completeness_requests(rows: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, request) of rows (key, summary, recent_title, recent_family, total_months, certification, project, achievement): JSON."""
    absent = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), f"{c}s") for c in ("certification", "project", "achievement")]), lambda x: x.isNotNull())
    years = F.round((F.col("total_months") / 12).cast("decimal(18,8)"), 1).cast("decimal(10,1)").cast("string")
    body = F.struct(F.coalesce("summary", F.lit("")).alias("summary_text"), F.col("recent_title").alias("most_recent_title"), F.col("recent_family").alias("most_recent_role_family"), years.alias("actual_total_years_experience"), absent.alias("sections_absent"))
    return rows.select(key, F.to_json(body).alias("request"))


def experience_sentence(months: Column, roles: Column) -> Column:
    return F.concat(F.lit("The candidate has approximately "), dates.month_label(months), F.lit(" of documented professional experience across "), roles.cast("string"), F.lit(" role(s)."))


def highlights(graded: DataFrame, key: str = "resume_id", most: int = 8) -> DataFrame:
    """(key, highlights): "skill: strength" of the first ``most`` skills by name."""
    each = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("skill", "strength"))), 1, most), lambda x: F.concat(x["skill"], F.lit(": "), x["strength"]))
    return graded.groupBy(key).agg(each.alias("highlights"))


def narratives(rows: DataFrame, verdicts: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, overall_assessment, strengths, weaknesses, key_risks, interview_preparation).

    ``rows``: (key, experience_sentence, highlights, observations, warnings, notes); ``verdicts``: (key, overall_assessment, strengths, weaknesses,
    key_risks) of a model. A verdict without an assessment doesn't count: the narrative is put together from the rows. Notes are never the model's.
    """
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.col(c), none)
    rows = rows.join(verdicts.where("overall_assessment is not null"), key, "left")
    said = F.col("overall_assessment").isNotNull()
    evidence = F.coalesce(F.get(some("highlights"), F.lit(0)), F.lit("Evidence review completed."))
    growth = F.coalesce(F.concat(F.lit("Growth: "), F.get(some("observations"), F.lit(0))), F.lit(""))
    own = F.trim(F.concat_ws(" ", "experience_sentence", evidence, growth))
    pick = lambda c, fallback: F.when(said, some(c)).otherwise(fallback).alias(c)
    return rows.select(
        key, F.coalesce("overall_assessment", own).alias("overall_assessment"), pick("strengths", F.slice(some("observations"), 1, 2)), pick("weaknesses", F.slice(some("warnings"), 1, 3)),
        pick("key_risks", F.slice(some("warnings"), 4, 2)), some("notes").alias("interview_preparation"),
    )


def narrative_requests(rows: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, request): JSON of scores and findings (key, completeness, growth, evidence, experience, total, warnings, observations, highlights, experience_sentence)."""
    scores = F.struct("completeness", "growth", "evidence", "experience", "total")
    none = F.array().cast("array<string>")
    body = F.struct(scores.alias("scores"), *[F.coalesce(F.col(c), none).alias(n) for c, n in (("warnings", "completeness_warnings"), ("observations", "growth_observations"), ("highlights", "evidence_highlights"))], F.col("experience_sentence").alias("experience_summary"))
    return rows.select(key, F.to_json(body).alias("request"))


def stamped(rows: DataFrame, versions: dict[str, str] = VERSIONS) -> DataFrame:
    return rows.withColumns({k: F.lit(v) for k, v in versions.items()})


def stale(rows: DataFrame, versions: dict[str, str] = VERSIONS, gate=INDEX_VERSIONS) -> DataFrame:
    """Rows whose gating versions aren't the present ones; a missing version is stale."""
    fresh = F.lit(True)
    for k in gate:
        fresh = fresh & F.col(k).eqNullSafe(F.lit(versions[k]))
    return rows.where(~fresh)


def isolated(rows: DataFrame, stage: str, value: Column, reason: Column, most: int = 2000) -> DataFrame:
    """``rows`` with ``value`` as ``result``, and with failed_stage and failure_reason (cut at ``most`` characters) where it is null."""
    failed = F.col("result").isNull()
    rows = rows.withColumn("result", value)
    return rows.withColumn("failed_stage", F.when(failed, stage)).withColumn("failure_reason", F.when(failed, F.substring(reason, 1, most)))


def result_documents(evaluations: DataFrame, sub_scores: DataFrame, recommended: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, document): nested JSON of an evaluation with its sub-scores (key, category, place, sub_dimension, points) by category and its
    recommendations (key, priority, title, category, description, audience) in order."""
    parts = F.sort_array(F.collect_list(F.struct("place", "category", "sub_dimension", "points")))
    scores = sub_scores.groupBy(key).agg(parts.alias("parts"))
    advice = recommended.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("priority", "title", "category", "description", "audience"))).alias("recommendations"))
    of = lambda c: F.transform(F.filter("parts", lambda p: p["category"] == c), lambda p: p.dropFields("place", "category")).alias(c)
    rows = _filled(evaluations.join(scores, key, "left").join(advice, key, "left"), "parts", "recommendations")
    body = F.struct("status", F.struct("completeness", "growth", "evidence", "experience", "total").alias("scores"), F.struct(*[of(c) for c in ("completeness", "growth", "evidence", "experience")]).alias("sub_scores"), "recommendations")
    return rows.select(key, F.to_json(body).alias("document"))
