"""Category scores of 25 points each, from role rows, graded skills and chunks; totals, status, warnings, recommendations.

Scores are rounded to two places as decimals. A document without roles or skills scores 0 where they are asked for.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions import patterns
from tenure.operators import intervals
from tenure.operators.chunking import presence_flags, text_of_type


def points(value: Column) -> Column:
    """Two decimal places; null is 0."""
    return F.round(F.coalesce(value, F.lit(0.0)).cast("decimal(18,8)"), 2).cast("double")


def facts(spine: DataFrame, chunked: DataFrame, roles: DataFrame, graded: DataFrame, key: str = "resume_id") -> DataFrame:
    """One row per document of ``spine`` with what the scores need."""
    known = lambda c: F.col(c) != "Unknown"
    n = F.size("responsibilities")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    per_role = roles.groupBy(key).agg(
        F.count("*").alias("roles"), share(F.col("start_date").isNotNull() & F.col("end_date").isNotNull()).alias("dated"), F.avg(n).alias("depth"), F.max("end_date").alias("last_end"),
        F.bool_or("is_current").alias("current"), share((n >= 2) | known("company")).alias("detailed"), share(known("company") & known("title") & F.col("start_date").isNotNull()).alias("clear"),
        F.sum(n).alias("bullets"), F.sum(F.size(F.filter("responsibilities", lambda s: s.rlike(patterns.METRIC)))).alias("quantified"),
    )
    months = intervals.union_months(roles.where("start_date is not null and end_date is not null").select(key, F.col("start_date").alias("start"), F.col("end_date").alias("end")), key)
    texts = chunked.groupBy(key).agg(text_of_type("CONTACT").alias("contact"), text_of_type("SUMMARY").alias("summary"), F.bool_or(F.col("section") == "EDUCATION").alias("education"), *presence_flags())
    graded = graded.groupBy(key).agg(
        F.count("*").alias("skills"), F.count_if(F.col("strength") == "STRONG").alias("strong"), F.count_if(F.col("strength") == "MODERATE").alias("moderate"),
        F.count_if(F.col("kind") == "EXPLICIT_IMPLEMENTATION").alias("backed"), F.count_if(F.col("kind").isin("EXPLICIT_IMPLEMENTATION", "RESPONSIBILITY_USAGE")).alias("linked"),
        F.sort_array(F.collect_list(F.when(F.col("strength").isin("WEAK", "NONE"), F.col("skill")))).alias("weak"),
    )
    rows = spine.select(key)
    for part in (per_role, months, texts, graded):
        rows = rows.join(part, key, "left")
    claimed = patterns.found(F.coalesce("summary", F.lit("")), patterns.CLAIMED_YEARS).cast("int")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("roles", "total_months", "skills", "strong", "moderate", "backed", "linked")}
    return rows.withColumns({**zero, "claimed": claimed})


def experience(today: dt.date) -> dict[str, Column]:
    """Five parts; documents without roles get 0 for each."""
    days = F.datediff(F.lit(today), "last_end")
    off = F.coalesce(F.abs(F.col("total_months") / 12 - F.col("claimed")) >= 3, F.lit(False))
    parts = {
        "documented_magnitude": 8 * (0.5 * F.col("dated") + 0.5 * F.least(F.lit(1.0), F.col("total_months") / 24)),
        "role_depth": 5 * F.least(F.lit(1.0), F.col("depth") / 5),
        "skill_supported_experience": F.when(F.col("skills") > 0, 5 * F.col("linked") / F.col("skills")),
        "current_freshness": F.when(F.col("current") | (days < 180), 4.0).otherwise(F.greatest(F.lit(0.0), 4 * (1 - days / 365.0 / 3))),
        "claimed_consistency": F.when(off, 1.0).otherwise(3.0),
    }
    return {k: points(F.when(F.col("roles") > 0, v)) for k, v in parts.items()}


def evidence() -> dict[str, Column]:
    """Three parts; documents without skills get 0 for each."""
    n = F.col("skills")
    parts = {
        "core_skill_evidence": 12 * F.col("strong") / n,
        "supporting_evidence": 8 * (F.col("strong") + F.col("moderate")) / n,
        "project_evidence": F.when(F.col("backed") >= 3, 5.0).when(F.col("backed") >= 1, 3.0).otherwise(2.0),
    }
    return {k: points(F.when(n > 0, v)) for k, v in parts.items()}


def years(months: Column) -> Column:
    return F.round((months / 12).cast("decimal(18,8)"), 1).cast("decimal(10,1)")


# Lost by an outdated and by a generic summary, share kept by an absent section that isn't expected, lost by a contradiction and at most by all.
OUTDATED, GENERIC, NOT_EXPECTED, CONTRADICTION, CONTRADICTIONS = 1.5, 1.0, 0.7, 0.5, 1.5
#: Verdict columns of ``facts`` rows; all may be null.
VERDICTS = {"summary_outdated": "boolean", "summary_generic": "boolean", "summary_reason": "string", "not_expected": "array<string>", "contradictions": "array<string>"}


def with_verdicts(rows: DataFrame, verdicts: DataFrame | None, key: str = "resume_id") -> DataFrame:
    """``facts`` with a model's verdicts (key, *VERDICTS); nulls without any."""
    if verdicts is None:
        return rows.withColumns({c: F.lit(None).cast(t) for c, t in VERDICTS.items()})
    return rows.join(verdicts.select(key, *VERDICTS), key, "left")


def _listed(column: str) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def completeness() -> dict[str, Column]:
    """Ten parts; without verdicts nothing is taken off for them, and absent sections are expected."""
    some = lambda c: F.coalesce(F.col(c), F.lit(False))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    off = F.when(some("summary_outdated"), OUTDATED).otherwise(0.0) + F.when(some("summary_generic"), GENERIC).otherwise(0.0)
    section = lambda c, most: F.when(some(c), most).when(F.array_contains(_listed("not_expected"), f"{c}s"), NOT_EXPECTED * most)
    contradicted = F.least(F.lit(CONTRADICTIONS), F.size(_listed("contradictions")) * CONTRADICTION)
    over = F.coalesce(years(F.col("total_months")) - F.col("claimed") >= 3, F.lit(False))
    parts = {
        "contact": F.when(text("contact").rlike(patterns.EMAIL) | text("contact").rlike(patterns.PHONE), 2.0),
        "summary_quality": F.when(F.length(text("summary")) > 20, F.greatest(F.lit(0.0), 3.0 - off)),
        "experience_detail": 5 * F.col("detailed"),
        "technical_skills": F.least(F.lit(3.0), F.col("skills").cast("double")),
        "education_present": F.when(some("education"), 2.0),
        "projects": section("project", 2.0),
        "certifications": section("certification", 2.0),
        "achievements": section("achievement", 1.0),
        "clarity": 2 * F.col("clear"),
        "freshness_consistency": F.greatest(F.lit(0.0), F.when(over, 1.5).otherwise(3.0) - contradicted),
    }
    return {k: points(v) for k, v in parts.items()}


def warnings() -> Column:
    """Array of warnings in the order of the completeness parts."""
    some = lambda c: F.coalesce(F.col(c), F.lit(False))
    expected = lambda c: ~F.array_contains(_listed("not_expected"), f"{c}s")
    absent = [F.when(~some(c) & expected(c), f"No {c}s found; this is typically expected for this candidate's profile.") for c in ("project", "certification", "achievement")]
    actual = years(F.col("total_months"))
    over = F.when(actual - F.col("claimed") >= 3, F.concat(F.lit("Summary claims "), F.col("claimed").cast("string"), F.lit("+ years of experience, but documented experience totals approximately "), actual.cast("string"), F.lit(" years -- a discrepancy worth clarifying.")))
    long = F.length(F.coalesce("summary", F.lit(""))) > 20
    reason = F.coalesce(F.nullif("summary_reason", F.lit("")), F.lit("Summary appears outdated relative to current experience."))
    whole = F.array(F.when(~long, "No professional summary found.").when(some("summary_outdated"), reason), F.when(F.col("roles") == 0, "No employment history found."), *absent, over)
    return F.concat(F.filter(whole, lambda w: w.isNotNull()), _listed("contradictions"))


def total(parts: dict[str, Column]) -> Column:
    """Sum of a category's parts, at most 25."""
    out = F.lit(0.0)
    for p in parts.values():
        out = out + p
    return F.least(F.lit(25.0), points(out))


def sub_scores(rows: DataFrame, today: dt.date, key: str = "resume_id") -> DataFrame:
    """(key, category, place, sub_dimension, points) of facts with verdicts: a row for each part of the three fixed categories."""
    parts = [(c, n, k, v) for c, values in (("experience", experience(today)), ("evidence", evidence()), ("completeness", completeness())) for n, (k, v) in enumerate(values.items())]
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(n).alias("place"), F.lit(k).alias("sub_dimension"), v.alias("points")) for c, n, k, v in parts])
    return rows.select(key, F.explode(each).alias("x")).select(key, "x.*")


def assess(rows: DataFrame, today: dt.date, growth: DataFrame, key: str = "resume_id", verdicts: DataFrame | None = None) -> DataFrame:
    """Facts, and verdicts (key, *VERDICTS) if there are any, to (key, experience, evidence, completeness, growth, total, status, failed, warnings, priorities).

    Documents absent from ``growth`` (key, growth, leadership) are PARTIAL: the category counts 0.
    """
    rows = with_verdicts(rows, verdicts, key).join(growth, key, "left").withColumns({"experience": total(experience(today)), "evidence": total(evidence()), "completeness": total(completeness()), "warnings": warnings()})
    missing = F.filter(F.array(F.when(F.col("growth").isNull(), "GROWTH")), lambda c: c.isNotNull())
    whole = points(F.col("experience") + F.col("evidence") + F.col("completeness") + F.coalesce("growth", F.lit(0.0)))
    certified = F.exists("warnings", lambda w: F.lower(w).contains("certification"))
    due = F.array(
        F.when(F.size(F.coalesce("weak", F.array().cast("array<string>"))) > 0, 1), F.when((F.col("bullets") > 0) & (F.col("quantified") / F.col("bullets") < 0.2), 2),
        F.when(F.col("leadership").isin("NONE", "LOW"), 3), F.when(certified, 4),
    )
    return rows.select(
        key, "experience", "evidence", "completeness", F.coalesce("growth", F.lit(0.0)).alias("growth"), whole.alias("total"), F.when(F.size(missing) > 0, "PARTIAL").otherwise("COMPLETED").alias("status"),
        missing.alias("failed"), "warnings", F.slice(F.filter(due, lambda p: p.isNotNull()), 1, 4).alias("priorities"), F.slice(F.coalesce("weak", F.array().cast("array<string>")), 1, 5).alias("weak_named"),
    )
