"""Verification and evidence: folding action logs, salvaging model answers, grading and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions import rules


def checked_actions(log: DataFrame, rows: DataFrame, catalog: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(actions that count, refused ones with ``reason``): an action must be on a row of its document, a correction must name a skill of ``catalog`` (skill)."""
    known = rows.select(*keys).distinct().withColumn("_row", F.lit(True))
    skills = catalog.select(F.col("skill").alias("new_skill")).distinct().withColumn("_skill", F.lit(True))
    log = log.join(known, keys, "left").join(skills, "new_skill", "left")
    reason = F.when(F.col("_row").isNull(), "unknown row").when((F.col("action") == "correct") & F.col("_skill").isNull(), "unknown skill")
    log = log.withColumn("reason", reason).drop("_row", "_skill")
    return log.where("reason is null").drop("reason"), log.where("reason is not null")


def fold_actions(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, status, skill, confidence, user_modified) from rows (keys, action, new_skill, order): the last action sets the
    status, the last correction the skill and full confidence (else both are null)."""
    at = F.struct(*order)
    last = F.max_by("action", at)
    status = F.when(last == "remove", "USER_REMOVED").when(last == "correct", "USER_CORRECTED").otherwise("USER_CONFIRMED")
    corrected = F.max_by(F.when(F.col("action") == "correct", F.col("new_skill")), F.when(F.col("action") == "correct", at))
    rows = log.groupBy(*keys).agg(status.alias("status"), corrected.alias("skill"), F.lit(True).alias("user_modified"))
    return rows.withColumn("confidence", F.when(F.col("skill").isNotNull(), 1.0))


def verified(rows: DataFrame, folded: DataFrame, keys: list[str]) -> DataFrame:
    """Stored skills (keys, skill, confidence, ...) with their folded actions, less the removed ones; untouched rows are accepted as they are."""
    new = folded.select(*keys, F.col("status").alias("_status"), F.col("skill").alias("_skill"), F.col("confidence").alias("_confidence"))
    rows = rows.join(new, keys, "left")
    rows = rows.withColumns({c: F.coalesce(f"_{c}", c) for c in ("status", "skill", "confidence")}).withColumn("user_modified", F.col("_status").isNotNull())
    return rows.drop("_status", "_skill", "_confidence").where("status <> 'USER_REMOVED'")


# States from which a skill list may be frozen, and the state it is in then.
FREEZABLE, FROZEN = ("SKILLS_IDENTIFIED", "WAITING_FOR_SKILL_VERIFICATION"), "SKILLS_VERIFIED"


def freeze(documents: DataFrame, requested: DataFrame, key: str = "resume_id") -> tuple[DataFrame, DataFrame]:
    """(documents (key, status) after freezing the ``requested`` (key) that wait, requests that are refused with the status they met)."""
    asked = requested.select(key).distinct().withColumn("_asked", F.lit(True))
    may = F.col("status").isin(*FREEZABLE)
    rows = documents.join(asked, key, "left")
    out = rows.withColumn("status", F.when(F.col("_asked") & may, FROZEN).otherwise(F.col("status"))).drop("_asked")
    refused = asked.drop("_asked").join(documents.select(key, "status"), key, "left").where(~F.coalesce(may, F.lit(False)))
    return out, refused


def ready(documents: DataFrame) -> DataFrame:
    """Documents that may be evaluated."""
    return documents.where(F.col("status") == FROZEN)


def skill_fingerprint(skill: Column, status: Column) -> Column:
    """Aggregate: SHA-256 of the sorted skill:status texts, joined by a bar."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat(skill, F.lit(":"), status))), "|"), 256)


def salvage(raw: Column) -> Column:
    """JSON text of a model's answer: as it is, else its outermost braces, else its outermost brackets, else null."""
    def parsed(s: Column) -> Column:
        return F.when(F.try_parse_json(s).isNotNull(), s)

    part = lambda pattern: F.nullif(F.regexp_extract(raw, pattern, 0), F.lit(""))
    return F.coalesce(parsed(raw), parsed(part(r"(?s)\{.*\}")), parsed(part(r"(?s)\[.*\]")))


def grade(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sources, strength, kind) of hits that all are evidence, by distinct (chunk_type, company) sources; a null company is a value."""
    n = F.size(F.collect_set(F.struct(F.coalesce("chunk_type", F.lit("")), F.coalesce("company", F.lit("\0")))))
    rows = hits.groupBy(*keys).agg(n.cast("long").alias("sources"))
    strong = F.col("sources") >= 2
    return rows.withColumn("strength", F.when(strong, "STRONG").otherwise("MODERATE")).withColumn("kind", F.when(strong, "EXPLICIT_IMPLEMENTATION").otherwise("RESPONSIBILITY_USAGE"))


def growth_points(labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, growth) from rows (keys, dimension, label): fraction of the label times the dimension's points; unknown labels 0."""
    points = F.element_at(F.array(*[F.lit(float(p)) for p in rules.GROWTH_POINTS]), F.col("dimension").cast("int"))
    share = F.coalesce(*[F.when(F.col("label") == k, v) for k, v in rules.GROWTH_LABELS.items()], F.lit(0.0))
    return labels.groupBy(*keys).agg(F.round(F.sum(points * share).cast("decimal(18,8)"), 2).cast("double").alias("growth"))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their place."""
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("place") <= k)
