"""Evidence beyond the fixed grades: retrieved passages, a model's verdicts on weak skills, stored evidence rows, skill flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Technologies that are never evidence for one another, by group.
SIBLINGS = (
    ("docker", "kubernetes"),
    ("aws", "azure", "google-cloud"),
    ("react", "angular", "vue-js"),
    ("mysql", "postgresql", "sql-server", "oracle-database"),
    ("tensorflow", "pytorch", "keras"),
)
# Order of strengths, the strengths a model may give, confidences of rows from verdicts and from fixed grades, chunks stored at most.
STRENGTHS = ("NONE", "WEAK", "MODERATE", "STRONG")
ALLOWED = ("MODERATE", "WEAK", "NONE")
FROM_VERDICT, FROM_GRADE, MOST_CHUNKS = 0.6, 1.0, 3
BACKED, LINKED = ("PROJECT_USAGE", "EXPLICIT_IMPLEMENTATION"), ("PROJECT_USAGE", "EXPLICIT_IMPLEMENTATION", "RESPONSIBILITY_USAGE")


def sibling_groups(spark: SparkSession, groups=SIBLINGS) -> DataFrame:
    """(grp, skill)."""
    return spark.createDataFrame([(n, s) for n, group in enumerate(groups) for s in group], "grp int, skill string")


def evidence_passages(graded: DataFrame, hits: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, skill, sequence, passage_index, text): retrieved ``hits`` (key, skill, sequence, score, text) of the skills that are weak or without
    evidence, best first from 0."""
    from pyspark.sql import Window

    weak = graded.where(F.col("strength").isin("WEAK", "NONE")).select(key, "skill")
    by = Window.partitionBy(key, "skill").orderBy(F.col("score").desc(), "sequence")
    return hits.join(weak, [key, "skill"], "left_semi").select(key, "skill", "sequence", (F.row_number().over(by) - 1).alias("passage_index"), "text")


def evidence_requests(passages: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, request): JSON of a document's weak skills, by name, with their passages."""
    each = F.sort_array(F.collect_list(F.struct("passage_index", "text")))
    rows = passages.groupBy(key, "skill").agg(each.alias("passages"))
    return rows.groupBy(key).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("skill", "passages"))).alias("skills"))).alias("request"))


def sibling_leaks(verdicts: DataFrame, siblings: DataFrame, key: str = "resume_id") -> DataFrame:
    """``verdicts`` (key, skill, explanation, ...) with ``leak``: the explanation names another member of the skill's group and not the skill."""
    pairs = siblings.join(siblings.select("grp", F.col("skill").alias("other")), "grp").where("skill <> other").groupBy("skill").agg(F.collect_set("other").alias("others"))
    said = F.lower(F.coalesce("explanation", F.lit("")))
    named = F.exists("others", lambda o: F.contains(said, F.lower(o)))
    leak = F.coalesce(named & ~F.contains(said, F.lower("skill")), F.lit(False))
    return verdicts.join(pairs, "skill", "left").withColumn("leak", leak).drop("others")


def checked_verdicts(verdicts: DataFrame, passages: DataFrame, siblings: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, skill, strength, explanation, sequence) of verdicts (key, skill, strength, passage_index, explanation) on skills that were asked about.

    Strengths that a model may not give, siblings' evidence and verdicts without a passage are NONE; an unknown passage number is the first.
    Of several verdicts on one skill the strongest counts.
    """
    lists = passages.groupBy(key, "skill").agg(F.sort_array(F.collect_list(F.struct("passage_index", "sequence"))).alias("at"))
    rows = sibling_leaks(verdicts, siblings, key).join(lists, [key, "skill"])
    strength = F.when(F.col("strength").isin(*ALLOWED) & ~F.col("leak"), F.col("strength")).otherwise("NONE")
    place = F.when(F.col("passage_index").between(0, F.size("at") - 1), F.col("passage_index")).otherwise(0).cast("int")
    rows = rows.select(key, "skill", strength.alias("strength"), F.coalesce("explanation", F.lit("")).alias("explanation"), F.get("at", place)["sequence"].alias("sequence"))
    rows = rows.withColumn("sequence", F.when(F.col("strength") != "NONE", F.col("sequence")))
    best = F.max_by(F.struct("strength", "explanation", "sequence"), F.struct(_rank("strength"), "explanation"))
    return rows.groupBy(key, "skill").agg(best.alias("v")).select(key, "skill", "v.*")


def _rank(column: str) -> F.Column:
    return F.array_position(F.array(*[F.lit(s) for s in STRENGTHS]), F.col(column))


def upgraded(graded: DataFrame, checked: DataFrame, key: str = "resume_id") -> DataFrame:
    """``graded`` (key, skill, sources, strength, kind, evidence) raised by ``checked`` verdicts, never lowered; what is raised is INFERRED.
    With ``judged`` (the verdict's chunk, or null) and ``explanation``."""
    given = checked.where("strength <> 'NONE'").select(key, "skill", F.col("strength").alias("given"), "explanation", F.col("sequence").alias("judged"))
    rows = graded.join(given, [key, "skill"], "left")
    higher = F.coalesce(_rank("given") > _rank("strength"), F.lit(False))
    return rows.select(
        key, "skill", "sources", F.when(higher, F.col("given")).otherwise(F.col("strength")).alias("strength"), F.when(higher, "INFERRED").otherwise(F.col("kind")).alias("kind"), "evidence", "judged", "explanation"
    )


def evidence_rows(skills: DataFrame, key: str = "resume_id", most: int = MOST_CHUNKS) -> DataFrame:
    """(key, skill, sequence, kind, strength, explanation, confidence): the verdict's row, if any, and up to ``most`` graded chunks of ``upgraded`` skills."""
    judged = F.when(F.col("judged").isNotNull(), F.array(F.struct(F.col("judged").cast("long").alias("sequence"), F.col("explanation").alias("explanation"), F.lit(FROM_VERDICT).alias("confidence"))))
    graded = F.transform(F.slice("evidence", 1, most), lambda s: F.struct(s.cast("long").alias("sequence"), F.lit(None).cast("string").alias("explanation"), F.lit(FROM_GRADE).alias("confidence")))
    none = F.array().cast("array<struct<sequence:bigint,explanation:string,confidence:double>>")
    rows = skills.select(key, "skill", "kind", "strength", F.explode(F.concat(F.coalesce(judged, none), graded)).alias("x"))
    return rows.select(key, "skill", "x.sequence", "kind", "strength", "x.explanation", "x.confidence")


def skill_flags(rows: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, skill, project_backed, experience_linked) of evidence rows."""
    has = lambda kinds: F.bool_or(F.col("kind").isin(*kinds))
    return rows.groupBy(key, "skill").agg(has(BACKED).alias("project_backed"), has(LINKED).alias("experience_linked"))
