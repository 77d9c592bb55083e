"""Vector retrieval on array columns: normalisation, checks, exact scoped top-k, index health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """L2 norm 1; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def checked(rows: DataFrame, column: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(rows with a vector of the dimension, the others): nothing is filled up."""
    good = F.coalesce(F.size(column) == dimension, F.lit(False))
    return rows.where(good), rows.where(~good)


def in_scope(rows: DataFrame, date_from=None, date_to=None, **equal) -> DataFrame:
    """Rows with a vector that equal each given value, and whose span meets [date_from, date_to]; unknown ends are open."""
    rows = rows.where(F.col("vector").isNotNull())
    for c, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(c) == v)
    if date_from is not None:
        rows = rows.where(F.col("end_date").isNull() | (F.col("end_date") >= F.lit(date_from)))
    if date_to is not None:
        rows = rows.where(F.col("start_date").isNull() | (F.col("start_date") <= F.lit(date_to)))
    return rows


# Presets of searches within a document: how many, least score, scope.
PRESETS = {
    "skill_evidence": {"k": 5, "least": 0.3},
    "experience": {"k": 10, "section": "EXPERIENCE"},
    "growth": {"k": 10},
    "section": {"k": 20},
    "project": {"k": 10, "chunk_type": "PROJECT"},
}


def preset_search(queries: DataFrame, rows: DataFrame, scope: str, preset: str, **equal) -> DataFrame:
    """The rows of ``scoped_top_k`` by a preset, found by blocks; further equalities (e.g. section=...) narrow it. Ids are longs."""
    from tenure.operators.topk import block_top_k

    options = dict(PRESETS[preset])
    k, least = options.pop("k"), options.pop("least", None)
    return block_top_k(queries, in_scope(rows, **{**options, **equal}), scope, k, least)[0]


def hydrated(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Hits with the columns of their rows, vectors left out."""
    return hits.join(rows.drop("vector", *[c for c in hits.columns if c != "id" and c in rows.columns]), "id")


def upserted(table: DataFrame, new: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Vectors (id, vector): those of ``new`` replace the table's of their id, of equal ids in ``new`` the largest ``version``; ``deleted`` (id) are out."""
    last = Window.partitionBy("id").orderBy(F.col("version").desc())
    new = new.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    out = table.join(new, "id", "left_anti").unionByName(new)
    return out if deleted is None else out.join(deleted.select("id"), "id", "left_anti")


def not_indexed(rows: DataFrame, index: DataFrame, domain: str) -> DataFrame:
    """Rows (id, ...) that the index (id, domain) doesn't hold for a domain: what must be embedded."""
    return rows.join(index.where(F.col("domain") == domain).select("id"), "id", "left_anti")


def with_provenance(rows: DataFrame, model: str, version: str) -> DataFrame:
    return rows.withColumn("embedding_model", F.lit(model)).withColumn("embedding_version", F.lit(version)).withColumn("embedding_dimension", F.size("vector"))


def scoped_top_k(queries: DataFrame, rows: DataFrame, scope: str, k: int, least: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): exact inner-product top-k among rows of the query's scope.

    ``queries`` (query_id, scope, vector), ``rows`` (id, scope, vector). The floor ``least`` applies after the ranking.
    """
    pairs = queries.select("query_id", scope, F.col("vector").alias("q")).join(rows.select("id", scope, F.col("vector").alias("v")), scope)
    scored = pairs.select("query_id", "id", F.round(dot(F.col("q"), F.col("v")).cast("decimal(18,8)"), 4).cast("double").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    top = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return top if least is None else top.where(F.col("score") >= least)


def health(rows: DataFrame, domain: str, column: str) -> DataFrame:
    return rows.groupBy(domain).agg(F.count("*").alias("vectors"), F.max(F.size(column)).cast("long").alias("dimension"))
