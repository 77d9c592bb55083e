"""Catalog roles on the role rows of career documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions import rules
from tenure.operators import catalog as catalogs

UNKNOWN = "Unknown"


def with_catalog_roles(roles: DataFrame, catalog: DataFrame, aliases: DataFrame, key: str = "resume_id", semantic: DataFrame | None = None) -> DataFrame:
    """``roles`` (key, place, title, ...) with role_id, canonical_title, family, level, level_source and ambiguous.

    ``catalog``: (entity, title, family, level), where entity is the id and title the text that is matched; ``aliases``: (entity, alias). A title that is confidently resolved
    has the catalog's title and family, and its level if the catalog gives one. Else the level is the rule's; an ambiguous title has that of the
    document's titled role before it, as the rules see it, or the default. Roles without a title inherit nothing and pass nothing on.
    """
    titled = roles.where(F.col("title") != UNKNOWN).select(F.col("title").alias("text"))
    names = catalog.select(F.col("title").alias("entity"))
    by_title = aliases.join(catalog.select("entity", "title"), "entity").select(F.col("title").alias("entity"), "alias")
    found = catalogs.resolve(titled, names, by_title, catalogs.ROLES, semantic, catalogs.fuzzy_pool(names, by_title, loose_names=False)).where("confident")
    known = found.select(F.col("text").alias("title"), F.col("entity").alias("canonical_title"))
    known = known.join(catalog.select(F.col("title").alias("canonical_title"), F.col("entity").alias("role_id"), "family", F.col("level").alias("_given")), "canonical_title")
    has = F.col("title") != UNKNOWN
    own = F.when(has, rules.seniority(F.col("title")))
    by = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = roles.withColumn("_own", own)
    rows = rows.withColumn("_carried", F.coalesce(F.last("_own", ignorenulls=True).over(by), F.lit(rules.DEFAULT_LEVEL)))
    rows = rows.join(known, "title", "left")
    level = F.when(has, F.coalesce("_given", "_carried"))
    source = F.when(~has, "none").when(F.col("_given").isNotNull(), "catalog").when(F.col("_own").isNotNull(), "rule").otherwise("inherited")
    return rows.select(*roles.columns, "role_id", "canonical_title", "family", level.alias("level"), source.alias("level_source"), (has & F.col("_own").isNull()).alias("ambiguous"))
