"""Catalogs: loading, keys, upserts, lookup tables, and the cascade that resolves mentions to entities.

Mentions are resolved once per distinct text; resolved texts leave the cascade, so the fuzzy join sees only the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenure.functions import likeness
from tenure.functions.words import is_plausible_skill
from tenure.stages import stage


@dataclass(frozen=True)
class Cutoffs:
    """Confidence of an alias match, least fuzzy ratio, confidence that decides alone, lead over the next candidate, least vector similarity."""

    alias: float
    fuzzy: float
    strong: float
    lead: float = 0.08
    semantic: float = 0.55


# Fixed values.
SKILLS, ROLES = Cutoffs(alias=0.97, fuzzy=0.88, strong=0.92), Cutoffs(alias=0.95, fuzzy=0.85, strong=0.90)
EXACT = 1.0
ALIAS_KINDS = {"aliases": "ALIAS", "abbreviations": "ABBREVIATION", "misspellings": "MISSPELLING"}


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold a JSON array each, of objects or (``schema`` of one column) of plain values."""
    columns = spark.createDataFrame([], schema).columns
    item = schema if len(columns) > 1 else schema.split(" ", 1)[1]
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<struct<{item}>>" if len(columns) > 1 else f"array<{item}>")).alias("x"))
    return rows.select("x.*") if len(columns) > 1 else rows.select(F.col("x").alias(columns[0]))


def alias_rows(seed: DataFrame, key: str) -> DataFrame:
    """(key, alias, kind) from the array columns of ``ALIAS_KINDS``; nulls are empty."""
    kinds = [F.struct(F.col(c).alias("texts"), F.lit(kind).alias("kind")) for c, kind in ALIAS_KINDS.items()]
    return seed.select(key, F.explode(F.array(*kinds)).alias("x")).select(key, F.explode("x.texts").alias("alias"), "x.kind")


def replace_children(children: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``children`` in which those of every key of ``new`` are ``new``'s."""
    return children.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def catalog_text(name: Column, label: str, group: Column, description: Column) -> Column:
    """Text of a catalog entry to embed, e.g. with ``label`` "Category" or "Family"; nulls are empty."""
    text = F.concat(name, F.lit(f". {label}: "), F.coalesce(group, F.lit("")), F.lit(". "), F.coalesce(description, F.lit("")))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def loose_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)[\s\-.]", ""))


def stable_id(key: Column) -> Column:
    """Non-negative 64-bit id: the first eight bytes of the key's SHA-256 without the top bit."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, -10).cast("long").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def upsert(catalog: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Rows of ``seed`` replace those of ``catalog`` with their key; the others of both stay."""
    return catalog.join(seed, key, "left_anti").unionByName(seed)


def insert_missing(table: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    return table.unionByName(seed.dropDuplicates([key]).join(table, key, "left_anti"))


def dangling(rows: DataFrame, catalog: DataFrame, key: str, catalog_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose reference is in the catalog, the others)."""
    known = catalog.select(F.col(catalog_key).alias(key))
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti")


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(key).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def ratio(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def near_keys(texts: DataFrame, pool: DataFrame, least: float, edits_per_length: float) -> DataFrame:
    """(key, pool_key): every pair of ``texts`` (key) and ``pool`` (key) that at most ``edits_per_length`` x the pool key's length edits part, and few others.

    Lossless blocking: of d + 1 even cuts of the pool's key one stands unchanged in the text, shifted by at most d. Texts join on (place, cut),
    not on all pairs. Lengths of such pairs differ by no more than ``least`` allows.
    """
    edits = lambda length: F.floor(edits_per_length * length + 1e-9).cast("int")
    p = pool.select("key").where("key <> ''").distinct().withColumn("n", F.length("key")).withColumn("d", edits(F.col("n")))
    edge = lambda k: F.floor(k * F.col("n") / (F.col("d") + 1)).cast("int")
    p = p.select(F.col("key").alias("pool_key"), "d", "n", F.explode(F.sequence(F.lit(0), "d")).alias("k"))
    p = p.select("pool_key", "d", (edge(F.col("k")) + 1).alias("from"), F.substr("pool_key", edge(F.col("k")) + 1, edge(F.col("k") + 1) - edge(F.col("k"))).alias("cut")).where("cut <> ''")
    p = p.select("pool_key", F.explode(F.sequence(F.greatest(F.lit(1), F.col("from") - F.col("d")), F.col("from") + F.col("d"))).alias("at"), "cut")
    # sizes of cuts that keys of a similar length can have
    n = F.length("key")
    lengths = F.sequence(F.greatest(F.lit(1), F.floor(n * least).cast("int")), F.ceil(n / least).cast("int"))
    sizes = F.array_distinct(F.flatten(F.transform(lengths, lambda x: F.array(F.floor(x / (edits(x) + 1)).cast("int"), F.ceil(x / (edits(x) + 1)).cast("int")))))
    t = texts.where(n > 0).select("key", F.explode(F.filter(sizes, lambda x: x > 0)).alias("size"))
    t = t.select("key", "size", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("at")).select("key", "at", F.substr("key", F.col("at"), F.col("size")).alias("cut")).distinct()
    return t.join(p, ["at", "cut"]).select("key", "pool_key").distinct()


def fuzzy_candidates(texts: DataFrame, pool: DataFrame, least: float) -> DataFrame:
    """(key, entity, ratio) of pairs at least ``least`` alike by Levenshtein ratio: at most (1 - least) x the longer length edits part them."""
    pairs = near_keys(texts, pool, least, (1 - least) / least).withColumn("ratio", ratio(F.col("key"), F.col("pool_key"))).where(F.col("ratio") >= least)
    return pairs.join(pool.select(F.col("key").alias("pool_key"), "entity"), "pool_key").groupBy("key", "entity").agg(F.max("ratio").alias("ratio"))


def _contained(short: DataFrame, long: DataFrame, least: float) -> DataFrame:
    """(short, long): every pair whose shorter text is at least ``least`` alike to a stretch of the longer one, and few others. With at most d
    inserted or deleted signs one of d + 1 cuts stands in the longer text, so its first signs, four at most, do."""
    n = F.length("key")
    d = F.floor(2 * (1 - least) * n + 1e-9).cast("int")
    edge = lambda k: F.floor(k * n / (d + 1)).cast("int")
    s = short.where(n > 0).select("key", F.explode(F.sequence(F.lit(0), d)).alias("k"))
    s = s.select(F.col("key").alias("short"), F.substr("key", edge(F.col("k")) + 1, F.least(F.lit(4), edge(F.col("k") + 1) - edge(F.col("k")))).alias("gram"))
    t = long.where(n > 0).select("key", F.explode(F.sequence(F.lit(1), n)).alias("at")).select("key", "at", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("size"))
    t = t.where(F.col("at") + F.col("size") - 1 <= n).select(F.col("key").alias("long"), F.substr("key", F.col("at"), F.col("size")).alias("gram")).distinct()
    pairs = s.where("gram <> ''").distinct().join(t, "gram")
    # lengths first: pairs of similar lengths aren't compared in part, nor those that lie far apart
    times = F.length("long") / F.length("short")
    return pairs.where((times >= likeness.IN_PART_FROM) & (times <= likeness.FAR_FROM)).select("short", "long").distinct()


def mixed_candidates(texts: DataFrame, pool: DataFrame, least: float) -> DataFrame:
    """(key, entity, ratio) of pairs whose mixed ratio is ``least`` (over 0.6) or more; ``texts`` (key) and ``pool`` (key, entity) as they are.

    A pair is compared if one of these lossless filters lets it pass: few enough inserted and deleted signs for the whole texts or for their sorted words; a common word, where
    its share or its mere presence can be enough; a stretch that holds the shorter text.
    """
    edits = lambda s: 2 * (1 - s) / s  # noqa: E731  for each sign of one text, as the other has at most (2 - s) / s times as many
    texts, pool_keys = texts.select("key").where("key <> ''").distinct(), pool.select("key").where("key <> ''").distinct()
    pair = lambda a, b: (F.col(a).alias("key"), F.col(b).alias("pool_key"))
    length = lambda s: s / (2 - s)  # noqa: E731  least quotient of lengths for a ratio of s
    found = near_keys(texts, pool_keys, length(least), edits(least)).select(*pair("key", "pool_key"))
    by_words = least / likeness.BY_WORDS
    if by_words <= 1:
        forms = F.array_distinct(F.array(likeness.joined(likeness.tokens(F.col("key"))), likeness.joined(F.array_distinct(likeness.tokens(F.col("key"))))))
        t, p = (df.select(F.col("key").alias("whole"), F.explode(forms).alias("key")) for df in (texts, pool_keys))
        near = near_keys(t, p, length(by_words), edits(by_words))
        near = near.join(t.withColumnRenamed("whole", "t"), "key").join(p.select(F.col("whole").alias("p"), F.col("key").alias("pool_key")), "pool_key")
        found = found.unionByName(near.select(*pair("t", "p")))
        # a common word counts between texts of similar lengths, and between others where it alone is enough
        words = lambda df, name: df.select(F.col("key").alias(name), F.explode(F.array_distinct(likeness.tokens(F.col("key")))).alias("word"))
        times = F.greatest(F.length("t"), F.length("p")) / F.least(F.length("t"), F.length("p"))
        alone = likeness.BY_WORDS * likeness.IN_PART >= least
        common = words(texts, "t").join(words(pool_keys, "p"), "word").where(times <= likeness.FAR_FROM if alone else times < likeness.IN_PART_FROM)
        found = found.unionByName(common.select(*pair("t", "p")))
    in_part = least / likeness.IN_PART
    if in_part <= 1:
        found = found.unionByName(_contained(texts, pool_keys, in_part).select(*pair("short", "long"))).unionByName(_contained(pool_keys, texts, in_part).select(*pair("long", "short")))
    pairs = stage(found.distinct(), "mixed-pairs").withColumn("ratio", likeness.mixed_ratio(F.col("key"), F.col("pool_key"))).where(F.col("ratio") >= least)
    return pairs.join(pool.select(F.col("key").alias("pool_key"), "entity"), "pool_key").groupBy("key", "entity").agg(F.max("ratio").alias("ratio"))


def lookup(catalog: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, entity) of names and of aliases. ``catalog``: (entity) with optional ``active`` and ``display``; ``aliases``: (entity, alias).

    Inactive entities and their aliases are out; a display name counts where no entity's own name has its key.
    """
    if "active" in catalog.columns:
        catalog = catalog.where("active")
    names = catalog.select(loose_key(F.col("entity")).alias("key"), "entity", F.lit(1).alias("own"))
    if "display" in catalog.columns:
        names = names.unionByName(catalog.where("display is not null").select(loose_key(F.col("display")).alias("key"), "entity", F.lit(0).alias("own")))
    exact = names.groupBy("key").agg(F.max_by("entity", F.struct("own", "entity")).alias("entity"))
    other = aliases.join(catalog.select("entity"), "entity", "left_semi").groupBy(loose_key(F.col("alias")).alias("key")).agg(F.max("entity").alias("entity"))
    return exact, other


def fuzzy_pool(catalog: DataFrame, aliases: DataFrame, loose_names: bool = True) -> DataFrame:
    """(key, entity) that misspelt texts are compared with: names by their loose keys (skills) or as lower-case titles with their spaces (roles), and lower-case alias
    texts where no name has the key."""
    exact = lookup(catalog, aliases)[0]
    if not loose_names:
        exact = (catalog.where("active") if "active" in catalog.columns else catalog).groupBy(F.lower("entity").alias("key")).agg(F.max("entity").alias("entity"))
    known = catalog.where("active") if "active" in catalog.columns else catalog
    other = aliases.join(known.select("entity"), "entity", "left_semi").groupBy(F.lower("alias").alias("key")).agg(F.min("entity").alias("entity"))
    return exact.select("key", "entity").unionByName(other.join(exact, "key", "left_anti").select("key", "entity"))


def rank_candidates(mentions: DataFrame, catalog: DataFrame, aliases: DataFrame, cutoffs: Cutoffs = SKILLS, semantic: DataFrame | None = None, pool: DataFrame | None = None) -> DataFrame:
    """(text, entity, method, confidence, rank, confident) of each distinct mention (text); absent without a candidate.

    An exact key decides, then an alias key, then the best fuzzy ratio from ``cutoffs.strong``. Else the best fuzzy candidate and the
    vector candidates ``semantic`` (text, entity, similarity) are ranked, each entity once; the first is confident from
    ``cutoffs.strong`` if it is alone or leads by ``cutoffs.lead``.
    """
    exact, other = (stage(x, name) for x, name in zip(lookup(catalog, aliases), ("names", "aliases"), strict=True))
    four = lambda c: F.round(c.cast("decimal(18,8)"), 4).cast("double")
    # one pass: a text carries the entity of its exact key, of its alias key, and its best fuzzy candidate
    texts = mentions.select("text").distinct().withColumn("key", loose_key(F.col("text")))
    texts = texts.join(exact.withColumnRenamed("entity", "by_name"), "key", "left").join(other.withColumnRenamed("entity", "by_alias"), "key", "left")
    texts = stage(texts, "mentions")
    open_ = texts.where("by_name is null and by_alias is null")
    if pool is None:
        found = fuzzy_candidates(open_.select("key").distinct(), exact.unionByName(other), cutoffs.fuzzy)
    else:
        found = mixed_candidates(open_.select(F.col("text").alias("key")), stage(pool, "fuzzy-pool"), cutoffs.fuzzy).withColumnRenamed("key", "text")
    by = "key" if pool is None else "text"
    found = found.groupBy(by).agg(F.min_by(F.struct("entity", "ratio"), F.struct(-F.col("ratio"), "entity")).alias("near"))
    texts = stage(texts.join(found, by, "left"), "matched-mentions")
    ratio_, method = F.col("near.ratio"), F.when(F.col("by_name").isNotNull(), "EXACT").when(F.col("by_alias").isNotNull(), "ALIAS")
    sure = method.when(F.col("near.ratio") >= cutoffs.strong, "FUZZY")
    confidence = F.when(F.col("by_name").isNotNull(), EXACT).when(F.col("by_alias").isNotNull(), cutoffs.alias).otherwise(four(ratio_))
    out = texts.where(sure.isNotNull()).select("text", F.coalesce("by_name", "by_alias", "near.entity").alias("entity"), sure.alias("method"), confidence.alias("confidence"), F.lit(1).alias("rank"), F.lit(True).alias("confident"))
    rest = texts.where(sure.isNull())
    weak = rest.where("near is not null").select("text", "near.entity", F.lit("FUZZY").alias("method"), four(ratio_).alias("confidence"))
    if semantic is not None:
        near = semantic.where(F.col("similarity") >= cutoffs.semantic).join(rest.select("text"), "text", "left_semi")
        weak = weak.unionByName(near.select("text", "entity", F.lit("SEMANTIC").alias("method"), four(F.col("similarity")).alias("confidence")))
    weak = weak.groupBy("text", "entity").agg(F.max_by("method", F.struct("confidence", "method")).alias("method"), F.max("confidence").alias("confidence"))
    order = Window.partitionBy("text").orderBy(F.col("confidence").desc(), "entity")
    weak = weak.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("confidence").over(order))
    alone = (F.col("confidence") >= cutoffs.strong) & (F.col("next").isNull() | (F.col("confidence") - F.col("next") >= cutoffs.lead))
    return out.unionByName(weak.select("text", "entity", "method", "confidence", "rank", ((F.col("rank") == 1) & alone).alias("confident")))


def resolve(mentions: DataFrame, catalog: DataFrame, aliases: DataFrame, cutoffs: Cutoffs = SKILLS, semantic: DataFrame | None = None, pool: DataFrame | None = None) -> DataFrame:
    """(text, entity, method, confidence, confident): the first candidate of each distinct mention."""
    return rank_candidates(mentions, catalog, aliases, cutoffs, semantic, pool).where("rank = 1").drop("rank")


def resolve_skills(mentions: DataFrame, catalog: DataFrame, aliases: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Ranked candidates of the mentions that may name a skill at all."""
    return rank_candidates(mentions.where(is_plausible_skill(F.col("text"))), catalog, aliases, SKILLS, semantic)


def search(catalog: DataFrame, column: str, query: str, limit: int = 20) -> DataFrame:
    """Case-insensitive substring search for two characters at least; a top-``limit`` report in name order."""
    if len(query) < 2:
        return catalog.limit(0)
    return catalog.where(F.contains(F.lower(column), F.lit(query.lower()))).orderBy(column).limit(limit)
