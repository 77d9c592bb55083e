"""I-Match document fingerprints (operator 2), DataFrame functions only.

Terms are the runs of letters and digits of the lower-cased text. The lexicon is the band of terms whose
inverse document frequency ln(N / df) lies between ``IDF_LOW`` and ``IDF_HIGH``; as the band is relative to the
number of documents N, the lexicon has at most (mean distinct terms of a document) x e^IDF_HIGH terms, whatever
N is. A document keeps its distinct lexicon terms, sorted; their hash is the main fingerprint. 32 randomised subsets
of the lexicon, from every fourth term to every 256th, give further hashes of the kept terms. Two
fingerprints' likeness is the share of subsets with equal hashes among the subsets that either document has terms in.

Documents with fewer than ``THIN`` lexicon terms are hashed over all their terms. Without terms in any subset
on either side, the likeness is 1 for equal fingerprints, else 0. Null texts are empty. Every row has a row of the result, repeated ones
too; if rows with one id differ, their predecessor is edited with the smallest of their texts. Rows without an id have no next
document: nothing replaces their end, and near_next is null. An empty table gives an empty result. Extra columns are ignored.

Texts are exchanged once, by ranges of doc_id whose first ids are collected (one long per range, ``RANGES`` times as many as
shuffle partitions). The first id's rows go to the range before, too, so each range knows the document that follows its
last; all later steps (edit, terms, lexicon, fingerprints, likeness) keep that partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.common import materialize, small_side

IDF_LOW, IDF_HIGH, THIN = 3.0, 9.0, 3
#: A subset has every 2^i-th term of the lexicon: sparse ones tell long documents apart, dense ones short ones.
SUBSETS = (2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 4, 5, 5, 5, 5, 5, 6, 6, 6, 6, 6, 6, 7, 7, 7, 7, 7, 8, 8, 8, 8, 8)
#: Ranges of ids for each shuffle partition.
RANGES = 4
#: Rows of one long each that a broadcast lexicon may have; larger ones are joined by a shuffle.
LEXICON_ROWS = 1_000_000


def term_hashes(text) -> F.Column:
    """Distinct 64-bit hashes of the terms of a text column."""
    terms = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, idf_low: float = IDF_LOW, idf_high: float = IDF_HIGH) -> DataFrame:
    """(term) hashes of the terms in the band; terms of one document only are never in it."""
    n = docs.count()
    df = docs.select(F.explode(term_hashes("text")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(max(n, 1))) / F.col("df"))
    return df.where((F.col("df") > 1) & (idf >= idf_low) & (idf <= idf_high)).select("term")


def range_of(bounds: list[int]) -> F.Column:
    """Number of the last of the ascending bounds that doc_id reaches; -1 before the first. Looks at every k-th bound, then at the k behind."""
    k = math.isqrt(len(bounds)) or 1
    reached = lambda among: F.size(F.filter(among, lambda b: b <= F.col("doc_id")))
    part = reached(F.lit(bounds[::k]))
    groups = F.lit([bounds[i : i + k] for i in range(0, len(bounds), k)])
    return F.when(part > 0, (part - 1) * k + reached(F.element_at(groups, part)) - 1).otherwise(-1)


def range_starts(ids: DataFrame, parts: int) -> list[int]:
    """First ids of at most ``parts`` ranges with about as many rows each; empty without ids."""
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(parts)], 100 * parts)).first()[0]
    if not cuts:
        return []
    # cuts are approximate: take the ids that are there
    return sorted(row["first"] for row in ids.groupBy(range_of(sorted(set(cuts)))).agg(F.min("doc_id").alias("first")).collect())


def following(rows: DataFrame, tie: str, columns: list[str]) -> DataFrame:
    """Adds next_ columns: those of the document after each row's (its first row by ``tie``) within the row's range."""
    ahead = Window.partitionBy("range").orderBy("ghost", "doc_id", tie)
    same = Window.partitionBy("range", "ghost", "doc_id").orderBy(tie).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("*", *[F.lead(c).over(ahead).alias(f"lead_{c}") for c in columns])
    rows = rows.select(*[c for c in rows.columns if not c.startswith("lead_")], *[F.last(f"lead_{c}").over(same).alias(f"next_{c}") for c in columns])
    return rows


def likeness(a, b, same) -> F.Column:
    """Share of equal subset hashes among those that either side has (nulls: no terms)."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    seen = F.size(F.filter(pairs, lambda x: x["a"].isNotNull() | x["b"].isNotNull()))
    equal = F.size(F.filter(pairs, lambda x: x["a"] == x["b"]))
    return F.when(seen > 0, equal / seen).otherwise(F.when(same, 1.0).otherwise(0.0))


def signature(kept, everything, subsets: tuple[int, ...] = SUBSETS, thin: int = THIN) -> tuple[F.Column, F.Column]:
    """(fingerprint, subset hashes) of sorted lexicon terms; ``everything`` is the hash of all terms."""
    drawn = lambda k: lambda t: F.xxhash64(t, F.lit(k)).bitwiseAND(F.lit((1 << subsets[k]) - 1)) == 0
    sigs = F.transform(F.array(*[F.filter(kept, drawn(k)) for k in range(len(subsets))]), lambda s: F.when(F.size(s) > 0, F.xxhash64(s)))
    main = F.when(F.size(kept) >= thin, F.xxhash64(kept)).otherwise(everything)
    return main, sigs


def edited_pairs(docs: DataFrame) -> DataFrame:
    """(range, ghost, doc_id, next_id, n_chars, text, edited): the later half of each text replaced from the next document's start.

    Rows with ghost = 1 are the next range's first document once more.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = range_starts(rows.where("doc_id is not null").select("doc_id"), parts)
    lost = -1 - F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")  # rows without an id, by text
    own = F.struct((F.when(F.col("doc_id").isNull(), lost).otherwise(range_of(starts)) if starts else lost).alias("range"), F.lit(0).alias("ghost"))
    places = F.array(own)
    if starts:
        before = F.struct(F.pmod(own["range"] - 1, F.lit(len(starts))).alias("range"), F.lit(1).alias("ghost"))
        places = F.when(F.col("doc_id").isin(starts), F.array(own, before)).otherwise(places)
    rows = rows.select("doc_id", "text", F.explode(places).alias("at")).select("at.range", "at.ghost", "doc_id", "text")
    rows = following(rows, "text", ["doc_id", "text"])
    n = F.char_length("text").cast("long")
    real = F.col("doc_id").isNotNull() & (F.col("ghost") == 0)
    rows = rows.select("range", "ghost", "doc_id", F.when(real, F.col("next_doc_id")).alias("next_id"), n.alias("n_chars"), "text", F.when(real, F.col("next_text")).otherwise("").alias("head"))
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(head, 1, cast(n_chars div 2 as int)))")
    return rows.select("range", "ghost", "doc_id", "next_id", "n_chars", "text", edited.alias("edited"))


def fingerprint_edits(docs: DataFrame, idf_low: float = IDF_LOW, idf_high: float = IDF_HIGH) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    Each row's terms meet the lexicon one by one. A carrier row with a random term brings what they all share through the join, so the
    other exploded rows stay narrow; carriers also tell how often a row is there.
    """
    terms = small_side(materialize(lexicon(docs.select("doc_id", "text"), idf_low, idf_high).withColumn("known", F.lit(True)), "lexicon"), LEXICON_ROWS)
    keys, rest = ["range", "ghost", "doc_id", "key"], ["next_id", "n_chars", "edited_sha256", "all_0", "all_1"]
    rows = edited_pairs(docs).select("range", "ghost", "doc_id", F.xxhash64("text").alias("key"), "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), term_hashes("text").alias("h0"), term_hashes("edited").alias("h1"))
    rows = rows.select("*", *[F.xxhash64(F.sort_array(f"h{k}")).alias(f"all_{k}") for k in (0, 1)])
    side = lambda k: F.transform(f"h{k}", lambda t: F.struct(F.lit(k).alias("side"), t.alias("term")))
    carrier = F.array(F.struct(F.lit(2).alias("side"), F.xxhash64("doc_id", "key").alias("term")))
    each = rows.select(*keys, *rest, F.explode(F.concat(side(0), side(1), carrier)).alias("v")).select(*keys, *rest, "v.side", "v.term")
    each = each.select(*keys, *[F.when(F.col("side") == 2, F.col(c)).alias(c) for c in rest], "side", "term")
    terms_of = lambda k: F.sort_array(F.collect_set(F.when(F.col("side") == k, F.col("term")))).alias(f"t{k}")
    found = each.join(terms, "term", "left").where("known or side = 2")
    found = found.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest], F.count_if(F.col("side") == 2).alias("copies"), terms_of(0), terms_of(1))
    for k in (0, 1):
        main, sigs = signature(F.col(f"t{k}"), F.col(f"all_{k}"))
        found = found.withColumn(f"main_{k}", main).withColumn(f"sigs_{k}", sigs).drop(f"t{k}", f"all_{k}")
        name = F.lower(F.concat(F.lpad(F.hex(f"main_{k}"), 16, "0"), F.lit("-"), F.lpad(F.hex(F.xxhash64(f"sigs_{k}")), 16, "0")))
        found = found.withColumn(f"print_{k}", name).drop(f"main_{k}")
    near_edited = likeness(F.col("sigs_0"), F.col("sigs_1"), F.col("print_0") == F.col("print_1"))
    found = found.withColumn("near_edited", near_edited).drop("sigs_1")
    found = following(found, "key", ["print_0", "sigs_0"]).where("ghost = 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    near_next = likeness(F.col("sigs_0"), F.col("next_sigs_0"), F.col("print_0") == F.col("next_print_0"))
    return found.select("doc_id", "n_chars", "edited_sha256", F.col("print_0").alias("fingerprint"), F.col("print_1").alias("edited_fingerprint"), "near_edited", F.when(F.col("next_id").isNotNull(), near_next).alias("near_next"))
