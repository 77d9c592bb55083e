"""Mixing sources to target weights (operator 10), DataFrame functions only.

Sizes are word counts. Targets fill up like water: a source's target is level x weight, but at most
``most`` times its size, with the level chosen so that targets sum to ``share`` of all sizes. With the
sources sorted by the level at which each is full, prefix sums give the level in closed form.

Every document gets a hash-random key (MD5 of its id). Within a source, the key's leading bits range-sort
the documents into buckets of a few thousand, whatever the source's share of the rows; bucket totals are
summed up first (one small row per bucket), then each bucket on its own. Full epochs are taken whole, and
the remaining budget is cut in key order at the document whose middle lies beyond it.

Null texts have size 0; null sources form one source, sorted last; a table without words gets targets of
0. Equal ids are ordered by size; rows that are equal in both get consecutive places. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.common import materialize, n_words, small_side

#: Fixed contract values: weights by place in the order of sources, share of all sizes, most epochs.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BUCKET_ROWS = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, n_docs, source_size, target) from rows (source, size): one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source, not per document
    s = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.partitionBy()
    full = Window.orderBy((F.col("source_size") * most / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    # if all sources that come earlier are full, this is the level of the others
    s = s.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    # the first source that is not full at its level fixes it for all
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("source_size") * most, F.struct(F.col("source_size") * most / F.col("w"), "level"))).over(everything)["level"])
    return s.select("source", "n_docs", "source_size", F.least(F.col("source_size") * F.lit(float(most)), F.coalesce(F.col("level") * F.col("w"), F.lit(0.0))).alias("target"))


def random_key(doc_id) -> F.Column:
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def placed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, whole, epochs): full epochs of the source, and the row's own."""
    sizes = materialize(docs.select("doc_id", "source", n_words("text").alias("size"), random_key("doc_id").alias("key")), "mix-sizes")
    targets = source_targets(sizes, weights, share, most).withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / bucket_rows))).cast("int")).withColumnRenamed("source", "s")
    rows = sizes.join(targets, sizes["source"].eqNullSafe(F.col("s"))).drop("s")
    # the first `bits` of the key's 32 leading bits: ascending buckets are ascending keys
    rows = rows.withColumn("bucket", F.expr("shiftright(cast(conv(substr(key, 1, 8), 16, 10) as bigint), 32 - bits)"))
    rows = materialize(rows, "mix-rows")
    each = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = rows.join(each, rows["source"].eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.col("base") + F.sum("size").over(within))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    epochs = (whole + F.when(F.col("end") * 2 - F.col("size") <= rest * 2, 1).otherwise(0)).cast("int")
    rows = rows.withColumn("epochs", F.least(epochs, F.lit(most)))
    return rows.select("doc_id", "source", "key", "size", "source_size", "target", whole.cast("int").alias("whole"), "epochs")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, epochs, taken) for every row of ``docs`` (doc_id, text, source)."""
    rows = placed(docs, **options)
    return rows.select("doc_id", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).cast("long").alias("taken"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; a document of size 0 is taken with its epochs, too.

    As places ascend with the key, one row per source (full epochs, last key of the part epoch) says it all, and the
    texts stay where they are. Rows of one source with equal ids share one decision.
    """
    over = F.when(F.col("epochs") > F.col("whole"), F.col("key"))
    cuts = placed(docs, **options).groupBy(F.col("source").alias("tenure_source")).agg(F.first("whole").alias("tenure_whole"), F.max(over).alias("tenure_cut"))
    rows = docs.join(small_side(materialize(cuts, "mix-cuts")), docs["source"].eqNullSafe(F.col("tenure_source")))
    epochs = F.col("tenure_whole") + F.when(random_key("doc_id") <= F.col("tenure_cut"), 1).otherwise(0)
    return rows.withColumn("tenure_epoch", F.explode(F.when(epochs > 0, F.sequence(F.lit(1), epochs)))).select(*[docs[c] for c in docs.columns])
