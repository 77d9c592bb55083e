"""Shared pieces of the training-data operators.

* ``materialize``: a written table in the folder that ``spark.checkpoint.dir`` names, so that a lost
  executor costs a re-read and no recomputation.
* ``small_side``: broadcast behind a count, a shuffle join beyond it.
* ``connected_components``: alternating large-star and small-star steps on edge tables.
* ``in_blocks``, ``within_tasks``, ``across_tasks``: how the members of candidate clusters of any size meet in bounded tasks.
* numpy helpers that find and hash the words of a block of texts without a Python loop per word.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the ASCII white space characters (a fixed contract value).
SPACE = r"[\x20\x09-\x0D]+"
#: Rows that a broadcast side may have; a row of the sides used here takes under 100 bytes.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a local session, which is one machine, may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tenure.scratch", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.tenure.scratch", folder)
    return f"{folder.rstrip('/')}/tenure-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, by: str | None = None, **options) -> DataFrame:
    """Write ``df`` (with the writer's ``options``) to the shared folder and read it back: lineage ends here, sizes are known to the planner. With ``by`` a folder for each of its values."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tenure_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.tenure_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, items: str | None = None) -> DataFrame:
    """Hint a broadcast if ``df`` (a written table, so counting is cheap) has at most ``rows`` rows, and items in the array column ``items``."""
    if df.limit(rows + 1).count() > rows:
        return df
    if items and (df.agg(F.sum(F.size(items))).first()[0] or 0) > rows:
        return df
    return F.broadcast(df)


def n_words(text) -> F.Column:
    """Number of words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def words(text) -> F.Column:
    """Array of the words of a text column (null: no words)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


# --------------------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Components of an undirected graph given as rows (src, dst) of longs.

    Returns (node, component) for every node of an edge; ``component`` is the smallest node of its
    component. Alternates large-star and small-star until a round changes nothing; each half is one
    aggregate with map-side minimum and one join whose hot keys AQE splits. No node list is gathered.
    An empty edge table gives an empty result; self-loops and repeated edges are harmless.
    """
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
    e = materialize(e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), name)
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        new = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        new = materialize(new.where("src <> dst").distinct(), name)
        discard(e)
        least = new.groupBy("src").agg(F.min("dst").alias("m"))
        pairs = new.join(least, "src")
        e = pairs.select("dst", "m").unionByName(pairs.select(F.col("src").alias("dst"), "m"))
        e = e.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        e = materialize(e, name)
        discard(new)
        before, state = state, _state(e)
        if before == state:
            break
    roots = e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)


def _state(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()
    return row["n"], row["x"] or 0


# --------------------------------------------------------------------------- clusters of any size in bounded tasks


def _counted(rows: DataFrame, most_rows: int, most_weight: int) -> DataFrame:
    k = F.greatest(F.ceil(F.sum("weight") / F.lit(most_weight)), F.ceil(F.count("*") / F.lit(most_rows))).cast("int")
    return rows.groupBy("cluster").agg(F.count("*").alias("n_rows"), k.alias("k"))


def _dealt(number: int, k) -> F.Column:
    return F.pmod(F.xxhash64("id", F.lit(number)), k).cast("int")


def in_blocks(members: DataFrame, most_rows: int, most_weight: int) -> DataFrame:
    """``members`` (id, cluster, weight, ...) with n_rows of the cluster, its number k of blocks of at most about ``most_rows`` rows
    and ``most_weight``, and the row's block."""
    return members.join(_counted(members, most_rows, most_weight), "cluster").withColumn("block", _dealt(1, F.col("k")))


def within_tasks(members: DataFrame, anchors: int) -> DataFrame:
    """Rows in blocks with their ``label`` (id) and ``todo``: array of (task, stored). Each block is one task; some
    ``anchors`` rows of a cluster of several blocks are in all of them, so that what is alike in all blocks is connected."""
    anchor = (F.col("k") > 1) & (F.pmod(F.xxhash64("id", F.lit(2)), F.col("n_rows")) < anchors)
    inside = F.when(anchor, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array("block"))
    return members.withColumn("label", F.col("id")).withColumn("todo", F.transform(inside, lambda b: F.struct(b.cast("long").alias("task"), F.lit(True).alias("stored"))))


def across_tasks(members: DataFrame, found: DataFrame, most_rows: int, most_weight: int, name: str) -> DataFrame:
    """Rows of clusters of several blocks with ``label`` (their component under the edges ``found``) and ``todo``: what is outside of its
    cluster's largest component is dealt into blocks, and each of these (stored) meets each block of the cluster."""
    parts = connected_components(found, name)
    rows = members.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    rows = materialize(rows, name)
    largest = rows.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    rows = rows.join(largest, "cluster").withColumn("open", F.col("label") != F.col("largest"))
    rows = rows.join(_counted(rows.where("open"), most_rows, most_weight).select("cluster", F.col("k").alias("open_k")), "cluster")
    task = lambda at, block: (at * F.col("k").cast("long") + block).alias("task")
    probing = F.transform(F.sequence(F.lit(0), F.col("open_k") - 1), lambda at: F.struct(task(at, F.col("block")), F.lit(False).alias("stored")))
    own = _dealt(3, F.col("open_k"))
    kept = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda block: F.struct(task(own, block), F.lit(True).alias("stored")))
    return rows.withColumn("todo", F.when(F.col("open"), F.concat(probing, kept)).otherwise(probing))


# --------------------------------------------------------------------------- numpy on text blocks

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: Random value of a byte at a place (modulo 64) of its word: tabulation hashing.
_TABLE = _RNG.integers(0, 2**64, size=(64, 256), dtype=U)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), on a copy."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into slices of about ``most`` bytes of text, at least one row each.

    Yields (slice, bytes, offsets): row i's text is ``bytes[offsets[i]:offsets[i + 1]]``; null is empty.
    """
    for batch in batches:
        column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not len(column):
            continue
        wide = pa.types.is_large_string(column.type)
        raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(raw, raw[a] + most, "right")) - 1)
            yield batch.slice(a, b - a), data[raw[a] : raw[b]], raw[a : b + 1] - raw[a]
            a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words; words end at row ends."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~space[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cut = offsets[(offsets < len(data))]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    cut = offsets[(offsets > 0) & (offsets <= len(data))] - 1
    after[cut] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of non-empty byte spans in ascending order that don't overlap; in blocks, so memory is bounded."""
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + (1 << 20), "right")))
        lens = ends[a:b] - starts[a:b]
        at = np.cumsum(lens) - lens
        place = np.arange(int(lens.sum())) - np.repeat(at, lens)
        values = _TABLE[place & 63, data[np.repeat(starts[a:b], lens) + place]]
        if lens.max() > 64:
            values *= U(2) * (place >> 6).astype(U) + U(1)
        out[a:b] = mix(np.add.reduceat(values, at) + lens.astype(U) * U(0x9E3779B97F4A7C15))
        a = b
    return out
