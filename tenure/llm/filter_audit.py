"""Filter interaction audit with a counting-Bloom duplicate prepass.

Five filters judge every whole text: A under 200 words, B under half of the words distinct, C over 2 % capital letters, D holds one of ``#$%&*|``,
E equal to the text of a smaller doc_id. For every order of the five and every step the report has what the step keeps and removes.

1. One scan of the texts writes a narrow table: doc_id, part, the mask of A to D, and the SHA-256 digest of the whole text.
2. Tasks count three cells a digest in segments of a counting Bloom filter; the sketches of a segment are merged by one aggregate. Segments
   grow in number with the documents (8 cells each), not in size. A text with a cell that was counted once is unique for sure.
3. The merged bits are broadcast slice by slice, each slice within ``SLICE_BYTES``. Only texts that the bits don't clear are shuffled: the
   least id of a digest is found with a map-side minimum, and rows meet it on (digest, doc_id), so a text with many copies is spread by the ids.
4. Counts per (part, mask) are additive, at most 32 a part; all orders and steps are sums of them.

Texts are compared by the digest of the whole text, never by the Bloom cells, so the result is exact and no text is shuffled.
Null texts are empty. A null doc_id has no smaller one and equals no label. Rows that repeat a doc_id and its text don't fail E by each other.
Labels that repeat an id count once (the largest). A null source is the empty part. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import materialize, small_side, words

FILTERS = "ABCDE"
#: Cells of a segment, cells counted for a text, cells for each document at least, bytes of merged bits that are broadcast at once.
CELLS, PROBES, LOAD, SLICE_BYTES = 1 << 20, 3, 8, 64 << 20
#: Touched cells that a task holds before it hands them on.
HELD = 1 << 22


def text_mask(text) -> F.Column:
    """Bits of the filters A to D that a text (null: empty) fails."""
    w, text = words(text), F.coalesce(text, F.lit(""))
    fails = (
        F.size(w) < 200,
        100 * F.size(F.array_distinct(w)) < 50 * F.size(w),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def _cells(digests: pa.Array, segments: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each digest, and its cells as numbers over all segments (a row for each digest)."""
    x = np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 4)
    segment = (x[:, 0] % np.uint64(segments)).astype(np.int64)
    places = (x[:, 1:2] + np.arange(PROBES, dtype=np.uint64) * (x[:, 2:3] | np.uint64(1))) % np.uint64(cells)
    return segment, segment[:, None] * cells + places.astype(np.int64)


def bloom_segments(digests: DataFrame, segments: int, size: int = CELLS) -> DataFrame:
    """(segment, bits): of the counting Bloom filter of all rows, the cells counted twice or more. One row a segment of ``size`` cells that has any text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(_cells(batch.column(0), segments, size)[1].ravel())
                n += len(held[-1])
            if held and (batch is None or n >= HELD):
                cells, counts = np.unique(np.concatenate(held), return_counts=True)
                held, n = [], 0
                of = cells // size
                cut = np.flatnonzero(np.diff(of, prepend=-1))
                ends = [*cut[1:], len(cells)]
                counts = np.minimum(counts, 255).astype(np.uint8)
                rows = [((cells[a:b] % size).astype(np.uint32).tobytes(), counts[a:b].tobytes()) for a, b in zip(cut, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(of[cut]), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["segment", "cells", "counts"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.uint32)
        for cells, counts in zip(rows["cells"], rows["counts"], strict=True):
            total[np.frombuffer(cells, np.uint32)] += np.frombuffer(counts, np.uint8)
        return pd.DataFrame({"segment": [int(rows["segment"].iloc[0])], "bits": [np.packbits(total >= 2).tobytes()]})

    sketches = digests.select("digest").mapInArrow(sketch, "segment long, cells binary, counts binary")
    return sketches.groupBy("segment").applyInPandas(merge, "segment long, bits binary")


def possible_repeats(rows: DataFrame, load: int = LOAD, slice_bytes: int = SLICE_BYTES, cells: int = CELLS) -> Iterator[DataFrame]:
    """``rows`` (a written table with ``digest``) with ``maybe``: false if the Bloom filter clears the digest as unique. One frame for each slice
    of segments whose bits are broadcast together; the frames together hold every row once."""
    spark = rows.sparkSession
    segments = max(1, -(-rows.count() * load // cells))
    merged = materialize(bloom_segments(rows, segments, cells), "bloom")
    width = max(1, slice_bytes // (cells // 8))
    for first in range(0, segments, width):
        size = min(width, segments - first)
        table = np.zeros((size, cells // 8), np.uint8)
        for r in merged.where(F.col("segment").between(first, first + size - 1)).toLocalIterator():
            table[r["segment"] - first] = np.frombuffer(r["bits"], np.uint8)
        sent = spark.sparkContext.broadcast(table)

        def probe(batches: Iterator[pa.RecordBatch], first=first, size=size, sent=sent) -> Iterator[pa.RecordBatch]:
            bits = sent.value.reshape(-1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                segment, at = _cells(batch.column(batch.schema.get_field_index("digest")), segments, cells)
                here = (segment >= first) & (segment < first + size)
                batch, at = batch.filter(pa.array(here)), at[here] - first * cells
                maybe = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], [*batch.schema.names, "maybe"])

        yield rows.mapInArrow(probe, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, maybe boolean")


def failure_masks(docs: DataFrame, **sizes) -> DataFrame:
    """(doc_id, part, mask) of every document, written to the shared folder: bit i of the mask stands for filter i of ABCDE.
    ``sizes`` are those of ``possible_repeats``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text"))
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
    rows = materialize(rows.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), digest), "audit-texts")
    out = None
    for some in possible_repeats(rows, **sizes):
        possible = materialize(some.where("maybe").drop("maybe"), "audit-possible")
        least = possible.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
        fails = F.col("least").isNull() & F.col("doc_id").isNotNull()
        judged = possible.join(least, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(fails, 16).otherwise(0)).alias("mask"))
        part = some.where("not maybe").select("doc_id", "part", "mask").unionByName(judged)
        out = part if out is None else out.unionByName(part)
    return materialize(out, "audit-masks")


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows a part. Only documents with a label meet the labels, which are broadcast if few."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = small_side(materialize(known.where("quality = 1 or toxic = 1"), "audit-labels"))
    all_ = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    some = masks.join(known, "doc_id").groupBy("part", "mask")
    some = some.agg(F.lit(0).cast("long").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return all_.unionByName(some).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def order_report(counts: DataFrame) -> DataFrame:
    """All orders of the five filters, step by step, from additive counts of masks; see ``audit_filters`` for the columns."""
    steps = []
    for order in itertools.permutations(range(5)):
        name = "".join(FILTERS[i] for i in order)
        steps += [{"filter_order": name, "step": k + 1, "bit": 1 << i, "before": sum(1 << j for j in order[:k])} for k, i in enumerate(order)]
    kind = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.select("part", "masks", F.explode(F.from_json(F.lit(json.dumps(steps)), kind)).alias("s")).select("part", "masks", "s.*")

    def total(test, value=lambda m: m["n"]) -> F.Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda acc, m: acc + F.when(test(m["mask"]), value(m)).otherwise(0))

    bit, before = F.col("bit"), F.col("before")
    has = lambda mask, bits: mask.bitwiseAND(bits) != 0
    removed = lambda mask: has(mask, bit) & ~has(mask, before)
    # a text that fails k filters is removed by each of them in 120 / k of the orders
    share = lambda m: m["n"] * (F.lit(120) / F.bit_count(m["mask"])).cast("long")
    return rows.select(
        "part", "filter_order", "step",
        total(lambda mask: ~has(mask, before) & ~has(mask, bit)).alias("kept"), total(removed).alias("removed"),
        total(lambda mask: has(mask, bit) & has(mask, before)).alias("redundant"), total(lambda mask: mask == bit).alias("unique_fails"),
        total(removed, lambda m: m["good"]).alias("good_lost"), total(removed, lambda m: m["toxic"]).alias("toxic_lost"),
        total(lambda mask: has(mask, bit), share).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    kept: left after the step; removed: by it; redundant: fail its filter but were removed before; unique_fails: fail this filter alone;
    good_lost, toxic_lost: removed rows with quality 1, toxic 1; shapley: removed by the filter, summed over all orders.
    """
    return order_report(mask_counts(failure_masks(docs), labels))
