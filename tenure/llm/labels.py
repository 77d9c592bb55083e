"""Labelled samples for the classifiers: bounded, whole texts, held-out rows never in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documented bounds of training: longer labelled texts are left out of the sample, and it ends before so many bytes of text.
LONGEST_BYTES, TRAINING_BYTES = 1 << 18, 1 << 26
#: Fixed contract value: rows whose crc32(doc_id as text) is divisible by this are held out.
HELD_OUT = 5


def held_out(doc_id="doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents, those with the smallest hash of their id.

    Texts are whole; those of more than ``LONGEST_BYTES`` are left out. The ids come first, so the texts of all other documents stay where they are; the join's other side is
    bounded by ``rows``. Repeated labels of one id count once (the largest); null labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= LONGEST_BYTES)
    return texts.join(F.broadcast(some), "doc_id").select("doc_id", "text", "label")


def in_bound(batches: Iterator[pa.RecordBatch], most: int = TRAINING_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows before the sum of the texts' bytes passes ``most``."""
    used = 0
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index("text"))).to_numpy(zero_copy_only=False)) + used
        n = int(np.searchsorted(size, most, "right"))
        yield batch.slice(0, n)
        if n < batch.num_rows:
            return
        used = int(size[-1]) if n else used
