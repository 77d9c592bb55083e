"""Token counts by separator scan (operator 1).

Flat token files hold little-endian 16-bit ids and nothing else; documents end with an end-of-document id.
There is no index: files are cut into blocks of ``block_bytes`` wherever that falls, each block is searched for the id
in one vectorised comparison, and a prefix scan over the blocks' summaries (separators, last separator) numbers
the documents and stitches those that span blocks. A summary is one row per block; the scan is a window
per file. Tokens behind a file's last separator are a document without an end.

``write_token_files`` makes such files from documents, one per task, in the shared folder.
Texts are encoded as ordinary text: ``<|endoftext|>`` in a text is no separator. Null and empty texts are documents of 0 tokens; an
empty table gives an empty result; extra columns are ignored. Ids that repeat are documents of their own. An empty file has no document.
Files are read by ranges through Arrow's file systems, on local, HDFS and object store paths.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenure.llm.common import materialize, shared_folder
from tenure.llm.packing import Encoder, vocabulary

#: End-of-document id of the vocabulary (a fixed value of the tokenizer).
END_OF_DOCUMENT = 50256
BLOCK_BYTES = 4 << 20


def _write(path: str, pattern: str, folder: str, end: int):
    """Rows (doc_id, text) -> a flat file per task attempt, and rows (doc_id, file, ordinal)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        file = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.bin"
        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        encoder, mark, out, n = Encoder(path, pattern), int(end).to_bytes(2, "little"), None, 0
        try:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    out = out or system.open_output_stream(f"{at}/{file}")
                    for raw in encoder.block([t or "" for t in part.column(1).to_pylist()]):
                        out.write(np.frombuffer(raw, np.uint32).astype("<u2").tobytes() + mark)
                    m = part.num_rows
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([file] * m), pa.array(np.arange(n, n + m))], names=["doc_id", "file", "ordinal"])
                    n += m
        finally:
            if out:
                out.close()

    return run


def write_token_files(docs: DataFrame, end: int = END_OF_DOCUMENT, vocab: str = "byte_bpe_50k.tiktoken") -> tuple[str, DataFrame]:
    """Write the texts' ids to flat files; (their folder, manifest). The manifest (doc_id, file, ordinal) says which
    document stands where, for those who want ids; the scan doesn't need it. A repeated task writes a file of
    its own, and the manifest names only the files of the attempts that counted."""
    import public_tokenizers

    folder = f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    manifest = rows.mapInArrow(_write(vocabulary(vocab), public_tokenizers.PATTERN, folder, end), "doc_id long, file string, ordinal long")
    return folder, materialize(manifest, "token-manifest")


def _scan(end: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(block_bytes, block * block_bytes), "<u2")
                found = np.flatnonzero(ids == end) + block * (block_bytes // 2)
                n = pa.array([len(found)], pa.int64())
                last = pa.array([int(found[-1]) if len(found) else None], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block], pa.int64()), n, last, pa.array([block * (block_bytes // 2) + len(ids)], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))],
                    names=["path", "block", "n", "last", "stop", "found"],
                )

    return run


def scan_token_files(spark: SparkSession, folder: str, end: int = END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, start, n_tokens, ended) of every document of the flat files in ``folder``."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0")  # names and sizes; no content
    last_block = F.floor((F.col("length") - 1) / block_bytes)
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("block")).repartition(F.col("path"), F.col("block"))
    each = blocks.mapInArrow(_scan(end, block_bytes), "path string, block long, n long, last long, stop long, found array<long>")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("open", F.coalesce(F.max("last").over(before) + 1, F.lit(0)))
    final = F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull()
    each = each.withColumn("tail", F.when(final & (F.coalesce(F.col("last") + 1, F.col("open")) < F.col("stop")), F.array("stop")).otherwise(F.array().cast("array<long>")))
    ends = each.select("path", "base", "open", "n", "found", F.posexplode(F.concat("found", "tail")).alias("k", "at"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.get("found", F.col("k") - 1) + 1)
    return ends.select("path", (F.col("base") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("at") - start).alias("n_tokens"), (F.col("k") < F.col("n")).alias("ended"))


def document_token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal, start) of every row of ``docs``, by way of flat token files."""
    folder, manifest = write_token_files(docs)
    if manifest.isEmpty():
        return manifest.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), "file", "ordinal", F.lit(0).cast("long").alias("start"))
    found = scan_token_files(docs.sparkSession, folder).withColumn("file", F.regexp_extract("path", r"[^/]+$", 0))
    return manifest.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
