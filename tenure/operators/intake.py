"""Intake of source files: loading, acceptance, and the views of documents and skills that readers get."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted types and name ending, greatest size.
TYPES, ENDING, MOST_BYTES = ("application/pdf", "application/x-pdf"), ".pdf", 20 * 1024 * 1024


def load_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, modificationTime) of the files under ``path``; columns that aren't used aren't read. Spark lists no empty files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def intake(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with content_hash, refused with reason) of files (path, content, and content_type if known): type or name ending, not empty, not too large."""
    kind = F.col("content_type").isin(*TYPES) if "content_type" in files.columns else F.lit(False)
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    reason = F.when(~(F.coalesce(kind, F.lit(False)) | F.coalesce(F.lower("path").endswith(ENDING), F.lit(False))), "type").when(size == 0, "empty").when(size > MOST_BYTES, "size")
    rows = files.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason").withColumn("content_hash", F.sha2("content", 256)), rows.where("reason is not null")


def find(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; the filter reaches the scan."""
    return rows.where(F.col(key) == value)


def document_view(documents: DataFrame) -> DataFrame:
    """Documents as readers see them."""
    return documents.select(F.col("id").alias("resume_id"), "filename", F.col("status").cast("string").alias("status"), "page_count", "failed_stage", "failure_reason", "uploaded_at")


def skill_view(stored: DataFrame) -> DataFrame:
    """Stored skills as readers see them; no chunks are an empty list."""
    chunks = F.coalesce("chunks", F.array().cast("array<bigint>"))
    return stored.where("status <> 'USER_REMOVED'").select(F.col("row_id").alias("resume_skill_id"), F.col("skill").alias("canonical_name"), F.col("text").alias("detected_text"), "confidence", F.col("method").alias("detection_method"), F.col("status").alias("verification_status"), chunks.alias("source_chunk_ids"), "user_modified")
