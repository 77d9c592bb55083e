"""Written stages: what several steps read is planned and computed once, and a lost executor costs a re-read.

The folder is the one that ``spark.checkpoint.dir`` names, which the driver and all executors share. A staged table's size is known to the
planner, so small ones are broadcast by its own threshold and large ones aren't.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder. Only a local session, which is one machine, may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tenure.scratch", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.tenure.scratch", folder)
    return f"{folder.rstrip('/')}/tenure-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back with its schema."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
