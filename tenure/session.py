"""Session helper for scripts, benches and tests; library code takes the caller's session."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, app: str = "tenure", memory: str = "8g") -> SparkSession:
    """A local session. The checkpoint folder is only set here, where no cluster names one."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no look at the Python stack for each column
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
