"""Sources: the given tables, and the career documents that Spark derives from them.

Role intervals: a customer is a document, an order is a role. It starts in the month of the order date and
lasts (order key modulo ``spread``) further months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role_intervals(spark: SparkSession, sf_dir: str, spread: int = 36) -> DataFrame:
    """(resume_id, role_id, start, end) of every order."""
    start = F.trunc(F.col("o_orderdate").cast("date"), "month")
    end = F.last_day(F.add_months(start, (F.col("o_orderkey") % spread).cast("int")))
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("resume_id"), F.col("o_orderkey").alias("role_id"), start.alias("start"), end.alias("end"))


#: The same intervals for DuckDB, as a common table expression named roles; {spread} as above.
ROLES_SQL = """roles AS (
  SELECT o_custkey AS resume_id, o_orderkey AS role_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS start_date,
    last_day(CAST(date_trunc('month', o_orderdate) AS DATE) + to_months(CAST(o_orderkey % {spread} AS INTEGER))) AS end_date
  FROM orders)"""
