"""Interval algebra over any key: inclusive months, union, gaps, carry-forward.

Every operator takes a frame of (key, start, end) date intervals. Each is one exchange on the key; the
windows of one call share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def months_inclusive(start: Column, end: Column) -> Column:
    """Calendar months touched by [start, end]: 0 if reversed or unknown, else 1 at least."""
    n = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1
    return F.when(start.isNull() | end.isNull() | (end < start), 0).otherwise(F.greatest(n, F.lit(1))).cast("long")


def valid(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    return df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))


def islands(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end) of the merged intervals: those that overlap or follow within a day are one."""
    rows = valid(df, start, end)
    by = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col(start) <= F.date_add(reach, 1), 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_island")


def union_months(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, total_months): months of the union, overlaps counted once."""
    return islands(df, key, start, end).groupBy(key).agg(F.sum(months_inclusive(F.col("start"), F.col("end"))).alias("total_months"))


def gaps(df: DataFrame, key: str, start: str = "start", end: str = "end", order: tuple[str, ...] = (), least_months: int = 6, running: bool = False) -> DataFrame:
    """(key, gap_start, gap_end, gap_months) between neighbours by start.

    The gap is measured from the adjacent interval's end, so an interval nested in a longer one can yield
    a gap; ``running=True`` measures from the latest end so far. ``order`` breaks ties of equal starts.
    """
    by = Window.partitionBy(key).orderBy(start, end, *order)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)) if running else F.lag(end).over(by)
    rows = valid(df, start, end).withColumn("gap_start", before).where(F.col(start) > F.col("gap_start"))
    rows = rows.withColumn("gap_months", months_inclusive(F.col("gap_start"), F.col(start)) - 1)
    return rows.where(F.col("gap_months") >= least_months).select(key, "gap_start", F.col(start).alias("gap_end"), "gap_months")


def carry_forward(df: DataFrame, key: str, value: Column, order: list, default, name: str) -> DataFrame:
    """``df`` with the last non-null ``value`` up to each row (in ``order``), or ``default``."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(by), F.lit(default)))
