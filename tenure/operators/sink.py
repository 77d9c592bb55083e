"""Result tables with a commit, and an index that is brought up to date by version.

Tables are written to folders of their own first. One commit record, written last and renamed into place, names the folders of all tables and versions that
hold from then on. Readers follow the latest record, so they see all tables of a commit or none; a run that dies before its record leaves the former one
in force. Of two writers one gets the next number, the other's write fails and leaves the tables as they are.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.operators.narrative import INDEX_VERSIONS, VERSIONS, stamped

RECORDS = "_commits"


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def commit_number(spark: SparkSession, path: str) -> int:
    """Number of the latest commit under ``path``; 0 without any."""
    files, folder = _files(spark, f"{path.rstrip('/')}/{RECORDS}")
    if not files.exists(folder):
        return 0
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit()), default=0)


def committed(spark: SparkSession, path: str, number: int | None = None) -> dict[str, dict[str, str]]:
    """Folders by table and version of a commit, the latest by default."""
    number = commit_number(spark, path) if number is None else number
    if not number:
        return {}
    return json.loads(spark.read.text(f"{path.rstrip('/')}/{RECORDS}/{number:012d}.json", wholetext=True).first()["value"])


def _commit(spark: SparkSession, path: str, number: int, tables: dict) -> None:
    base = f"{path.rstrip('/')}/{RECORDS}"
    files, draft = _files(spark, f"{base}/_draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
    out.close()
    _, final = _files(spark, f"{base}/{number:012d}.json")
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise RuntimeError(f"commit {number} under {path} was written by another run")


def write_results(path: str, version: str = "scoring_version", **tables: DataFrame) -> int:
    """Write each table under ``path`` and commit all of them; the number of the commit. A table without a column ``version`` gets the present one. The versions that a
    table holds replace what was there; other versions and tables stay."""
    spark = next(iter(tables.values())).sparkSession
    before = commit_number(spark, path)
    state = committed(spark, path, before)
    for name, df in tables.items():
        df = df if version in df.columns else df.withColumn(version, F.lit(VERSIONS[version]))
        folder = f"data/{name}-{uuid.uuid4().hex}"
        at = f"{path.rstrip('/')}/{folder}"
        df.withColumn("_v", F.col(version)).write.partitionBy("_v").parquet(at)
        written = [r["v"] for r in spark.read.parquet(at).select(F.col(version).alias("v")).distinct().collect()]  # versions, a handful
        state[name] = {**state.get(name, {}), **{v: folder for v in written}}
    _commit(spark, path, before + 1, state)
    return before + 1


def read_results(spark: SparkSession, path: str, name: str, version: str = "scoring_version", number: int | None = None) -> DataFrame:
    """A table of the latest commit, or of an earlier one; versions that the commit doesn't name are not read."""
    folders = committed(spark, path, number).get(name)
    if not folders:
        raise AnalysisException(f"no committed table {name} under {path}")
    by_folder: dict[str, list[str]] = {}
    for v, folder in folders.items():
        by_folder.setdefault(folder, []).append(v)
    parts = [spark.read.option("basePath", f"{path.rstrip('/')}/{folder}").parquet(f"{path.rstrip('/')}/{folder}").where(F.col("_v").isin(vs)).drop("_v") for folder, vs in by_folder.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_index(df: DataFrame, path: str, versions: dict[str, str] = VERSIONS) -> None:
    """Add rows with the present stamps to an index that has a folder for each of the gating versions."""
    stamped(df, versions).write.partitionBy(*INDEX_VERSIONS).mode("append").parquet(path)


def reindex(spark: SparkSession, path: str, embed, versions: dict[str, str] = VERSIONS) -> tuple[DataFrame, DataFrame]:
    """(the index with all rows at the present versions, the rows that were embedded anew).

    ``embed`` maps rows without stamps to rows of the same columns. The gating versions are folders, so the scan of stale rows leaves out the fresh ones,
    and fresh rows go on as they are.
    """
    index = spark.read.parquet(path)
    fresh = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(versions[k])) for k in INDEX_VERSIONS])
    anew = stamped(embed(index.where(~fresh).drop(*versions)), versions).select(*index.columns)
    return index.where(fresh).unionByName(anew), anew
