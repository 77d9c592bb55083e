"""Exact inner-product top-k within scopes without looking at all pairs.

Vectors stand in blocks of at most ``BLOCK`` rows: the signs towards fixed random planes deal a scope's vectors into cells, as many bits as its size asks for, and
a cell with more rows is dealt into salted parts of about ``TOGETHER`` blocks, so a hot scope is many tasks. A part is clustered around rows that lie
far apart, and each cluster is a block or several. Of two blocks with centres c, d and radii r, s no inner
product exceeds c.d + |c| s + |d| r + r s. Blocks are dealt into groups of bounded size, and each group of queries meets each group of rows of its scope in
one task, so a block is copied once for each group of the other side, not once for each block. In a task a block of queries looks at the blocks in the order of
their bounds and stops where none can reach the k-th scores it has; two blocks are one matrix product. A task keeps k rows a query, which Spark ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.operators.vectors import dot
from tenure.stages import stage

BLOCK, TOGETHER, PLANES = 512, 32, 24
#: Bytes of the vectors of a group of queries and of a group of rows.
ASKED, HELD = 1 << 24, 1 << 26
#: Scores are ranked as decimals of four places: blocks within this of the floor are looked at.
SLACK = 2e-4


def clusters(m: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Row numbers of clusters of at most ``size`` rows of ``m``: rows that lie far apart are the first centres, then two rounds of means."""
    k = min(len(m), -(-2 * len(m) // size)) if len(m) > size else 1
    away = lambda c: ((m - c) ** 2).sum(axis=1)
    centres, near = [m[away(m.mean(axis=0)).argmin()]], None
    for _ in range(k - 1):
        last = away(centres[-1])
        near = last if near is None else np.minimum(near, last)
        centres.append(m[near.argmax()])
    c = np.stack(centres)
    for turn in range(3):
        of = ((c**2).sum(axis=1) - 2 * m @ c.T).argmin(axis=1)
        if turn < 2:
            c = np.stack([m[of == j].mean(axis=0) if (of == j).any() else c[j] for j in range(k)])
    for j in range(k):
        rows = np.flatnonzero(of == j)
        yield from (rows[a : a + size] for a in range(0, len(rows), size))


def _blocks(rows: DataFrame, name: str, block: int) -> DataFrame:
    """Rows (id, scope, vector) as written blocks (block, scope, dim, n, centre, length, radius, ids, matrix)."""
    kind = rows.schema["scope"].dataType.simpleString()
    rows = rows.where("vector is not null and scope is not null and size(vector) > 0").select("id", "scope", F.col("vector").cast("array<double>").alias("vector"))

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
            bits, start = np.zeros(len(sizes), np.int64), np.cumsum(sizes) - sizes
            for d in np.unique(sizes):
                planes = np.random.Generator(np.random.PCG64(int(d))).standard_normal((int(d), PLANES))
                at = np.flatnonzero(sizes == d)
                bits[at] = (flat[start[at][:, None] + np.arange(d)] @ planes > 0) @ (1 << np.arange(PLANES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits), pa.array(sizes.astype(np.int32))], ["id", "scope", "vector", "bits", "dim"])

    rows = stage(rows.mapInArrow(signs, f"id long, scope {kind}, vector array<double>, bits long, dim int"), f"{name}-signs")
    depth = F.least(F.lit(PLANES), F.floor(F.log2(F.greatest(F.lit(1.0), F.count("*") / (block * TOGETHER))))).cast("int")
    rows = rows.join(rows.groupBy("scope", "dim").agg(depth.alias("depth")), ["scope", "dim"])
    rows = rows.withColumn("cell", F.col("bits") % F.pow(F.lit(2), F.col("depth")).cast("long"))
    sizes = rows.groupBy("scope", "dim", "cell").agg(F.ceil(F.count("*") / (block * TOGETHER)).cast("int").alias("k"))
    rows = rows.join(sizes, ["scope", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("k")))

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id")
        whole, ids, out = np.stack(df["vector"].to_numpy()), df["id"].to_numpy(), []
        for of in clusters(whole, block):
            m = whole[of]
            centre = m.mean(axis=0)
            radius = float(np.sqrt(((m - centre) ** 2).sum(axis=1)).max()) * (1 + 1e-9) + 1e-12
            out.append({"scope": df["scope"].iloc[0], "dim": m.shape[1], "n": len(m), "centre": centre, "radius": radius, "ids": ids[of], "matrix": m.tobytes()})
        return pd.DataFrame(out)

    packed = rows.groupBy("scope", "dim", "cell", "part").applyInPandas(pack, f"scope {kind}, dim int, n long, centre array<double>, radius double, ids array<long>, matrix binary")
    packed = packed.withColumn("block", F.monotonically_increasing_id()).withColumn("length", F.sqrt(dot(F.col("centre"), F.col("centre"))))
    return stage(packed, name)


def ten_thousandths(s: np.ndarray) -> np.ndarray:
    """Scores in units of the fourth decimal place: rounded to eight places, then to four, halves away from zero."""
    eight = np.floor(np.abs(s) * 1e8 + 0.5).astype(np.int64)
    return np.where(s < 0, -1, 1) * ((eight + 5000) // 10000)


def _best(one: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``one``, id, score in ten-thousandths) of the k best of ``blocks`` (ids, matrix), equal scores by id, and the numbers of the blocks that were looked at."""
    at, ids, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    floor = np.full(len(one), -np.inf)  # least raw score that may yet be among the k best
    kth, last_id = np.full(len(one), np.iinfo(np.int64).min), np.full(len(one), np.iinfo(np.int64).max)
    seen = []
    for j in np.argsort(-bounds, kind="stable"):
        if bounds[j] < floor.min() - SLACK:
            break
        seen.append(j)
        s = one @ blocks[j][1].T
        least = floor
        if np.isneginf(floor).any() and s.shape[1] > k:
            least = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - SLACK)
        a, b = np.nonzero(s >= least[:, None])
        given, new = blocks[j][0][b], ten_thousandths(s[a, b])
        better = (new > kth[a]) | ((new == kth[a]) & (given < last_id[a]))
        if not better.any():
            continue
        at, ids, score = np.concatenate([at, a[better]]), np.concatenate([ids, given[better]]), np.concatenate([score, new[better]])
        order = np.lexsort((ids, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        first = np.searchsorted(at, np.arange(len(one)))
        kept = np.arange(len(at)) - first[at] < k
        at, ids, score = at[kept], ids[kept], score[kept]
        full = np.bincount(at, minlength=len(one)) == k
        last = np.searchsorted(at, np.arange(len(one)), side="right") - 1
        kth[full], last_id[full] = score[last[full]], ids[last[full]]
        floor[full] = (kth[full] - 0.5) * 1e-4 - 1e-7
    return at, ids, score, np.array(seen, np.int64)


def block_top_k(queries: DataFrame, rows: DataFrame, scope: str, k: int, least: float | None = None, block: int = BLOCK, asked_bytes: int = ASKED, held_bytes: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(the rows of ``vectors.scoped_top_k``, the pairs of blocks that were looked at with their numbers of rows).

    ``queries`` (query_id, scope, vector), ``rows`` (id, scope, vector); ids are longs, each once. Rows without a vector or a scope never meet; vectors of different lengths neither, nor empty ones.
    """
    asked = _blocks(queries.select(F.col("query_id").cast("long").alias("id"), F.col(scope).alias("scope"), "vector"), "query-blocks", block)
    held = _blocks(rows.select(F.col("id").cast("long").alias("id"), F.col(scope).alias("scope"), "vector"), "vector-blocks", block)
    by_scope = ["scope", "dim"]
    groups = lambda df, most, name: df.groupBy(*by_scope).agg(F.ceil(F.sum("n") * F.first("dim") * 8 / most).cast("int").alias(name))
    counts = groups(asked, asked_bytes, "n_g").join(groups(held, held_bytes, "n_h"), by_scope)
    deal = lambda n: F.pmod(F.xxhash64("block"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["block", "centre", "length", "radius", "ids", "matrix"]
    asked = asked.join(counts, by_scope).select(*by_scope, deal("n_g").alias("g"), every("n_h").alias("h"), *columns)
    held = held.join(counts, by_scope).select(*by_scope, every("n_g").alias("g"), deal("n_h").alias("h"), *columns)

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(b):
            d, n = int(q["dim"].iloc[0]), b["ids"].map(len).to_numpy()
            blocks = [(np.asarray(ids, np.int64), np.frombuffer(m).reshape(-1, d)) for ids, m in zip(b["ids"], b["matrix"], strict=True)]
            centres, lengths, radii = np.stack(b["centre"].to_numpy()), b["length"].to_numpy(), b["radius"].to_numpy()
            for r in q.itertuples(index=False):
                bounds = centres @ r.centre + r.length * radii + lengths * r.radius + r.radius * radii
                bounds += 1e-9 * np.abs(bounds)
                at, ids, score, seen = _best(np.frombuffer(r.matrix).reshape(-1, d), blocks, bounds, k)
                out.append(pd.DataFrame({"query_id": np.asarray(r.ids, np.int64)[at], "id": ids, "score": score / 10000}))
                out.append(pd.DataFrame({"q": r.block, "b": b["block"].to_numpy()[seen], "n_q": len(r.ids), "n_b": n[seen]}))
        columns = ["query_id", "id", "score", "q", "b", "n_q", "n_b"]
        return pd.concat(out).reindex(columns=columns).astype({c: "Int64" for c in columns if c != "score"}) if out else pd.DataFrame(columns=columns)

    keys = [*by_scope, "g", "h"]
    met = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(meet, "query_id long, id long, score double, q long, b long, n_q long, n_b long")
    met = stage(met, "block-scores")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    top = met.where("query_id is not null").select("query_id", "id", "score").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    looked = met.where("q is not null").select("q", "b", "n_q", "n_b")
    return (top if least is None else top.where(F.col("score") >= least)), looked
