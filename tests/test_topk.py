"""Block top-k against all pairs, and the pairs that it looks at."""

import numpy as np
from pyspark.sql import functions as F

from tenure.operators import topk, vectors

SCHEMA = "id long, scope string, vector array<double>, extra string"


def both(spark, rows, k, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    top, looked = topk.block_top_k(df.withColumnRenamed("id", "query_id"), df, "scope", k, **options)
    plain = vectors.scoped_top_k(df.select(F.col("id").alias("query_id"), "scope", "vector"), df.where("vector is not null"), "scope", k, options.get("least"))
    good = plain.where("score is not null and query_id <> 1003").select("query_id", "id", "score", "rank").collect()
    return sorted(map(tuple, top.select("query_id", "id", "score", "rank").collect())), sorted(map(tuple, good)), looked.agg(F.sum(F.col("n_q") * F.col("n_b"))).first()[0]


def test_equal_to_all_pairs_and_far_fewer_looked_at(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((16, 32))
    rows = []
    for i in range(900):  # one hot scope of well separated groups, small scopes beside it
        v = centres[i % 16] * 4 + rng.standard_normal(32) * 0.05
        rows.append((i, "hot" if i % 3 else f"s{i % 30}", (v / np.linalg.norm(v)).tolist(), "x"))
    got, want, looked = both(spark, rows, 4, block=16)
    assert got == want and len(want) > 3000
    hot = sum(r[1] == "hot" for r in rows)
    assert looked < 0.5 * hot**2, (looked, hot**2)


def test_random_vectors_ties_nulls_and_floors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "a" if i % 4 else "b", rng.integers(-2, 3, 4).astype(float).tolist(), None) for i in range(300)]
    rows += [(1000, "a", None, None), (1001, None, [1.0] * 4, None), (1003, "a", [], None), (1004, "c", [0.0] * 4, None), (1005, "d", [1.0, 2.0], "x")]
    for options in ({}, {"least": 3.0}):
        got, want, _ = both(spark, rows, 7, block=32, **options)
        assert got == want
    assert topk.block_top_k(spark.createDataFrame([], SCHEMA).withColumnRenamed("id", "query_id"), spark.createDataFrame([], SCHEMA), "scope", 3)[0].count() == 0


def test_groups_copies_and_written_bytes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "a", rng.standard_normal(8).tolist(), None) for i in range(200)]
    rows += [(200 + i, "a", rows[i % 20][2], None) for i in range(400)]  # many copies: equal scores go by id
    got, want, _ = both(spark, rows, 5, block=16, asked_bytes=64 * 100, held_bytes=64 * 150)
    assert got == want
    # a task of 100 queries keeps k rows of each, however many copies score the same
    copies = np.ones((300, 4))
    at, ids, score, _ = topk._best(np.ones((100, 4)), [(np.arange(300)[::-1].copy(), copies), (np.arange(300, 600), copies)], np.array([4.0, 4.0]), 5)
    assert len(at) == 500 and ids.max() == 4 and set(score) == {40000}
