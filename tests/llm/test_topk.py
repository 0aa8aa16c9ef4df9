import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import contracts, topk


def brute(rows, k=5, step=50):
    v = {i: np.floor(256 * np.array(x, np.float64)).astype(np.int64) for i, x in rows}
    out = set()
    for q in v:
        if q % step == 0:
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:k]
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(best, 1)}
    return out


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {tuple(r) for r in contracts.op10_topk(spark, sf).select("query_id", "rank", "vec_id", "score").collect()} == brute(rows)


@pytest.mark.parametrize("pivots", [1, 7])
def test_ties_and_one_crowded_pivot(spark, pivots):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)] + [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(300, 700)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 50 == 0, pivots=pivots).collect()} == brute(rows)


def test_small_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL", 7)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 50 == 0, pivots=4).collect()} == brute(rows)


def test_bounds_spare_most_of_clustered_vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = []
    for i in range(4000):
        x = centres[i % 20] + rng.normal(size=16) * 0.01
        rows.append((i, [float(v) for v in x / np.linalg.norm(x)]))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    parts = topk.top_k_parts(table, F.col("vec_id") % 50 == 0, pivots=40)
    assert topk.scored_share(parts, 4000, 80) < 0.2
    assert {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 50 == 0, pivots=40).collect()} == brute(rows)


def test_large_values_stay_exact(spark):
    rows = [(i, [2.0**21 + i, -(2.0**20), 3.0]) for i in range(0, 120, 10)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 50 == 0).collect()} == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [math.nan, 1.0]), (3, [math.inf, 1.0]), (4, [1.0, None]), (None, [1.0, 1.0]), (50, [0.5, 0.5]), (5, [3.0]), (0, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, v string, far string")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, F.col("vec_id") % 50 == 0).collect()}
    assert (0, 1, 5, 256 * 768) in got and (0, 2, 50, 128 * 256 + 128 * 512) in got and len([x for x in got if x[0] == 0]) == 2
    assert topk.top_k(table.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(table.where("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0
