"""Exact top-k search."""
import math

import numpy as np
from pyspark.sql import functions as F

from vocalake.llm import topk


def brute(rows, is_query, k):
    usable = [
        (i, [math.floor(256 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = max((len(v) for _, v in usable), default=0)
    usable = [(i, v + [0] * (width - len(v))) for i, v in usable]
    queries = {i: v for i, v in usable if is_query(i)}
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)
        out += [(q, rank + 1, i, -score) for rank, (score, i) in enumerate(scored[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))


def test_against_brute_force_with_small_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (5, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(0, 0.2, 8)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)] + [(2000, [0.0] * 8), (2001, [])]
    rows += [(3000, None), (3001, [1.0, None]), (3002, [float("nan")] * 8), (3003, [float("inf")] * 8), (None, [1.0] * 8)]
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 7 == 0, k=4, pivots=6, block_rows=40, chunk_queries=9)
    assert got.columns == ["query_id", "rank", "id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 7 == 0, 4)


def test_few_and_no_candidates(spark):
    rows = [(0, [1.0, 2.0]), (7, [3.0, 4.0])]
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 7 == 0, k=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 7 == 0, 5)
    assert topk.top_k(table(spark, rows[:1]), F.col("vec_id") % 7 == 0).count() == 0
    assert topk.top_k(table(spark, []), F.col("vec_id") % 7 == 0).count() == 0


def test_query_ids_repeated_more_than_k_times(spark):
    rng = np.random.default_rng(3)
    near = [(i, [float(np.float32(x)) for x in 4 + rng.normal(0, 0.3, 4)]) for i in range(1, 40)]
    far = [(i, [float(np.float32(x)) for x in -4 + rng.normal(0, 0.3, 4)]) for i in range(51, 90)]
    for twins in ([(50, [4.0] * 4)] * 6, [(50, [4.0] * 4)] * 40, [(50, [40.0] * 4)] * 9):
        rows = near + far + twins
        got = topk.top_k(table(spark, rows), F.col("vec_id") == 50, k=5, pivots=4, block_rows=20)
        assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i == 50, 5)


def test_cells_that_hold_only_repeated_ids_are_visited(spark):
    rows = [(1, [9.0, 0.0]), (1, [0.0, 9.0]), (2, [9.0, 0.0]), (3, [9.0, 0.5]), (50, [0.0, 1.0])]
    got = topk.top_k(table(spark, rows), F.col("vec_id") == 50, k=1, pivots=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i == 50, 1)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 3) * 50_000]) for i in range(60)]
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 10 == 0, k=3, pivots=4, block_rows=20)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0, 3)


def test_queries_go_only_to_cells_that_can_matter():
    pivots = np.array([[100.0, 0], [-100.0, 0]])
    least, most = topk.reach(np.array([[10.0, 0]]), pivots, np.array([1.0, 1.0]), [np.array([0, 0.5, 1.0]), np.array([0.5])], 2)
    assert most[0, 0] >= least[0] > most[0, 1]


def test_chunks_hold_their_limit():
    plan = topk.chunk_plan({0: 3, 1: 4, 2: 25, 3: 2, 4: 9}, 10)
    assert plan[2][1] == 3 and plan[0][0] == plan[1][0]
    used = [set(range(first, first + parts)) for first, parts in plan.values()]
    assert not used[2] & (used[0] | used[1] | used[3] | used[4])
