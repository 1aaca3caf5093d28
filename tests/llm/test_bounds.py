"""Operator 2's bounds hold every score, its scan leaves out none of the best, and ties go to the smaller id."""

import numpy as np
import pytest

from tidegauge.llm import topk


@pytest.mark.parametrize("levels", [3, 64, 65, 100, 127, 128, 129, 200, 1000])
def test_bounds_hold_every_score(levels):
    queries, vectors = np.array([[1000], [-7]]), np.arange(levels)[:, None]
    low, high = topk.scan(queries, *topk.quantised(vectors))
    exact = queries @ vectors.T
    assert (low <= exact).all() and (exact <= high).all()


@pytest.mark.parametrize("size", [127, 10**4, 10**12, 2**62])
def test_bounds_of_wide_and_large_components(size):
    draw = np.random.default_rng(size)
    queries, vectors = draw.integers(-size, size, (40, 3)), draw.integers(-size, size, (500, 3))
    low, high = topk.scan(queries, *topk.quantised(vectors))
    exact = np.clip(np.array(queries.tolist(), object) @ np.array(vectors.tolist(), object).T, -(2**63), 2**63 - 1).astype(np.float64)
    assert (low <= exact).all() and (exact <= high).all()


def test_no_winner_is_left_out_on_a_dense_grid():
    grid = np.stack(np.meshgrid(np.arange(1270, step=10), np.arange(1270, step=10)), -1).reshape(-1, 2)
    grid = np.random.default_rng(1).permutation(grid)
    ids = np.random.default_rng(3).permutation(len(grid))
    queries = np.random.default_rng(2).integers(-1000, 1000, (60, 2))
    for q, low, high in zip(queries, *topk.scan(queries, *topk.quantised(grid)), strict=True):
        winners = np.lexsort((ids, -(grid @ q)))[:5]
        assert set(winners) <= set(topk.unbeaten(low, high, ids, 5))


@pytest.mark.parametrize("spread", [1, 3000])
def test_dense_grid_with_ties(spark, spread, monkeypatch):
    """Scores tie by the hundred, and the query of zeros ties with all; small blocks make many meetings."""
    from pyspark.sql import functions as F

    for name, size in (("BLOCK", 256), ("STRIPE", 2), ("QUERIES", 8)):
        monkeypatch.setattr(topk, name, size)
    points = [(i, [float(spread * (i % 40)), float(spread * (i // 40 % 40))]) for i in range(2000)] + [(2000, [0.0, 0.0])]
    frame = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(frame, F.col("vec_id") % 100 == 0, k=7, factor=1).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    grid = np.array([v for _, v in points], np.int64)
    for q in range(0, 2001, 100):
        scores = grid @ grid[q]
        order = [i for i in np.lexsort((np.arange(len(grid)), -scores)).tolist() if i != q][:7]
        assert sorted(got[q]) == [(n + 1, i, int(scores[i])) for n, i in enumerate(order)]


def test_large_components_and_edges(spark):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.integers(-(10**9), 10**9, 3)]) for i in range(60)] + [(60, None), (61, [1.0, None, 2.0]), (62, [1.0, float("nan"), 0.0]), (63, []), (0, None), (70, [1.0, 2.0]), (71, [1e300, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "x") for r in [*rows, rows[5]]], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, k=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    held = {i: [max(-(2**63), min(2**63 - 1, int(np.floor(64 * x)))) for x in v] for i, v in rows if v and None not in v and np.isfinite(v).all()}
    cut = lambda x: max(-(2**63), min(2**63 - 1, x))
    for q in (0, 20, 40):
        scores = sorted((-cut(sum(a * b for a, b in zip(held[q], v, strict=True))), i) for i, v in held.items() if i != q and len(v) == 3)
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:4])]
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
