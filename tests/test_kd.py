"""Neighbours by trees of boxes against measuring all pairs."""

import math
import random

import numpy as np
import pytest

from punctaria.operators import kd, spatial


def plain(asked, targets, k):
    out = {}
    for p, *x in asked:
        if any(v is None or math.isnan(v) for v in x):
            continue
        near = sorted((sum((a - b) * (a - b) for a, b in zip(x, y, strict=True)), q) for q, *y in targets if q != p and not any(v is None or math.isnan(v) for v in y))
        out |= {(p, i): (q, round(math.sqrt(d2), 9)) for i, (d2, q) in enumerate(near[:k], 1)}
    return out


def rows_of(df):
    return {(r["pid"], r["rank"]): (r["nn_pid"], round(r["dist"], 9)) for r in df.collect()}


@pytest.mark.parametrize("d", [1, 2, 3])
def test_nearest_of_many_targets(d):
    rng = np.random.default_rng(d)
    targets = np.round(rng.normal(0, 1, (6000, d)), 2 if d < 3 else 1)  # many ties
    targets[:2000] = targets[0]
    queries = np.concatenate([targets[::37], rng.normal(0, 3, (50, d))])
    order = rng.permutation(6000)
    own = np.concatenate([order[::37], np.full(50, -1)])
    r2 = np.where(np.arange(len(queries)) % 3 == 0, 0.01, np.inf)
    got, expected = kd.nearest(targets, order, queries, own, 7, r2), kd._plain(targets, order, queries, own, 7, r2)
    for a, b in zip(got, expected, strict=True):
        assert np.array_equal(a, b)


def test_touching_blocks():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (5000, 2))
    x[:1500] = 1.0
    tree = kd.Tree(x[::3], 5)
    at = tree.block(x)
    assert len(np.unique(at)) > 16
    lo, hi = np.full((32, 2), np.inf), np.full((32, 2), -np.inf)
    for b in np.unique(at):
        lo[b], hi[b] = x[at == b].min(0), x[at == b].max(0)
    tree.bound(lo, hi)
    q, r2 = rng.normal(0, 2, (200, 2)), rng.uniform(0, 1, 200)
    gap = np.maximum(np.maximum(lo[None] - q[:, None], q[:, None] - hi[None]), 0)
    i, b = np.nonzero((gap * gap).sum(2) <= r2[:, None])
    row, block = tree.touching(q, r2)
    assert set(zip(row.tolist(), block.tolist(), strict=True)) == set(zip(i.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("columns", [("x", "y"), ("x", "y", "z")])
def test_neighbours_over_many_blocks(spark, monkeypatch, columns):
    monkeypatch.setattr(spatial, "BLOCK_TARGETS", 16)
    monkeypatch.setattr(spatial, "BLOCK_QUERIES", 40)
    rng = random.Random(len(columns))
    place = lambda spread: [round(rng.gauss(0, spread) * 8) / 8 for _ in columns]
    rows = [(i, *place(4)) for i in range(500)] + [(500 + i, *([1.0] * len(columns))) for i in range(200)] + [(800 + i, *place(0.2)) for i in range(100)]
    rows += [(900, None, *([0.0] * (len(columns) - 1))), (901, float("nan"), *([0.0] * (len(columns) - 1))), (902, *([1e6] * len(columns)))]
    points = spark.createDataFrame(rows, f"pid long, {', '.join(f'{c} double' for c in columns)}")
    assert rows_of(spatial.knn(points, 5, columns)) == plain(rows, rows, 5)
    asked = [(10_000 + i, *place(9)) for i in range(60)] + [(20_000 + i, *([1.0] * len(columns))) for i in range(100)] + rows[::40]
    asking = spark.createDataFrame(asked, points.schema)
    assert rows_of(spatial.knn(asking, 3, columns, targets=points)) == plain(asked, rows, 3)


def test_fewer_points_than_neighbours_and_none(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 5.0, 0.0)]
    points = spark.createDataFrame(rows, "pid long, x double, y double")
    assert rows_of(spatial.knn(points, 9)) == plain(rows, rows, 9)
    assert spatial.knn(points.limit(0), 2).count() == 0
    assert spatial.knn(points, 2, targets=points.limit(0)).count() == 0
