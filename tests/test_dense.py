"""Clustering and peeling where points are crowded, in long chains, and in several groups at once."""

import numpy as np
import pandas as pd
import pytest

from punctaria.operators import clustering

from .test_clustering import plain_dbscan


def table(spark, x, **more):
    return spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(x)), **{c: x[:, i] for i, c in enumerate("xyz"[: x.shape[1]])}, **more}))


def labels_of(df, *by):
    return {tuple(r[c] for c in (*by, "pid")): r["label"] for r in df.collect()}


def arcs(rng, n, inner, outer, far):
    """Two crowds with a curved gap between them, so that boxes around them overlap."""
    angle, a, b = rng.uniform(0, 0.9, n), rng.uniform(inner - 1, inner, n), rng.uniform(outer, outer + 1, n)
    angle[:2], a[0], b[0] = 0.4, inner, outer if not far else outer + 0.5
    return np.concatenate([np.stack([r * np.cos(angle), r * np.sin(angle)], 1) for r in (a, b)])


@pytest.mark.parametrize("gap, clusters", [(4.002, 2), (3.999, 1)])
def test_crowds_that_are_just_apart(spark, monkeypatch, gap, clusters):
    monkeypatch.setattr(clustering, "PAIRS_A_POINT", 0)  # boxes get finer until nothing is open
    x = arcs(np.random.default_rng(2), 300, 2.0, 2.0 + gap, far=False)
    got = labels_of(clustering.dbscan(table(spark, x), 4.0, 5))
    plain = plain_dbscan(x, 4.0, 5)
    assert len(set(got.values())) == clusters
    assert got == {(p,): label for p, label in enumerate(plain)}


def test_crowds_of_many_points_take_no_pairs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(0, 1, (60_000, 2)), rng.uniform(0, 1, (60_000, 2)) + [5.001, 0]])
    sizes = clustering.dbscan(table(spark, x), 4.0, 20).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in sizes} == {0: 60_000, 1: 60_000}


def test_groups_are_clustered_apart(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.uniform(0, 30, (400, 2)), 1)
    kind = np.array(["a", "b", "c", "d"])[rng.integers(0, 4, 400)]
    points = table(spark, x, kind=kind)
    twice = points.unionByName(points.selectExpr("pid", "x", "y", "'again' AS kind"))  # the same ids in another group
    got = labels_of(clustering.dbscan(twice, 2.0, 4, by=("kind",)), "kind")
    want = {}
    for k in "abcd":
        own = np.flatnonzero(kind == k)
        want |= {(k, p): v for p, v in zip(own.tolist(), plain_dbscan(x[own], 2.0, 4), strict=True)}
    want |= {("again", p): v for p, v in enumerate(plain_dbscan(x, 2.0, 4))}
    assert got == want


def plain_peel(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    alive = np.ones(len(x), bool)
    while (drop := alive & ((near & alive).sum(1) < least)).any():
        alive &= ~drop
    return set(np.flatnonzero(alive).tolist())


@pytest.mark.parametrize("block", [clustering.PEEL_BLOCK, 20])
def test_peeling_against_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(clustering, "PEEL_BLOCK", block)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.round(rng.uniform(0, 25, (300, 2)), 1), np.stack([np.arange(60) + 40.0, np.zeros(60)], 1), np.full((10, 2), 3.0)])
    left = {r["pid"] for r in clustering.peeled(table(spark, x), 1.5, 4).collect()}
    assert left == plain_peel(x, 1.5, 4) and 0 < len(left) < len(x)


def test_a_long_line_peels_from_its_ends(spark):
    x = np.stack([np.arange(10_000.0), np.zeros(10_000)], 1)
    assert clustering.peeled(table(spark, x), 1.0, 3).count() == 0
    ring = np.concatenate([x, [[-0.5, 0.5], [-0.5, -0.5]]])  # something that holds at one end holds the other points near it
    assert {r["label"] for r in clustering.dbscan_loop(table(spark, ring), 1.0, 3).select("label").distinct().collect()} == {-1, 0}


@pytest.mark.parametrize("block", [clustering.PEEL_BLOCK, 25])
def test_core_of_cores_against_following_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(clustering, "PEEL_BLOCK", block)
    rng = np.random.default_rng(6)
    x = np.round(np.concatenate([rng.normal(c, 1, (40, 2)) for c in (0, 9)] + [rng.uniform(-4, 14, (40, 2))]) * 8) / 8
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    near = [[q for q in np.lexsort((np.arange(len(x)), d2[p])) if q != p][:3] for p in range(len(x))]
    core = {p for p in range(len(x)) if d2[p, near[p][-1]] < 1.5**2}
    closed = set()
    for p in core:
        seen, todo = set(), [p]
        while todo:
            q = todo.pop()
            if q not in seen:
                seen.add(q)
                todo += near[q] if q in core else []
        if seen <= core:
            closed.add(p)
    got = clustering.core_of_cores(table(spark, x), 1.5, 4).collect()
    assert {r["pid"] for r in got if r["is_core"]} == core and {r["pid"] for r in got if r["closed"]} == closed
    assert len(got) == len(x) and 0 < len(closed) < len(core)
