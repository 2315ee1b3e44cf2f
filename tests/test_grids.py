"""Grids of settings in blocks of space give what they give over pairs."""

import numpy as np
import pandas as pd
import pytest

from punctaria.operators import grids, phase

CELLS = [(10 + i * 2 + j, s, t) for i, s in enumerate((0.7, 1.1)) for j, t in enumerate((3, 6))]


@pytest.mark.parametrize("noise_free", [False, True])
def test_blocks_and_pairs_give_the_same(spark, monkeypatch, noise_free):
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.uniform(0, 40, (1500, 2)), rng.normal(20, 2, (250, 2)), np.full((9, 2), 31.0), np.stack([np.arange(0, 40, 0.5), np.full(80, 15.0)], 1)]), 1)
    points = spark.createDataFrame(pd.DataFrame({"pid": rng.permutation(len(x)), "x": x[:, 0], "y": x[:, 1]})).unionByName(spark.createDataFrame([(10_000, None, 1.0), (10_001, float("nan"), 1.0)], "pid long, x double, y double"))
    monkeypatch.setattr(grids, "BLOCK", 150)
    found = phase.phase_assignment(points, CELLS, noise_free)
    blocks = [r["block"] for r in found._clusterings.wide.select("block").distinct().collect()]
    assert len(blocks) > 5
    plain = phase._assignment_by_pairs(points, CELLS, noise_free)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(found) == rows(plain)
    assert rows(phase.overlaps(found)) == rows(phase.overlaps(plain))
    assert rows(phase.similarity(found)[0]) == rows(phase.similarity(plain)[0])
    assert rows(phase.similarity_matrix(found)) == rows(phase.similarity_matrix(plain))
    table = phase.grid(spark, [0.7, 1.1], [3, 6])
    assert rows(phase.phase_space(table.withColumn("idx", table["idx"] + 10), found)) == rows(phase.phase_space(table.withColumn("idx", table["idx"] + 10), plain))
    monkeypatch.setattr(grids, "MOST_PAIRS", 10)
    assert grids.labels(points, CELLS, noise_free) is None


def test_no_pairs_are_joined(spark, monkeypatch):
    monkeypatch.setattr(phase, "eps_pairs", None)
    points = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(60)], "pid long, x double, y double")
    assert phase.phase_assignment(points, [(0, 1.5, 3)], True).filter("label >= 0").count() == 60


def test_search_makes_no_row_a_setting(spark, monkeypatch):
    monkeypatch.setattr(phase, "eps_pairs", None)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in (0, 10, 20)])
    points = spark.createDataFrame(pd.DataFrame({"pid": np.arange(120), "x": x[:, 0], "y": x[:, 1]}))
    search = phase.ParameterSearch(points_per_dimension=2, adaptive_sigma_boundaries=False, sigma_boundaries=(1.5, 2.0)).fit(points)
    assert [tuple(r) for r in search.phasespace.select("idx", "no_clusters", "similarityScore").orderBy("idx").collect()] == [(i, 3, 9) for i in range(4)]
