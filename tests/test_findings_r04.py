"""What the finding of the fourth round was about."""

import numpy as np
import pandas as pd
import pytest

from punctaria.operators import blocks, clustering, spatial, turns


def spread(seed, n=240):
    rng = np.random.default_rng(seed)
    return np.round(np.concatenate([np.stack([rng.uniform(0, 12, n), rng.uniform(0, 29, n)], 1), rng.normal((6, 20), 0.7, (n // 6, 2)), np.full((14, 2), 5.0)]), 1)


def near_within(x, k, eps):
    out = {}
    for p in range(len(x)):
        gap = x - x[p]
        d2 = gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1]
        out[p] = [(int(q), float(np.sqrt(d2[q]))) for q in np.lexsort((np.arange(len(x)), d2)) if q != p and d2[q] <= eps * eps][:k]
    return out


def point_by_point(score, label, near, least, crowded):
    """{pid: cluster}, and who stopped being clustered."""
    order = sorted(np.flatnonzero(label == 1).tolist(), key=lambda p: (-score[p], p))
    holds, jumps = {p: r for r, p in enumerate(order)}, len(order) > crowded * len(label)
    for p in order:
        friends = []
        for q, d in near.get(p, []):
            if q not in holds:
                break
            friends.append((q, d))
        if len(friends) < least:
            del holds[p]
            continue
        if jumps:
            friends = friends[: turns.until_jump([d for _, d in friends], least)]
        group = [p, *(q for q, _ in friends)]
        best = min(holds[q] for q in group)
        holds.update((q, best) for q in group)
    first = {}
    for p, h in holds.items():
        first[h] = min(p, first.get(h, p))
    number = {h: n for n, h in enumerate(sorted(first, key=first.get))}
    return {p: number[holds[p]] if p in holds else -1 for p in range(len(label))}, set(order) - set(holds)


@pytest.mark.parametrize(("seed", "least", "crowded", "most"), [(1, 3, 0.95, 60), (2, 4, 0.5, 40), (3, 3, 0.5, 50_000)])
def test_turns_in_blocks_are_those_point_by_point(spark, monkeypatch, seed, least, crowded, most):
    monkeypatch.setattr(clustering, "CLUB_BLOCK", most)
    monkeypatch.setattr(blocks, "BLOCK", 30)
    monkeypatch.setattr(blocks, "WIDTH", 2)
    x = spread(seed)
    score = np.where(seed % 2, 1 / (1 + x[:, 0]), np.round(np.sin(x[:, 1]), 1))  # turns sweep across space or come from all sides, with ties
    label = (np.random.default_rng(seed).uniform(size=len(x)) < 0.93).astype(int)
    near = near_within(x, 9, 1.6)
    expected, demoted = point_by_point(score, label, near, least, crowded)
    assert len(set(expected.values())) > 3 and len(demoted) > 10
    points = spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(x)), "score": score, "label": label, "x": x[:, 0], "y": x[:, 1]}))
    within = clustering.club_within(points, 9, 1.6, least, crowded)
    assert {r["pid"]: r["cluster"] for r in within.collect()} == expected
    links = spatial.knn_within(points, 9, 1.6)
    for columns in (("x", "y"), ()):
        assert {r["pid"]: r["cluster"] for r in clustering.club(points, links, least=least, crowded=crowded, columns=columns).collect()} == expected


def test_points_without_a_place_or_a_label(spark, monkeypatch):
    rows = [(1, 0.9, 1, 0.0, 0.0), (2, 0.8, 1, 0.5, 0.0), (3, 0.7, 1, 1.0, 0.0), (4, 0.6, 1, None, 0.0), (5, 0.5, 1, float("nan"), 1.0), (6, None, None, 5.0, 5.0), (7, 0.1, 0, 9.0, 9.0)]
    points = spark.createDataFrame(rows, "pid int, score double, label int, x double, y double")
    got = lambda least: {r["pid"]: r["cluster"] for r in clustering.club_within(points, 3, 2.0, least).collect()}
    assert got(2) == {1: 0, 2: 0, 3: 0, 4: -1, 5: -1, 6: -1, 7: -1}
    assert got(0) == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: -1, 7: -1}
    assert got(3) == dict.fromkeys(range(1, 8), -1)
    crowded = got(2)
    monkeypatch.setattr(blocks, "MOST", 0)
    assert got(2) == crowded


def test_a_sweep_through_blocks_takes_few_rounds(spark, monkeypatch):
    rounds = []

    def named(df, name, put=clustering.written):
        rounds.append(name)
        return put(df, name)

    monkeypatch.setattr(clustering, "written", named)
    monkeypatch.setattr(clustering, "CLUB_BLOCK", 100)
    rng = np.random.default_rng(5)
    x = np.stack([rng.uniform(0, 12, 900), rng.uniform(0, 75, 900)], 1)  # about as dense as the driver's points for eps of 4
    points = spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(x)), "score": 1 / (1 + x[:, 0]), "label": 1, "x": x[:, 0], "y": x[:, 1]}))
    links = spatial.knn_within(points, 9, 1.6)
    got = {r["pid"]: r["cluster"] for r in clustering.club(points, links, crowded=2, columns=("x", "y")).collect()}
    assert got == point_by_point(1 / (1 + x[:, 0]), np.ones(len(x)), near_within(x, 9, 1.6), 3, 2)[0]
    assert rounds.count("club-round") < 8  # with turns that wait for those of other blocks far more
