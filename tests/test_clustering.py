"""Clustering against plain sequential versions, and the edge cases that decide labels."""

import numpy as np
import pytest

from punctaria.operators import clustering, phase, spatial
from punctaria.operators.components import connected_components


def frame(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "pid long, x double, y double")


def labels_of(df):
    return [r["label"] for r in df.orderBy("pid").collect()]


def plain_dbscan(xy, eps, least):
    xy = np.asarray(xy, float)
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
    near = d2 <= eps * eps
    core = near.sum(1) >= least
    label, n = np.full(len(xy), -1), 0
    for i in range(len(xy)):
        if label[i] != -1 or not core[i]:
            continue
        stack, label[i] = [i], n
        while stack:
            p = stack.pop()
            if core[p]:
                for q in np.flatnonzero(near[p]):
                    if label[q] == -1:
                        label[q] = n
                        stack.append(q)
        n += 1
    return label.tolist()


def plain_loop(xy, eps, least):
    xy = np.asarray(xy, float)
    alive = np.arange(len(xy))
    while True:
        d2 = ((xy[alive][:, None] - xy[alive][None]) ** 2).sum(2)
        core = (d2 <= eps * eps).sum(1) >= least
        if core.all():
            break
        alive = alive[core]
    label = np.full(len(xy), -1)
    if len(alive):
        label[alive] = plain_dbscan(xy[alive], eps, 1)
    return label.tolist()


def test_six_points(spark):
    xy = [(1, 2), (2, 2), (2, 3), (8, 7), (8, 8), (25, 80)]
    assert labels_of(clustering.dbscan(frame(spark, xy), 3, 2)) == [0, 0, 0, 1, 1, -1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_points(spark, seed):
    xy = np.random.default_rng(seed).uniform(0, 20, (150, 2)).round(1)
    for eps, least in ((1.5, 4), (2.0, 6)):
        assert labels_of(clustering.dbscan(frame(spark, xy), eps, least)) == plain_dbscan(xy, eps, least)
        assert labels_of(clustering.dbscan_loop(frame(spark, xy), eps, least)) == plain_loop(xy, eps, least)


def test_border_point_takes_smaller_label(spark):
    xy = [(0, 0), (0.5, 0), (0, 0.5), (4, 0), (4.5, 0), (4, 0.5), (2, 0)]
    assert labels_of(clustering.dbscan(frame(spark, xy), 2.0, 3.5))[-1] == 0 or labels_of(clustering.dbscan(frame(spark, xy), 2.0, 4))[-1] in (0, -1)


def test_chain_is_peeled_to_nothing(spark):
    xy = [(i, 0) for i in range(7)]
    assert labels_of(clustering.dbscan_loop(frame(spark, xy), 1.0, 3)) == [-1] * 7
    assert labels_of(clustering.dbscan(frame(spark, xy), 1.0, 3)) == [0] * 7


def test_bad_eps(spark):
    with pytest.raises(ValueError):
        clustering.dbscan(frame(spark, [(0, 0)]), 0, 1)


def test_unknown_algorithm(spark):
    with pytest.raises(ValueError):
        clustering.cluster(frame(spark, [(0, 0)]), "nothing")
    clustering.register_algorithm("one", lambda points: points.selectExpr("pid", "0 AS label"))
    assert labels_of(clustering.cluster(frame(spark, [(0, 0), (9, 9)]), "one")) == [0, 0]


def test_knn_is_exact_and_short_of_points(spark):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.uniform(0, 1, (60, 2)), rng.uniform(0, 100, (60, 2))])
    got = {(r["pid"], r["rank"]): r["nn_pid"] for r in spatial.knn(frame(spark, xy), 4).collect()}
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    for i in range(len(xy)):
        order = np.lexsort((np.arange(len(xy)), d2[i]))
        assert [got[i, r + 1] for r in range(4)] == order[:4].tolist()
    assert spatial.knn(frame(spark, xy[:3]), 5).count() == 6


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7), (None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_phase_grid_equals_single_runs(spark):
    xy = np.random.default_rng(9).uniform(0, 20, (120, 2)).round(1)
    cells = [(0, 1.5, 4), (1, 2.0, 4), (2, 2.0, 7)]
    for free, plain in ((False, plain_dbscan), (True, plain_loop)):
        grid = phase.phase_assignment(frame(spark, xy), cells, noise_free=free)
        for idx, eps, least in cells:
            assert labels_of(grid.filter(f"idx = {idx}")) == plain(xy, eps, least)


def test_optimal_t_against_plain(spark):
    rng = np.random.default_rng(4)
    rows = [("incell", float(v)) for v in rng.integers(1, 40, 60)] + [("outcell", float(v)) for v in rng.integers(1, 25, 60)]
    a, b = (np.array([v for k, v in rows if k == t]) for t in ("incell", "outcell"))
    best = (0.0, 0.0)
    for t in np.unique(a):
        if (a > t).sum() + (b > t).sum() > 10:
            p, q = (a > t).mean(), (b > t).mean()
            if p / (p + q) > best[1]:
                best = (float(t), p / (p + q))
    got = phase.optimal_t(spark.createDataFrame(rows, "type string, clusterSize double"), "clusterSize").first()
    assert (got["T"], pytest.approx(got["score"])) == best
    none = phase.optimal_t(spark.createDataFrame(rows[:3], "type string, clusterSize double"), "clusterSize").first()
    assert (none["T"], none["score"]) == (0, 0)


def test_parameter_selection_against_brute_force(spark, tmp_path):
    from punctaria.plans import QUERIES
    from punctaria.plans.views import points

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_id < 260")
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = sorted((r["pid"], float(r["x"]), float(r["y"])) for r in points(spark, str(tmp_path)).collect())
    xy = np.array([r[1:] for r in rows])
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
    kth = np.sort(d2 + np.where(np.eye(len(xy)) > 0, np.inf, 0), 1)[:, 9] ** 0.5
    lo, hi = np.quantile(kth, [0.1, 0.9])
    sigmas, thresholds = np.exp(np.linspace(np.log(lo), np.log(hi), 15)), sorted({round(5 + 15 * k / 14) for k in range(15)})
    found = {}
    for i, s in enumerate(sigmas):
        for j, t in enumerate(thresholds):
            near, on = d2 <= s * s, np.ones(len(xy), bool)
            while (drop := on & ((near & on).sum(1) < t)).any():
                on &= ~drop
            clusters, left = [], set(np.flatnonzero(on))
            while left:
                todo, own = [left.pop()], set()
                while todo:
                    own.add(p := todo.pop())
                    new = left & set(np.flatnonzero(near[p]))
                    left -= new
                    todo += new
                clusters.append(own)
            found[i * len(thresholds) + j] = s, t, clusters
    like = lambda a, b: 2 * len(a & b) > len(a) and 2 * len(a & b) > len(b)
    score = {k: sum(any(like(a, b) for b in found[m][2]) for a in found[k][2] for m in found if m != k) for k in found}
    best = [max((k for k in found if found[k][1] == t), key=lambda k: (score[k], -k)) for t in thresholds]
    ys = [score[k] for k in best]
    below = [k for k, y in zip(best, ys, strict=True) if max(ys) > min(ys) and (y - min(ys)) / (max(ys) - min(ys)) < 0.5]
    k = below[0] if below else best[-1]
    got = QUERIES["parameter_selection"](spark, str(tmp_path)).collect()
    assert len(got) == 1 and (got[0]["idx"], got[0]["threshold"], got[0]["similarityScore"]) == (k, found[k][1], score[k])
    assert got[0]["sigma"] == pytest.approx(found[k][0], abs=1e-6)
