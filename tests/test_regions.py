"""Neighbour windows, cluster forming and shaping, searches, generators, exports against plain versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctaria.functions import scalar
from punctaria.operators import clustering, evaluate, features, filters, generate, phase, spatial, stats
from punctaria.operators.ranks import hashed_rank, ranked
from punctaria.sources import points as src

from .test_clustering import frame, labels_of, plain_dbscan


def points_of(spark, rows):
    return spark.createDataFrame([(int(i), float(x), float(y)) for i, x, y in rows], "pid long, x double, y double")


def plain_knn(rows, targets, k):
    out = {}
    for i, x, y in rows:
        best = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in targets if j != i)[:k]
        out |= {(i, r + 1): j for r, (_, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("k", [2, 4, 10])
def test_neighbours_among_other_points(spark, k):
    targets = [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 1000, 0)]
    asked = [(9, 1.5, 0), (2, 2, 0), (7, 40_000, 3)]  # two that are no targets, one that is
    got = {(r["pid"], r["rank"]): r["nn_pid"] for r in spatial.knn(points_of(spark, asked), k, targets=points_of(spark, targets)).collect()}
    assert got == plain_knn(asked, targets, k)


def test_neighbours_in_crowds_and_rank_windows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *rng.normal(0, 0.01, 2).round(3)) for i in range(100)] + [(200 + i, *rng.uniform(-50, 50, 2)) for i in range(20)] + [(400 + i, 3.0, 3.0) for i in range(30)]
    want = plain_knn(rows, rows, 5)
    got = {(r["pid"], r["rank"]): r["nn_pid"] for r in spatial.knn(points_of(spark, rows), 5).collect()}
    assert got == want
    few = points_of(spark, rows[:3])
    window = {(r["pid"], r["rank"]): r["nn_pid"] for r in spatial.neighbour_ranks(few, 2, 4).collect()}
    plain = plain_knn(rows[:3], rows[:3], 4)
    assert window == {(i, r): plain.get((i, r)) for i, _, _ in rows[:3] for r in (2, 3, 4)}


def test_dense_cells_and_duplicates_cluster_like_pairs(spark):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.uniform(0, 4, (200, 2)).round(1), rng.normal(2, 0.3, (80, 2)), np.full((30, 2), 1.0), [[3.95, 3.95], [3.95, 3.55]]])
    for eps, least in ((0.4, 10), (0.25, 4), (0.3, 40)):
        assert labels_of(clustering.dbscan(frame(spark, xy), eps, least)) == plain_dbscan(xy, eps, least)


def test_dense_cells_in_three_dimensions(spark):
    xyz = np.random.default_rng(4).uniform(0, 3, (120, 3)).round(1)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xyz)], "pid long, x double, y double, z double")
    assert labels_of(clustering.dbscan(df, 1.0, 8, columns=("x", "y", "z"))) == plain_dbscan(xyz, 1.0, 8)


def plain_club(rows, near, least):
    """{pid: cluster} for rows (pid, score, label) and near {pid: [nn_pid, ...]}."""
    order = sorted((p for p, _, label in rows if label == 1), key=lambda p: (-next(s for q, s, _ in rows if q == p), p))
    own, called = {p: k + 1 for k, p in enumerate(order)}, {p: label for p, _, label in rows}
    for p in order:
        run = []
        for q in near.get(p, []):
            if called[q] != 1:
                break
            run.append(q)
        ids = [own[q] for q in run if own.get(q, -1) > 0]
        if len(run) >= least and ids:
            new = min([*ids, own[p]] if own[p] > 0 else ids)
            for q in [p, *run]:
                own[q] = new
        else:
            own[p], called[p] = -1, 0
    groups = {}
    for p, c in own.items():
        if c > 0:
            groups.setdefault(c, []).append(p)
    number = {c: k for k, c in enumerate(sorted(groups, key=lambda c: min(groups[c])))}
    return {p: number.get(own.get(p, -1), -1) for p, _, _ in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_club_takes_consecutive_neighbours(spark, seed):
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.normal(c, 0.6, (25, 2)) for c in (0, 4, 8)] + [rng.uniform(-3, 11, (30, 2))])
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
    near = {p: [int(q) for q in np.lexsort((np.arange(len(xy)), d2[p])) if q != p][:8] for p in range(len(xy))}
    rows = [(p, float(rng.uniform()), int(rng.uniform() < (0.9 if p < 75 else 0.3))) for p in range(len(xy))]
    points = spark.createDataFrame(rows, "pid long, score double, label int")
    links = spark.createDataFrame([(p, r + 1, q, float(d2[p, q] ** 0.5)) for p, qs in near.items() for r, q in enumerate(qs)], "pid long, rank int, nn_pid long, dist double")
    results = {}
    for least in (1, 3, 8):
        got = {r["pid"]: r["cluster"] for r in clustering.club(points, links, least=least).collect()}
        assert got == plain_club(rows, near, least)
        results[least] = got
    assert results[1] != results[8]


@pytest.mark.parametrize("block", [clustering.CLUB_BLOCK, 12])
def test_club_in_blocks_of_space(spark, monkeypatch, block):
    monkeypatch.setattr(clustering, "CLUB_BLOCK", block)
    rng = np.random.default_rng(7)
    xy = np.concatenate([rng.normal(c, 0.8, (30, 2)) for c in (0, 3, 6)] + [rng.uniform(-3, 9, (30, 2))])
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
    near = {p: [int(q) for q in np.lexsort((np.arange(len(xy)), d2[p])) if q != p][:6] for p in range(len(xy))}
    rows = [(p, float(round(x, 1)), int(rng.uniform() < 0.85)) for p, (x, _) in enumerate(xy)]  # turns sweep across space, with ties
    points = spark.createDataFrame([(*r, float(x), float(y)) for r, (x, y) in zip(rows, xy, strict=True)], "pid long, score double, label int, x double, y double")
    links = spark.createDataFrame([(p, r + 1, q, float(d2[p, q] ** 0.5)) for p, qs in near.items() for r, q in enumerate(qs)], "pid long, rank int, nn_pid long, dist double")
    got = {r["pid"]: r["cluster"] for r in clustering.club(points, links, least=2, columns=("x", "y")).collect()}
    assert got == plain_club(rows, near, 2) and len(set(got.values())) > 2


def test_outlines_fall_apart_and_are_cleaned(spark):
    rng = np.random.default_rng(2)
    a, b, alone = rng.uniform(0, 1, (12, 2)), rng.uniform(0, 1, (9, 2)) + [30, 0], np.array([[60.0, 0.0]])
    rows = [(i, 0, *map(float, v)) for i, v in enumerate([*a, *b, *alone])] + [(50, 1, 0.0, 9.0), (51, 1, 0.1, 9.0), (60, -1, 5.0, 5.0)]
    points = spark.createDataFrame(rows, "pid long, label int, x double, y double")
    near = spark.createDataFrame([(r[0], 1, 0.3) for r in rows], "pid long, rank int, dist double")  # buffers of 0.36
    out = {r["pid"]: (r["label"], r["refined"]) for r in clustering.cleaned(clustering.shaped(points, near)).collect()}
    assert 60 not in out and out[50] == out[51] == out[21] == (0, 0)
    assert {out[i] for i in range(12)} == {(1, 1)} and {out[i] for i in range(12, 21)} == {(2, 1)}


def test_algorithms_by_name(spark):
    xy = np.concatenate([np.random.default_rng(1).normal(c, 0.3, (30, 2)) for c in (0, 5)])
    points = frame(spark, xy)
    labels, seconds = clustering.timed_cluster(points, "dbscan", eps=0.6, min_samples=5)
    assert seconds > 0 and labels_of(labels) == plain_dbscan(xy, 0.6, 5)
    assert len({x for x in labels_of(clustering.cluster(points, "staged", cut=0.5)) if x >= 0}) >= 2
    for name in ("search_line", "search_grid_loop"):
        got = labels_of(clustering.cluster(points, name, points_per_dimension=2, minmax_threshold=(4, 8)))
        assert len(got) == 60 and max(got) >= 0
    assert labels_of(clustering.cluster(points.filter("x > 100"), "dbscan", eps=1.0, min_samples=3)) == []


def test_search_outputs(spark):
    xy = np.concatenate([np.random.default_rng(1).normal(c, 0.3, (30, 2)) for c in (0, 5)])
    search = phase.ParameterSearch(algo="dbscan", points_per_dimension=3, minmax_threshold=(4, 10)).fit(frame(spark, xy))
    chosen = search.selected_parameters()
    assert labels_of(search.compute_clusters(**chosen)) == labels_of(search.labels) == plain_dbscan(xy, chosen["sigma"], chosen["threshold"])
    scores = {r["idx"]: r["similarityScore"] for r in search.phasespace.collect()}
    matrix = {(r["i"], r["j"]): r["score"] for r in search.similarity_matrix().collect()}
    assert all(scores[i] == sum(v for (x, _), v in matrix.items() if x == i) for i in scores) and max(scores.values()) > 0
    best = max(scores, key=lambda i: (scores[i], -i))
    spread = search.score_distribution(best).collect()
    assert len(spread) == 60 and all((r["similarityScore"] == 0) for r in spread if r["label"] < 0)
    for bad in ({"algo": "x"}, {"one_two_d": "x"}, {"similarity_score_computation": "x"}, {"adaptive_sigma_boundaries": False}):
        with pytest.raises(ValueError):
            phase.ParameterSearch(**bad)


def test_ranks_without_one_task(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("k"), (F.col("id") % 3).alias("g"))
    assert [r["rank"] for r in ranked(df, "k").orderBy("k").collect()] == list(range(3000))
    rows = hashed_rank(df, ("g",), "k", 5).collect()
    assert {g: sorted(r["__r"] for r in rows if r["g"] == g) for g in range(3)} == {g: list(range(1, 1001)) for g in range(3)}
    assert features.sample_rows(df, most=17, key="k").count() == 17


def test_sprinkled_points_lie_apart_and_inside(spark):
    ring = [(0.0, 0.0), (60.0, 10.0), (90.0, 70.0), (30.0, 40.0), (0.0, 0.0)]
    made = generate.sprinkled(spark, ring, 400, seed=2)
    assert made.count() == made.select("x", "y").distinct().count() == 400
    assert made.filter(spatial.in_ring(F.col("x"), F.col("y"), ring)).count() == 400
    seeds = np.array([(r["x"], r["y"]) for r in generate.spaced_seeds(spark, ring, 30, 2.0, seed=2).collect()])
    d2 = ((seeds[:, None] - seeds[None]) ** 2).sum(2) + np.eye(len(seeds)) * 1e9
    assert len(seeds) > 5 and d2.min() > 4.4**2
    assert generate.sprinkled(spark, [(0.0, 0.0), (1.0, 1.0)], 5).count() == 0


def test_truth_table_has_sixteen_numbers(spark):
    grid = generate.scenarios(spark, {"points": [800.0], "share_clustered": [0.5], "per_cluster": [20.0], "radius": [30.0], "side": [2000.0]})
    cells = generate.simulated_cells(grid, 2)
    rows = generate.truth_table(cells, grid).collect()
    assert len(rows) == 2 and len(rows[0]) == 16
    for r in rows:
        n = cells.filter(F.col("rep") == r["cell_repeat"])
        assert r["total_points"] == n.count() and r["cluster_count"] == n.filter("label = 1").select("cluster").distinct().count()
        assert r["points_per_um2"] == pytest.approx(200) and r["points_per_um2_in_image"] == pytest.approx(r["total_points"] / 4)


def test_fixed_width_records_and_exports(spark, tmp_path):
    m = np.random.default_rng(0).uniform(size=(250, 6))
    m.tofile(tmp_path / "m.bin")
    (tmp_path / "m.json").write_text(json.dumps([250, 6]))
    got = src.read_fixed_width(spark, (tmp_path / "m.bin").as_uri(), str(tmp_path / "m.json"), rows_a_task=64).orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(250)) and np.allclose([r["v"] for r in got], m)
    for k in range(3):
        src.append_records(spark.createDataFrame([(k, k * 1.5)], "k int, v double"), str(tmp_path / "log"))
    assert src.read_records(spark, str(tmp_path / "log")).count() == 3 and src.read_records(spark, str(tmp_path / "log"), "v > 1").count() == 2
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 3.25, "b")], "pid long, x double, t string")
    src.write_fixed(df, str(tmp_path / "fixed"))
    lines = sorted(line for f in (tmp_path / "fixed").glob("part-*") for line in f.read_text().splitlines())
    assert sum("3.250" in x and "\tb" in x for x in lines) == 1
    assert src.download(df, str(tmp_path / "d.csv")) == 2
    with pytest.raises(ValueError):
        src.download(df, str(tmp_path / "d.csv"), most=1)
    src.write_settings(str(tmp_path / "s.json"), {"b": 1, "a": [2]})
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": [2], "b": 1}
    (tmp_path / "t.tsv").write_text("x\ty\tz\n1\t2\t3\n4\t5\t6\n")
    assert sorted(tuple(r) for r in src.read_table(spark, str(tmp_path / "t.tsv"), columns=[0, 2], scale=10.0, scaled=(2,)).collect()) == [(1.0, 30.0), (4.0, 60.0)]


def test_windows_of_both_sets(spark):
    rng = np.random.default_rng(0)
    a, b = (points_of(spark, [(i, *rng.uniform(0, 10, 2)) for i in range(n)]) for n in (50, 8))
    rows, settings = filters.define_window(a, b, ((5, 5), (5, 5)), 20)
    assert {r["type"]: r["count"] for r in rows.groupBy("type").count().collect()} == {"incell": 20, "outcell": 7}
    assert json.loads(settings) == {"n": 20, "incell": [5, 5], "outcell": [5, 5]}


def test_missing_shared_folder_is_an_error_on_a_cluster():
    from punctaria.operators.storage import shared_folder

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_confusion_of_all_files(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("b", 1, 0), ("b", 1, 1)], "file string, t int, p int")
    got = {r["file"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in evaluate.pooled_confusion(df, "t", "p", "file").collect()}
    assert got == {"a": (1, 1, 0, 0), "b": (1, 0, 1, 0), None: (2, 1, 1, 0)}
    shapes = spark.createDataFrame([(0, 4.0, 8)], "label int, area double, population long")
    assert stats.with_shapes(shapes).first()["cluster_density"] == 2.0


def test_nulls_and_ratios(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 4.0), (None, 1.0), (3.0, 0.0), (0.0, 0.0), (3.0, None)], "a double, b double")
    plain = df.select(scalar.nan_to_null(F.col("a")).alias("a"), scalar.safe_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["a"] for r in plain] == [1.0, None, None, 3.0, 0.0, 3.0]
    assert plain[0]["r"] == 0.5 and [r["r"] for r in plain[2:]] == [None] * 4


def test_full_field_roi(spark):
    ring = generate.full_field_roi((0.0, 4.0, -1.0, 2.0))
    assert ring[0] == ring[-1] and {(x, y) for x, y in ring} == {(0.0, -1.0), (4.0, -1.0), (4.0, 2.0), (0.0, 2.0)}
    x, y = np.array(ring).T
    assert abs(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1])) / 2 == 12.0
