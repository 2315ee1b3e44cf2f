"""What the findings of the third round were about."""

import numpy as np
import pandas as pd

from punctaria.operators import blocks, clustering, generate, kd, spatial

from .test_clustering import plain_dbscan


def frame(spark, x, **more):
    return spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1], **more}))


def test_far_from_takes_the_square_of_the_written_distance(spark):
    left, right = frame(spark, np.array([[0.0, 0.0], [9.0, 0.0]])), frame(spark, np.array([[3.1, 0.0]]))
    assert 3.1 * 3.1 > 9.61  # so that 3.1 in doubles lies beyond the SQL's bound
    assert sorted(r["pid"] for r in spatial.far_from(left, right, 3.1).collect()) == [0, 1]


def test_hulls_of_many_clusters_at_once(spark):
    rng = np.random.default_rng(1)
    label = rng.integers(0, 60, 3000)
    x = np.round(rng.normal(0, 3, (3000, 2)) + label[:, None], 1)
    label[-4:] = [100, 100, 101, 102]
    x[-4:] = [[1, 1], [1, 1], [np.nan, 2], [5, 6]]
    rings = {r["label"]: [(p["x"], p["y"]) for p in r["ring"]] for r in spatial.convex_hulls(frame(spark, x, label=label), "label").collect()}
    assert set(rings) == set(label.tolist()) and rings[101] == [] and rings[100] == [(1, 1)] and rings[102] == [(5, 6)]
    for k in range(60):
        assert rings[k] == [tuple(p) for p in spatial.hull(x[label == k]).tolist()]


def test_hulls_call_no_function_a_cluster(spark, monkeypatch):
    plan = spatial.convex_hulls(frame(spark, np.zeros((2, 2)), label=np.zeros(2, int)), "label")._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" not in plan


def test_clusters_in_blocks_and_by_cells_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.round(np.concatenate([rng.uniform(0, 60, (900, 2)), rng.normal(20, 1, (200, 2)), np.full((30, 2), 40.0)]), 1)
    kind = np.array(["a", "b"])[rng.integers(0, 2, len(x))]
    both = frame(spark, x, kind=kind)
    monkeypatch.setattr(blocks, "WIDTH", 2)
    monkeypatch.setattr(blocks, "BLOCK", 40)
    monkeypatch.setattr(clustering, "PEEL_BLOCK", 40)
    told = blocks.dealt(both, 1.5, ("x", "y"), ())
    assert told.select("__home").distinct().count() > 10 and told.count() > len(x)
    results = []
    for most in (blocks.MOST, 0):  # 0: all is crowded
        monkeypatch.setattr(blocks, "MOST", most)
        one = clustering.dbscan(both, 1.5, 5)
        assert {r["pid"]: r["label"] for r in one.collect()} == dict(enumerate(plain_dbscan(x, 1.5, 5)))
        results.append([
            {(r["kind"], r["pid"]): (r["label"], r["is_core"]) for r in clustering.dbscan(both, 1.5, 5, by=("kind",)).collect()},
            {r["pid"]: r["label"] for r in clustering.dbscan_loop(both, 1.5, 5).collect()},
            {(r["kind"], r["pid"]): r["label"] for r in clustering.dbscan_loop(both, 1.5, 4, by=("kind",)).collect()},
            {r["pid"] for r in clustering.peeled(both, 1.5, 5).collect()},
        ])
    assert results[0] == results[1] and all(results[0])


def test_clustering_copies_points_into_few_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 400, (20_000, 2))
    held = blocks.dealt(frame(spark, x), 2.0, ("x", "y"), (), 2000)
    assert held.count() < 1.5 * len(x)  # by cells there were 25 copies of each point


def test_free_placement_holds_corners_only(spark, monkeypatch):
    rng = np.random.default_rng(9)
    tid = np.repeat(np.arange(9), 200)
    x = np.stack([rng.uniform(0, 5, len(tid)), rng.integers(0, 5, len(tid)).astype(float)], 1)
    sizes, open_pairs, apart, looked = [], [], generate._apart, generate._points_apart
    monkeypatch.setattr(generate, "_apart", lambda p, q, d: sizes.append(len(p)) or apart(p, q, d))
    monkeypatch.setattr(generate, "_points_apart", lambda *a: open_pairs.append(a) or looked(*a))
    templates = frame(spark, x, tid=tid)
    placed = generate.geometry_free(templates, 0.0, 5).toPandas()
    assert max(sizes) < 100
    # As with all points on the driver.
    d, sets = generate.typical_diameter(templates), [x[tid == k] for k in range(9)]
    draw, before = np.random.default_rng(5), []
    for pts in sets:
        while True:
            mine = pts + draw.uniform(0, 3 * 3 * d, 2)
            if all(((mine[:, None] - other[None]) ** 2).sum(2).min() > d * d for other in before):
                break
        before.append(mine)
    for k in range(9):
        assert sorted(zip(*placed[placed.truth == k][["x", "y"]].to_numpy().T)) == sorted(map(tuple, before[k]))


def test_points_decide_where_corners_leave_it_open(spark):
    flat = lambda y: [[k / 100, y] for k in range(101)]
    x = np.array([*flat(0.0), [0.0, 9.0], [0.0, -1.0], [0.5, -1.0]])
    templates = frame(spark, x, tid=np.array([0] * 102 + [1] * 2))
    assert not generate._points_apart(templates, (0, 0.0, 0.0), (1, 0.0, 0.0), 1.0)
    assert generate._points_apart(templates, (0, 0.0, 0.0), (1, 0.0, -0.5), 1.0)
    square = np.array([[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]])
    assert generate._apart(square, square / 10 + [4.5, -1.5], 1.0) is None
    assert generate._apart(square, square + [10.5, 0], 1.0) is False and generate._apart(square, square + [12, 0], 1.0) is True


def test_the_cluster_of_the_smallest_core_point_takes_one_clustering(spark, monkeypatch):
    monkeypatch.setattr(spatial, "eps_pairs", None)  # no pairs of all points
    x = np.array([[50.0, 0.0], [0.0, 0.0], [0.5, 0.0], [1.0, 0.0], [9.0, 0.0], [9.5, 0.0], [9.7, 0.0]])
    assert sorted(r["pid"] for r in clustering.cluster_of(frame(spark, x), 1.0, 3).collect()) == [1, 2, 3]
    assert clustering.cluster_of(frame(spark, x), 1.0, 5).count() == 0
    assert clustering.cluster_of(frame(spark, x), 1.0, 3, 5).count() == 3


def test_neighbours_within_a_radius_go_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.uniform(0, 30, (700, 2)), np.full((12, 2), 9.0)]), 1)
    monkeypatch.setattr(blocks, "BLOCK", 60)
    points = frame(spark, x).unionByName(spark.createDataFrame([(9_000, None, 1.0)], "pid long, x double, y double"))
    expected = set()
    for p in range(len(x)):
        gap = x - x[p]
        d2 = gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1]
        near = sorted((d, q) for q, d in enumerate(d2) if q != p and d <= 1.5 * 1.5)[:4]
        expected |= {(p, r + 1, q, float(np.sqrt(d))) for r, (d, q) in enumerate(near)}
    by_pairs = spatial.range_pairs
    monkeypatch.setattr(spatial, "range_pairs", None)
    assert {tuple(r) for r in spatial.knn_within(points, 4, 1.5).collect()} == expected
    monkeypatch.setattr(spatial, "range_pairs", by_pairs)
    monkeypatch.setattr(blocks, "MOST", 1)
    assert {tuple(r) for r in spatial.knn_within(points, 4, 1.5).collect()} == expected


def test_core_points_ask_for_no_neighbours_beyond_eps(spark, monkeypatch):
    monkeypatch.setattr(clustering, "knn", None)
    points = frame(spark, np.array([[0.0, 0], [1, 0], [2, 0], [4, 0], [50, 0], [51.5, 0], [53, 0]]))
    assert [tuple(r) for r in clustering.core_by_kth_neighbour(points, 2.0, 3).orderBy("pid").collect()] == [(0, False), (1, True), (2, False), (3, False), (4, False), (5, True), (6, False)]
    assert {r["pid"]: (r["is_core"], r["closed"]) for r in clustering.core_of_cores(points, 3.5, 3).collect()} == {0: (True, True), 1: (True, True), 2: (True, True), 3: (True, True), 4: (True, True), 5: (True, True), 6: (True, True)}


def test_many_targets_are_measured_by_small_leaves(monkeypatch):
    rng = np.random.default_rng(11)
    x = np.round(np.concatenate([rng.exponential(20, (2500, 2)), np.full((60, 2), 7.0), rng.uniform(0, 1, (500, 2)) * [90, 0]]), 1)
    order, own, r2 = rng.permutation(len(x)), np.arange(len(x)) % 7 - 1, rng.choice([np.inf, 4.0, 0.0], len(x))
    own = np.where(own < 0, -1, order)
    expected = kd._plain(x, order, x, own, 10, r2)
    monkeypatch.setattr(kd, "_plain", None)  # which measures all targets
    monkeypatch.setattr(kd, "_QUERIES_AT_ONCE", 1000)
    got = kd.nearest(x, order, x, own, 10, r2)
    assert all(a.tolist() == b.tolist() for a, b in zip(got, expected, strict=True))


def test_neighbours_as_lists(spark, monkeypatch):
    x = np.round(np.random.default_rng(12).uniform(0, 20, (400, 2)), 1)
    monkeypatch.setattr(spatial, "BLOCK_TARGETS", 50)
    lists = {r["pid"]: [tuple(n) for n in r["nn"]] for r in spatial.knn(frame(spark, x), 4, lists=True).collect()}
    assert len(lists) == 400 and {(p, *n) for p, nn in lists.items() for n in nn} == {tuple(r) for r in spatial.knn(frame(spark, x), 4).collect()}
    for p, nn in lists.items():
        gap = x - x[p]
        d2 = gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1]
        assert nn == [(r + 1, q, float(np.sqrt(d2[q]))) for r, q in enumerate([q for q in np.lexsort((np.arange(len(x)), d2)) if q != p][:4])]


def test_stages_write_neighbours_once_and_take_few_rounds(spark, monkeypatch):
    x = np.stack([np.arange(300) * 0.9, np.zeros(300)], 1) * (1 + np.arange(300)[:, None] / 1e4)  # a chain: turns go from its dense end on, through all blocks
    points = frame(spark, x)
    rows = {}

    def named(df, name, put=clustering.written):
        rows.setdefault(name, []).append(1)
        return put(df, name)

    build = kd.build
    monkeypatch.setattr(kd, "build", lambda points, columns, *_: build(points, columns, 40))  # blocks of far fewer points than one may take in the end
    for module in (clustering, spatial):
        monkeypatch.setattr(module, "written", named)
    got = {r["pid"]: r["label"] for r in clustering.cluster(points, "staged", cut=9.0).collect()}
    assert set(got) == set(range(300)) and max(got.values()) >= 0
    assert len(rows["club-round"]) == 1 and len(rows["stage-called"]) == 1 and "stage-neighbours" not in rows and "knn" not in rows


def test_jumps_in_lists_as_medians_have_them():
    rng = np.random.default_rng(13)
    for _ in range(300):
        dist = np.sort(np.round(rng.exponential(1, rng.integers(1, 12)), 1))
        steps = np.diff(dist)
        off = np.abs(steps - np.median(steps)) if len(steps) else steps
        spread = np.median(off) if len(off) else 0
        out = np.flatnonzero(off > 5 * spread * spread) if spread else []
        assert clustering._until_jump(dist.tolist(), 2) == (out[0] + 1 if len(out) > 2 else len(dist))
