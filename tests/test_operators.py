"""Smaller operators: readers, filters, images, features, evaluation, generators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctaria.functions import scalar
from punctaria.operators import evaluate, features, filters, generate, image, ml, spatial, stats
from punctaria.sources import points as src


def test_text_points(spark, tmp_path):
    (tmp_path / "cluster_10.txt").write_text("# x y\n3 4\n 1.5\t2 9\n3 4\n\n")
    (tmp_path / "cluster_2.txt").write_text("0 0\n")
    p = src.read_points(spark, str(tmp_path / "cluster_10.txt"), scale=2.0)
    assert [tuple(r) for r in p.orderBy("pid").collect()] == [(0, 3.0, 4.0), (1, 6.0, 8.0)]
    parts = src.read_partitioned_points(spark, str(tmp_path / "cluster_*.txt"))
    assert {r["tid"] for r in parts.collect()} == {2, 10}


def test_csv_readers_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (3.0, 4.0, "b")], "x double, y double, t string")
    src.write_csv(df, str(tmp_path / "a.csv"))
    assert src.read_points(spark, str(tmp_path / "a.csv")).count() == 2
    src.write_text(df.select("x", "y"), str(tmp_path / "t"), comment="x y")
    assert src.read_points(spark, str(tmp_path / "t"), fmt="text").count() == 2
    (tmp_path / "u").write_text("1 2\n3 4\n")
    assert src.read_upload(spark, str(tmp_path / "u")).count() == 2
    (tmp_path / "g").write_text("1,2,9\n3,4,9\n")
    assert src.read_csv_guarded(spark, str(tmp_path / "g")).count() == 2
    assert src.read_csv_guarded(spark, str(tmp_path / "g"), most=2) is None
    (tmp_path / "r").write_text("1\t2\n3\t4\n")
    assert [r["y"] for r in src.read_roi_text(spark, str(tmp_path / "r"), 10).orderBy("x").collect()] == [8.0, 6.0]


def test_parameters(tmp_path):
    (tmp_path / "p.json").write_text('{"N_x": 9}')
    assert src.read_parameters(str(tmp_path / "p.json"), src.SEGMENTATION_DEFAULTS)["N_x"] == 9
    assert src.read_parameters(str(tmp_path / "none"), src.SEGMENTATION_DEFAULTS) == src.SEGMENTATION_DEFAULTS
    with pytest.raises(FileNotFoundError):
        src.read_parameters(str(tmp_path / "none"))


def test_cache_computes_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    cache = src.Cache(spark, tmp_path.as_uri())
    assert cache.get("a", {"k": 1}, compute).count() == cache.get("a", {"k": 1}, compute).count() == 3
    assert len(calls) == 1


def test_ring_json(spark):
    v = spark.createDataFrame([(1, 1.0, 0.0), (0, 0.0, 0.0), (2, 1.0, 1.0)], "i int, x double, y double")
    assert src.ring_json(v).first()["json"] == "[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]"


def test_checks(spark):
    ok = spark.createDataFrame([(0.0, 0.0), (5.0, 4.0)], "x double, y double")
    assert filters.check_points(ok)["x_max"] == 5
    with pytest.raises(ValueError):
        filters.check_points(ok.withColumn("y", F.lit(float("nan"))))
    with pytest.raises(ValueError):
        filters.check_points(ok.withColumn("x", F.col("x") * 100))
    with pytest.raises(ValueError):
        filters.crop(ok, [(0, 1)], ["x", "y"])


def test_nearest_leaves_the_farthest_out(spark):
    p = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)], "pid long, x double, y double")
    assert filters.n_nearest(p, 0, 0, 3).count() == 3
    assert filters.n_nearest(p, 0, 0, 9).count() == 4


def test_half_even(spark):
    got = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double").select(scalar.half_even(F.col("v")).alias("v")).collect()
    assert [r["v"] for r in got] == [0, 2, 2]
    assert scalar.poisson_pmf(2, 1.5) == pytest.approx(0.2510214)
    assert sum(scalar.negative_binomial_pmf(k, 2.0, 0.4) for k in range(200)) == pytest.approx(1)


def test_blur_keeps_the_sum_and_otsu_separates(spark):
    rows = [(i, j, 10.0 if i > 5 else 1.0) for i in range(12) for j in range(9)]
    img = spark.createDataFrame(rows, "ix int, iy int, v double")
    assert image.gaussian(img, 12, 9, 1.0).agg(F.sum("v")).first()[0] == pytest.approx(sum(r[2] for r in rows))
    assert 1.0 < image.otsu_threshold(img) < 10.0 or image.otsu_threshold(img) == pytest.approx(1.0, abs=0.05)
    assert image.dense(img.filter("ix > 5"), 12, 9).count() == 108


def test_components_are_eight_connected(spark):
    m = spark.createDataFrame([(0, 0), (1, 1), (5, 5), (5, 6), (9, 0)], "ix int, iy int")
    got = {(r["ix"], r["iy"]): r["label"] for r in image.components(m).collect()}
    assert got == {(0, 0): 1, (1, 1): 1, (5, 5): 2, (5, 6): 2, (9, 0): 3}


def test_zero_aware_quantile(spark):
    img = spark.createDataFrame([(0, 0, 4.0), (0, 1, 2.0)], "ix int, iy int, v double")
    got = image.clip_at_quantile(img, 0.9, nonzero_only=False, n_pixels=10).agg(F.max("v")).first()[0]
    assert got == pytest.approx(np.quantile([0] * 8 + [4, 2], 0.9))


@pytest.mark.parametrize("kind", features.NORMALISATIONS)
def test_normalisations_against_numpy(spark, kind):
    d = np.array([[1.0, 2.0, 4.0], [1.0, 1.5, 2.0]])
    a = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(d)], "pid long, d array<double>")
    got = [r["f"] for r in features.normalise(a, kind).orderBy("pid").collect()]
    diff, unit = np.diff(d), lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    cut = lambda x: (x * 100000).astype(int)
    want = {
        "Raw-Distances": d, "Norm-Distances-Only": unit(d), "Raw-Differences": diff, "Diff-Norm": cut(unit(diff)), "Norm-Diff": cut(np.diff(unit(d))), "Norm-Diffs-Only-NoRescale": unit(diff),
        "Norm-Self": (d - d.min(1, keepdims=True)) / np.ptp(d, axis=1, keepdims=True), "Norm-FirstDiff": diff / diff[:, :1], "Norm-MinDiff": diff / diff[diff != 0].min(), "Norm-MaxDiff": diff / diff.max(0), "CoordsOnly": np.empty((2, 0)),
    }[kind]
    assert np.allclose(np.array(got), want)


def test_unknown_normalisation(spark):
    with pytest.raises(ValueError):
        features.normalise(spark.createDataFrame([(0, [1.0])], "pid long, d array<double>"), "x")


def test_run_length(spark):
    rows = spark.createDataFrame([(1, [1, 1, 2, 1]), (1, [2, 1]), (1, [1, 1, 1])], "own int, c array<int>")
    assert [r[0] for r in rows.select(features.run_length(F.col("c"), F.col("own"))).collect()] == [2, 0, 2]


def test_pool_is_exact_or_raises(spark):
    rows = spark.range(100).select(F.col("id").alias("pid"), (F.col("id") % 3).cast("int").alias("label"))
    got = features.pool(rows, "label", {"train": 50, "test": 20})
    assert got.filter("part = 'train'").count() == 50 and got.filter("part = 'test'").count() == 20
    with pytest.raises(ValueError):
        features.pool(rows, "label", {"train": 99, "test": 20})


def test_greedy_match_in_label_order(spark):
    rows = [(p, 0, 0) for p in range(4)] + [(p, 1, 0) for p in range(4, 10)] + [(p, 1, 1) for p in range(10, 13)] + [(20, -1, 2)]
    df = spark.createDataFrame(rows, "pid long, label int, truth int")
    assert {(r["label"], r["truth"]) for r in evaluate.greedy_match(df).collect()} == {(0, 0), (1, 1)}
    e = evaluate.cluster_evaluation(df).first()
    assert (e["true_positives"], e["false_positives"], e["false_negatives"], e["n_groundtruth"], e["fn_truths"]) == (2, 0, 1, 3, [2])


def test_generators_keep_their_promises(spark):
    rng = np.random.default_rng(0)
    t = spark.createDataFrame([(k, k * 100 + i, float(x), float(y)) for k in range(4) for i, (x, y) in enumerate(rng.normal(0, 1, (20, 2)))], "tid int, pid long, x double, y double")
    t = generate.prepared_templates(t, 1.0)
    d = generate.typical_diameter(t)
    free = generate.geometry_free(t, 0.5, seed=1)
    assert free.count() == 120 and free.filter("truth = -1").count() == 40 and free.select("pid").distinct().count() == 120
    clusters = free.filter("truth >= 0").toPandas()
    for a in range(4):
        for b in range(a):
            p, q = (clusters.loc[clusters.truth == k, ["x", "y"]].to_numpy() for k in (a, b))
            assert np.sqrt(((p[:, None] - q[None]) ** 2).sum(2)).min() > d
    grid = generate.geometry_grid(t, 3, 2.0, 0.1, seed=1)
    assert grid.filter("truth >= 0").count() == 180 and grid.filter("truth = -1").count() == 18
    assert generate.geometry_path(t, 5, 7, seed=1).count() == 107
    sc = generate.scenarios(spark, {"points": [500.0], "share_clustered": [0.4], "per_cluster": [20.0], "radius": [20.0], "side": [1000.0]})
    truth = generate.ground_truth(generate.simulated_cells(sc, 2, seed=3)).collect()
    assert [r["clusters"] for r in truth] == [10, 10] and all(r["clustered"] == 200 for r in truth)
    assert generate.valid_scenarios(sc, (0.0, 100.0), (0.1, 100.0)).count() == 1
    assert len(generate.cell_outline()) == 401 and generate.square_rois((0, 0), [2.0])[0][0] == (-1, -1)


def test_area_and_isometric_grid(spark):
    ring = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 3.0}, {"x": 0.0, "y": 3.0}],)], "r array<struct<x double, y double>>")
    assert ring.select(spatial.ring_area(F.col("r"))).first()[0] == 6
    spots = {(r["x"], r["y"]) for r in spatial.isometric_spots((0, 3, 0, 3), 1.0, spark).collect()}
    assert spots == {(1.0, 0.5), (1.0, 1.5), (1.0, 2.5), (2.0, 1.0), (2.0, 2.0)}


def test_linear_models(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (300, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a + b > 0)) for a, b in x], "a double, b double, label int")
    s = ml.scores(ml.train_linear(df, ["a", "b"]), df)
    assert ml.auc(s) > 0.99
    r = ml.roc(s).toPandas()
    assert r.tpr.max() == r.fpr.max() == 1
    w, cut = ml.discriminant(df, ["a", "b"])
    assert ((x @ w > cut) == (x.sum(1) > 0)).mean() > 0.95
    folds = features.stratified_folds(df.withColumn("pid", F.monotonically_increasing_id()), "label", k=2)
    v = ml.with_vector(folds, ["a", "b"])
    assert ml.cross_validate(v, 2, 2, epochs=30).first()["mean"] > 0.9


def test_stream_of_events(spark, tmp_path):
    from punctaria.streaming import windowed_statistics

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    q = windowed_statistics(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == e.count()


def test_size_statistics_of_one_row(spark):
    r = stats.size_statistics(spark.createDataFrame([(5, 4.0)], "threshold int, clusterSize double")).first()
    assert (r["n"], r["mean"], r["firstBin"], r["fano"]) == (1, 4.0, 1, 0.0)


def test_hulls_and_diameters_are_exact_at_every_size(spark):
    from punctaria.operators import clustering

    rng = np.random.default_rng(4)
    angle = rng.uniform(0, 2 * np.pi, 700)
    sets = {0: np.stack([np.cos(angle), np.sin(angle)], 1) * 100, 1: rng.normal(0, 5, (3000, 2)), 2: rng.integers(0, 9, (500, 2)).astype(float), 3: rng.normal(0, 1, (40, 2)), 4: np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]]), 5: np.array([[3.0, 4.0]] * 3)}
    rows = [(k, float(x), float(y)) for k, p in sets.items() for x, y in p]
    frame = spark.createDataFrame(rows, "label int, x double, y double").repartition(5)
    far = {r["label"]: r["diameter"] for r in stats.diameters(frame, "label").collect()}
    outlines = {r["label"]: r for r in clustering.hulls(frame).collect()}
    for k, p in sets.items():
        assert far[k] == pytest.approx(np.sqrt(((p[:, None] - p[None]) ** 2).sum(2).max()), rel=1e-12)
        assert outlines[k]["population"] == len(p)
        if k < 4:
            # A convex ring of points that has all points inside is the hull.
            ring = np.array([(c["x"], c["y"]) for c in outlines[k]["ring"]])
            (x, y), (u, v) = ring.T, np.roll(ring, -1, 0).T
            assert {tuple(c) for c in ring} <= {tuple(c) for c in p}
            assert ((u - x)[:, None] * (p[None, :, 1] - y[:, None]) - (v - y)[:, None] * (p[None, :, 0] - x[:, None]) >= -1e-9).all()
            assert outlines[k]["area"] == pytest.approx((x * v - u * y).sum() / 2, rel=1e-12)
    assert len(outlines[0]["ring"]) == 700 and outlines[4]["area"] == outlines[5]["area"] == 0
    none = spark.createDataFrame([(1, None, None), (2, 0.0, 0.0), (2, None, 1.0), (2, 3.0, 4.0)], "tid int, x double, y double")
    assert {r["tid"]: r["diameter"] for r in stats.diameters(none).collect()} == {1: None, 2: 5.0}


def test_geometries_take_whole_tables(spark):
    from punctaria.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert n > 600 and QUERIES["geometry_free"](spark, sf).filter("truth >= 0").count() == n


def test_rings_of_very_different_sizes(spark):
    rng = np.random.default_rng(8)
    xy = rng.uniform(-100, 100, (300, 2))
    boxes = [("all", -1e9, 1e9, -1e9, 1e9)] + [(f"r{i}", x, x + w, y, y + w * 3) for i, (x, y, w) in enumerate(zip(*rng.uniform(-100, 90, (2, 60)), 10 ** rng.uniform(-3, 2, 60), strict=True))] + [("point", 1.0, 1.0, 2.0, 2.0)]
    rings = spark.createDataFrame([(k, [(a, c), (b, c), (b, d), (a, d), (a, c)]) for k, a, b, c, d in [(k, *map(float, v)) for k, *v in boxes]], "roi string, ring array<struct<x double, y double>>")
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "pid long, x double, y double")
    got = {(r["pid"], r["roi"]) for r in spatial.points_in_rings(points, rings).collect()}
    assert got == {(i, k) for i, (x, y) in enumerate(xy) for k, a, b, c, d in boxes if a < x < b and c < y < d}
    assert {r["outer"] for r in spatial.rings_within(rings.filter("roi = 'r3'"), rings).collect()} >= {"all"}
    assert spatial.points_in_rings(points, rings.limit(0)).count() == 0


def test_fitted_count_distributions(spark):
    rng = np.random.default_rng(9)
    made = [("nb", int(k)) for k in rng.negative_binomial(3.0, 0.25, 20_000)] + [("poisson", int(k)) for k in rng.poisson(7.0, 20_000)] + [("one", 4)] * 5 + [("nb", None)] * 3
    sizes = spark.createDataFrame(made, "kind string, clusterSize int")
    got = {r["kind"]: r for r in stats.fitted_counts(sizes, by=("kind",)).collect()}
    assert got["nb"]["r"] == pytest.approx(3.0, rel=0.1) and got["nb"]["p"] == pytest.approx(0.75, rel=0.05) and got["nb"]["nb_error"] < got["nb"]["poisson_error"] / 10
    assert got["poisson"]["mean"] == pytest.approx(7.0, rel=0.03)
    # No better mean nearby, by brute force.
    share = np.bincount([k for c, k in made if c == "poisson"], minlength=101)[:101] / 20_000
    error = [((share - stats._poisson(np.arange(101), np.array([np.log(m)]))) ** 2).sum() for m in np.linspace(6, 8, 401)]
    assert got["poisson"]["poisson_error"] <= min(error) + 1e-9
    assert got["one"]["n"] == 5 and stats.fitted_counts(sizes.limit(0)).count() == 0
    whole = stats.fitted_counts(sizes).first()
    assert whole["n"] == 40_005


def test_text_columns_and_number_lists(spark, tmp_path):
    (tmp_path / "series.csv").write_text("algo,var_1,ratio\ndbscan,1,0.5\nfinder,2,\n")
    rows = src.read_series_table(spark, str(tmp_path / "series.csv")).collect()
    assert [tuple(r) for r in rows] == [("dbscan", 1, 0.5), ("finder", 2, None)]
    (tmp_path / "lists.txt").write_text("1, 2.5;3\nno numbers\n\n-4e1 x 5")
    got = [(r["line"], r["v"]) for r in src.read_number_lists(spark, str(tmp_path / "lists.txt")).orderBy("line").collect()]
    assert got == [(0, [1, 2.5, 3]), (3, [-40, 5])]
