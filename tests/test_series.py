"""Series of experiments against one run after the other."""

import random

import pytest

from punctaria.operators import series

from .test_clustering import plain_dbscan, plain_loop

PARAMETERS = {"algos": ["dbscan", "DbscanLoop", "dbscan:wide"], "params_algos": {"dbscan": {"eps": 1.5, "min_samples": 4}, "DbscanLoop": {"eps": 1.5, "min_samples": 4}, "dbscan:wide": {"eps": 3.0, "min_samples": 4}}}


def experiment(rng, var_1, var_2):
    rows = []
    for k in range(4):
        cx, cy = rng.randint(0, 24), rng.randint(0, 24)
        rows += [(cx + rng.gauss(0, 1), cy + rng.gauss(0, 1), k) for _ in range(20)]
    rows += [(rng.uniform(-4, 28), rng.uniform(-4, 28), -1) for _ in range(30)]
    return [(var_1, var_2, i, round(x, 2), round(y, 2), t) for i, (x, y, t) in enumerate(rows)]


def plain(rows, name):
    settings = PARAMETERS["params_algos"][name]
    xy = [(x, y) for *_, x, y, _ in rows]
    label = (plain_loop if name == "DbscanLoop" else plain_dbscan)(xy, settings["eps"], settings["min_samples"])
    truth = [r[-1] for r in rows]
    taken, tp = set(), 0
    for a in sorted(set(label) - {-1}):
        n = {t: sum(p == a and q == t for p, q in zip(label, truth, strict=True)) for t in set(truth) - {-1}}
        free = sorted((-k, t) for t, k in n.items() if t not in taken and k > 0.3 * truth.count(t))
        if free:
            taken.add(free[0][1])
            tp += 1
    found, known = len(set(label) - {-1}), len(set(truth) - {-1})
    both = [(p >= 0, q >= 0) for p, q in zip(label, truth, strict=True)]
    return found, known, tp, both.count((True, True)), both.count((True, False)), both.count((False, True))


def got(df):
    columns = ["clusters", "N_clusters", "true_positives", "points_in_both", "points_found_only", "points_missed"]
    return {(r["var_1"], r["var_2"], r["algo"]): tuple(r[c] for c in columns) for r in df.collect()}


def frame(spark, experiments):
    return spark.createDataFrame([r for e in experiments.values() for r in e], "var_1 string, var_2 int, pid long, x double, y double, truth int")


def test_all_experiments_at_once_and_what_is_missing_later(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    experiments = {(a, b): experiment(rng, a, b) for a in "pq" for b in (0, 1)}
    want = {(*k, name): plain(rows, name) for k, rows in experiments.items() for name in PARAMETERS["algos"]}
    assert got(series.run_series(frame(spark, experiments), PARAMETERS)) == want
    assert any(v[2] for v in want.values())

    folder = str(tmp_path / "series")
    some = {k: v for k, v in experiments.items() if k[0] == "p"}
    first = got(series.run_series(frame(spark, some), PARAMETERS | {"algos": ["dbscan"]}, folder=folder))
    assert first == {k: v for k, v in want.items() if k[0] == "p" and k[2] == "dbscan"}
    computed = []
    plain_scores = series.scores
    monkeypatch.setattr(series, "scores", lambda df, *a: computed.extend((r["algo"], r["var_1"]) for r in df.select("algo", "var_1").distinct().collect()) or plain_scores(df, *a))
    assert got(series.run_series(frame(spark, experiments), PARAMETERS, folder=folder)) == want
    assert ("dbscan", "p") not in computed and ("dbscan", "q") in computed
    computed.clear()
    assert got(series.run_series(frame(spark, experiments), PARAMETERS, folder=folder)) == want and not computed


def test_unknown_algorithms_are_errors():
    with pytest.raises(ValueError):
        series.algorithms_of({"algos": ["other"], "params_algos": {"other": {}}})
