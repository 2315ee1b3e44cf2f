"""Series of experiments: many point sets with known clusters, clustered by several algorithms and scored, in one plan for all."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import dbscan, dbscan_loop
from .evaluate import greedy_match
from .storage import delete, written

#: Algorithms that cluster all experiments of a table at once: functions of (points, by, settings) to (by..., pid, label).
ALGORITHMS: dict[str, Callable[..., DataFrame]] = {
    "dbscan": lambda points, by, **settings: dbscan(points, by=by, **settings).select(*by, "pid", "label"),
    "DbscanLoop": lambda points, by, **settings: dbscan_loop(points, by=by, **settings),
}


def algorithms_of(parameters: dict) -> dict[str, tuple[str, dict]]:
    """{name: (algorithm, settings)} of a parameter file with ``algos`` and ``params_algos``. A name may have a suffix after a colon, so that one algorithm can run with several settings."""
    out = {}
    for name in parameters["algos"]:
        algorithm = name.split(":")[0]
        if algorithm not in ALGORITHMS:
            raise ValueError(f"{name} is not an algorithm for series; known are {sorted(ALGORITHMS)}")
        out[name] = (algorithm, dict(parameters["params_algos"][name]))
    return out


def assignments(points: DataFrame, algorithms: dict[str, tuple[str, dict]], by: tuple[str, ...]) -> DataFrame:
    """(by..., algo, pid, label, truth), written: the labels of every algorithm for ``points`` (by..., pid, x, y, truth), where ids may repeat from one experiment to another."""
    parts = []
    for name, (algorithm, settings) in algorithms.items():
        labels = ALGORITHMS[algorithm](points.select(*by, "pid", "x", "y"), by, **settings)
        parts.append(labels.select(*by, F.lit(name).alias("algo"), "pid", "label"))
    found = reduce(DataFrame.unionByName, parts)
    return written(found.join(points.select(*by, "pid", "truth"), [*by, "pid"]), "series-labels")


def scores(labelled: DataFrame, by: tuple[str, ...], min_overlap: float = 0.3) -> DataFrame:
    """A row for each experiment and algorithm of ``labelled`` (by..., algo, label, truth): clusters matched with reference clusters, and points clustered in both, of one side only; the ratios to the number
    of reference clusters, null without any; and the mean number of clusters in a reference cluster."""
    key = [*by, "algo"]
    match = greedy_match(labelled, min_overlap, tuple(key)).groupBy(*key).agg(F.count("*").alias("true_positives"))
    own, ref = F.col("label") >= 0, F.col("truth") >= 0
    counts = labelled.groupBy(*key).agg(
        F.countDistinct(F.when(own, F.col("label"))).alias("clusters"), F.countDistinct(F.when(ref, F.col("truth"))).alias("N_clusters"),
        F.count_if(own & ref).alias("points_in_both"), F.count_if(own & ~ref).alias("points_found_only"), F.count_if(~own & ref).alias("points_missed"),
    )
    inside = labelled.filter(own & ref).select(*key, "label", "truth").distinct().groupBy(*key).agg(F.count("*").alias("parts"))
    out = counts.join(match, key, "left").join(inside, key, "left").na.fill(0, ["true_positives", "parts"])
    return out.select(
        *key, "clusters", "N_clusters", "true_positives", (F.col("clusters") - F.col("true_positives")).alias("false_positives"), (F.col("N_clusters") - F.col("true_positives")).alias("false_negatives"),
        F.try_divide("true_positives", "N_clusters").alias("true_positives_ratio"), F.try_divide(F.col("clusters") - F.col("true_positives"), F.col("N_clusters")).alias("false_positives_ratio"),
        "points_in_both", "points_found_only", "points_missed", F.try_divide("parts", "N_clusters").alias("mean_subclusters"),
    )


def run_series(points: DataFrame, parameters: dict, by: tuple[str, ...] = ("var_1", "var_2"), folder: str | None = None) -> DataFrame:
    """Scores of all experiments (by..., not null) in ``points`` by all algorithms of ``parameters``.

    All experiments of an algorithm are clustered in one plan, and all are matched in the same rounds. With a ``folder``, results are kept there as Parquet: only experiments and algorithms that it lacks are
    computed and added in one write, so a run that was broken off, or one with more experiments, computes what is missing; what is returned is all that stands there for these.
    """
    spark, key = points.sparkSession, [*by, "algo"]
    algorithms = algorithms_of(parameters)
    overlap = parameters.get("min_overlap", 0.3)
    if folder is None:
        return scores(assignments(points, algorithms, by), by, overlap)
    marker = spark._jvm.org.apache.hadoop.fs.Path(folder)
    known = spark.read.parquet(folder).select(*key) if marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker) else None
    for name, chosen in algorithms.items():
        todo = points if known is None else points.join(known.filter(F.col("algo") == name).select(*by).distinct(), list(by), "left_anti")
        todo = written(todo.select(*by, "pid", "x", "y", "truth"), "series-open")
        if todo.take(1):
            labelled = assignments(todo, {name: chosen}, by)
            scores(labelled, by, overlap).coalesce(1).write.mode("append").parquet(folder)  # a row an experiment
            delete(labelled)
        delete(todo)
    return spark.read.parquet(folder).filter(F.col("algo").isin(list(algorithms)))
