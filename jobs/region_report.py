"""Clusters of localisations in every channel, and statistics of square regions.

    python -m jobs.region_report POINTS OUT [--config FILE]

Reads a table of localisations, clusters each channel by density, and writes under OUT, by channel:

- ``points``: each point with its label (-1 for noise);
- ``regions``: for each square with points, its points, clustered points, clusters, densities and median cluster population.

Only the channels of the input are replaced (dynamic partition overwrite), so a run over one channel leaves the others as they are. Labels depend on nothing but the points,
so a rerun, or one after a failure, leaves the same rows.

Defined results: rows with a null or NaN coordinate, or a null id, are counted in the log and left out; a null or empty channel is called ``none``; an empty table writes nothing.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import configuration, log, main
from punctaria.operators.clustering import dbscan
from punctaria.operators.kd import valid
from punctaria.operators.stats import roi_statistics
from punctaria.operators.storage import delete, written

JOB = "region_report"


def read_points(spark: SparkSession, path: str, settings: dict) -> DataFrame:
    """(channel, pid, x, y) of all rows of a table, by the expressions in the settings."""
    raw = spark.read.format(settings["format"])
    if settings["format"] == "csv":
        raw = raw.option("header", True)
    raw = raw.load(path)
    x, y = (F.expr(settings[c]).cast("double").alias(c) for c in ("x", "y"))
    channel = F.coalesce(F.nullif(F.expr(settings["channel"]).cast("string"), F.lit("")), F.lit("none"))
    return raw.select(channel.alias("channel"), F.expr(settings["pid"]).cast("long").alias("pid"), x, y)


def regions_of(labelled: DataFrame, side: float) -> DataFrame:
    """Statistics of the squares of ``labelled`` (channel, pid, x, y, label) that hold points."""
    square = [F.floor(F.col(c) / side).cast("int").alias(f"r{c}") for c in ("x", "y")]
    placed = labelled.select("channel", "pid", "label", *square)
    roi = F.concat_ws("|", "channel", "rx", "ry")
    squares = placed.select("channel", "rx", "ry").distinct().withColumn("roi", roi)
    # Ids are those of one channel, so the statistics' own id holds both.
    named = placed.select(roi.alias("roi"), F.struct("channel", "pid").alias("pid"), "label")
    found = roi_statistics(named.select("pid", "label"), named.select("pid", "roi"), squares.select("roi", F.lit(float(side * side)).alias("area")))
    return squares.join(found, "roi").drop("roi")


def run(spark: SparkSession, points_path: str, out: str, settings: dict | None = None) -> dict[str, int]:
    """Cluster each channel of a table of localisations and report square regions. Returns what it logs: numbers of rows read and written."""
    settings = settings or configuration(JOB)
    table = read_points(spark, points_path, settings)
    good = F.col("pid").isNotNull() & valid(("x", "y"))
    counts = table.agg(F.count("*").alias("read"), F.count_if(good).alias("good")).first()
    log.info("%s: read %d rows of %s, %d of them without an id or a coordinate", JOB, counts["read"], points_path, counts["read"] - counts["good"])
    told = {"read": counts["read"], "left_out": counts["read"] - counts["good"], "points": 0, "regions": 0}
    if not counts["good"]:
        return told
    points = table.filter(good)
    labels = dbscan(points, settings["eps"], settings["min_samples"], by=("channel",))
    labelled = written(points.join(labels.select("channel", "pid", "label"), ["channel", "pid"]), "labelled")
    regions = written(regions_of(labelled, settings["side"]), "regions")
    for name, df in (("points", labelled), ("regions", regions)):
        # Rows of a channel come together in files of a fair size; a channel with very many is split.
        by_channel = df.hint("rebalance", F.col("channel"))
        by_channel.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("channel").parquet(f"{out}/{name}")
        told[name] = df.count()
        log.info("%s: wrote %d rows to %s/%s, by channel", JOB, told[name], out, name)
    delete(labels, labelled, regions)
    return told


def report(spark: SparkSession, out: str) -> DataFrame:
    """The regions as they stand."""
    kinds = "rx int, ry int, area double, points long, clustered long, clustered_share double, clusters long, points_per_area double, clusters_per_area double, median_points double, channel string"
    return spark.read.schema(kinds).parquet(f"{out}/regions")


if __name__ == "__main__":
    sys.exit(main(JOB, run, {"points": "table of localisations", "out": "folder of the output"}))
