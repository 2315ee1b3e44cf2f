"""The driver tables seen as points, phase-like rows and labels, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pid"), F.col("value").alias("x"), (F.col("user_id").cast("double") * 3.2).alias("y"), "event_type")


def phase_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("threshold"), F.col("l_discount").alias("sigma"), F.when(F.col("l_returnflag") == "A", "incell").otherwise("outcell").alias("type"), F.col("l_quantity").alias("clusterSize"))


def optima_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 17).cast("int").alias("threshold"), (F.col("o_orderkey") % 5 + 0.5).cast("double").alias("sigma"), F.col("o_totalprice").alias("similarityScore"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labelings of the points: columns of x by width 8 in bands of y against event types by band; low ones are noise."""
    p = points(spark, sf_dir)
    band = F.floor(F.col("y") / 64)
    label = F.when(F.col("x") < 1, -1).otherwise(band * 100 + F.floor(F.col("x") / 8)).cast("int")
    truth = F.when(F.col("x") < 2, -1).otherwise(band * 100 + F.floor((F.col("x") + 2) / 9)).cast("int")
    return p.select("pid", "x", "y", label.alias("label"), truth.alias("truth"))


def counts_by_type(spark, sf_dir):
    """The numbers of events of each type, as many as there are types, in order."""
    return sorted(float(r["count"]) for r in table(spark, sf_dir, "events").groupBy("event_type").count().collect())


# The same in SQL, as the start of a WITH clause.
POINTS = "points AS (SELECT event_id AS pid, value AS x, CAST(user_id AS DOUBLE) * 3.2e0 AS y, event_type FROM events)"
PHASE = "phase AS (SELECT l_linenumber AS threshold, l_discount AS sigma, CASE WHEN l_returnflag = 'A' THEN 'incell' ELSE 'outcell' END AS type, l_quantity AS \"clusterSize\" FROM lineitem)"
OPTIMA = "optima AS (SELECT o_orderkey AS idx, CAST(o_custkey % 17 AS INTEGER) AS threshold, CAST(o_orderkey % 5 AS DOUBLE) + 0.5e0 AS sigma, o_totalprice AS \"similarityScore\" FROM orders)"
LABELLED = f"{POINTS}, labelled AS (SELECT pid, x, y, CAST(CASE WHEN x < 1 THEN -1 ELSE floor(y / 64) * 100 + floor(x / 8) END AS INTEGER) AS label, CAST(CASE WHEN x < 2 THEN -1 ELSE floor(y / 64) * 100 + floor((x + 2) / 9) END AS INTEGER) AS truth FROM points)"
