"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_folder


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/punctaria/components-{uuid.uuid4().hex}"


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(id, component): each endpoint with the smallest id reachable from it.

    ``edges`` is an undirected edge table; self-loops and nulls are ignored, an empty table gives no rows.
    Each round sends every node's larger neighbours, then its smaller ones, to its smallest neighbour, so
    that the number of rounds grows with the logarithm of the diameter. Minima are combined before the shuffle, and a
    round is written to the shared checkpoint folder, so a lost executor costs no earlier round.
    """
    spark = edges.sparkSession
    folder = _folder(spark)
    x, y = F.col(a), F.col(b)
    now = edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()

    def write(df: DataFrame, k: int) -> tuple[DataFrame, tuple]:
        df.write.parquet(f"{folder}/{k}")
        out = spark.read.schema(df.schema).parquet(f"{folder}/{k}")
        row = out.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return out, tuple(row)

    def drop(k: int) -> None:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    now, mark = write(now, 0)
    for k in range(1, max_rounds + 1):
        if mark[0] == 0:
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        after, seen = write(small, k)
        drop(k - 1)
        now, stable = after, seen == mark
        mark = seen
        if stable:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    member = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = member.unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out._punctaria_path = folder  # what ``storage.delete`` deletes
    return out
