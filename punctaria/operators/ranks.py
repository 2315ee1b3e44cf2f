"""Row numbers over whole tables and large groups, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Groups are numbered within cells of this many leading bits of a hash.
HASH_BITS = 16


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with the row's number, from 0, in an order over the whole table: range partitions are numbered alone and offset by those before."""
    at = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__at": at})
    parts = written(parts, "ranked")
    sizes = parts.groupBy("__part").agg((F.max("__at") + 1).alias("n"))  # one row for each range
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return parts.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def hashed_rank(df: DataFrame, by: tuple[str, ...], key: str, seed: int, name: str = "__r", order: Column | None = None) -> DataFrame:
    """``df`` with the row's number, from 1, within its group in the order of a seeded hash of ``key`` (or of ``order``, a number spread over 64 bits), then of ``key``."""
    h = F.xxhash64(key, F.lit(seed)) if order is None else order
    rows = df.withColumns({"__h": h, "__cell": F.shiftright(h, 64 - HASH_BITS).cast("int")})
    sizes = rows.groupBy(*by, "__cell").agg(F.count("*").alias("__n"))
    before = sizes.select(*by, "__cell", (F.sum("__n").over(Window.partitionBy(*by).orderBy("__cell")) - F.col("__n")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(*by, "__cell").orderBy("__h", key))
    out = rows.withColumn("__at", inner).join(before, [*by, "__cell"])
    return out.withColumn(name, F.col("__before") + F.col("__at")).drop("__h", "__cell", "__before", "__at")
