"""Incremental intake of text exports: what each holds, and counts by class and source.

    python -m jobs.text_intake TEXTS OUT CHECKPOINT [--config FILE]

Reads the Parquet files under TEXTS (a folder, or a pattern of folders and files) that no earlier run has read (a file stream with a checkpoint, which ends when nothing is new), finds lines of numbers in every whole text as the point readers
do, and writes under OUT:

- ``items``: a row for each text, by batch and class;
- ``counts``: sums of each batch by class, source and size;
- ``totals``: sums over all batches, by class, made anew from ``counts`` alone.

A batch writes its own partitions and replaces them if it runs again (dynamic partition overwrite), so a run that failed halfway and is started again, or one with nothing new, leaves
every text once.

Defined results: a null text has no lines, characters or numbers, an empty one has one line; a null or empty class or source is called ``none``; rows count one by one, repeated ones again; columns
that are not in the schema are not read.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import configuration, log, main
from punctaria.functions.scalar import data_lines, numbers_in

JOB = "text_intake"
ITEMS = "id long, source string, size int, n_chars long, n_lines long, n_data_lines long, n_numbers long, batch long, class string"


def measured(texts: DataFrame, settings: dict) -> DataFrame:
    """A row of measures for each text. ``size`` is the number of decimal digits of its number of characters."""
    text = F.col(settings["text"])
    named = lambda c: F.coalesce(F.nullif(F.col(settings[c]), F.lit("")), F.lit("none")).alias(c)
    chars = F.coalesce(F.char_length(text), F.lit(0)).cast("long")
    lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    return texts.select(
        F.col(settings["id"]).cast("long").alias("id"), named("class"), named("source"), F.char_length(chars.cast("string")).alias("size"), chars.alias("n_chars"), lines.alias("n_lines"),
        F.size(data_lines(text)).cast("long").alias("n_data_lines"), F.size(numbers_in(text)).cast("long").alias("n_numbers"),
    )


def summed(items: DataFrame, *keys: str) -> DataFrame:
    """Sums of items, or of such sums."""
    if "n_lines" in items.columns:
        sums = [F.count("*").alias("texts"), F.sum("n_lines").alias("lines"), F.sum("n_data_lines").alias("data_lines"), F.sum("n_numbers").alias("numbers")]
    else:
        sums = [F.sum(c).alias(c) for c in ("texts", "lines", "data_lines", "numbers")]
    return items.groupBy(*keys).agg(*sums)


def run(spark: SparkSession, texts_path: str, out: str, checkpoint: str, settings: dict | None = None) -> dict[str, int]:
    """Take in the text files that are new since the last run. Returns what it logs: batches, texts read and rows of totals written."""
    settings = settings or configuration(JOB)
    stream = spark.readStream.schema(settings["schema"]).option("maxFilesPerTrigger", settings["files_a_batch"]).parquet(texts_path)
    told = {"batches": 0, "texts": 0, "totals": 0}

    def take(batch: DataFrame, number: int) -> None:
        def put(df: DataFrame, name: str, *by: str) -> None:
            df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(f"{out}/{name}")

        put(batch, "items", "class")
        own = items(batch.sparkSession, out).filter(F.col("batch") == number)
        put(summed(own, "class", "source", "size"), "counts")
        told["batches"] += 1
        told["texts"] += (n := own.count())
        log.info("%s: batch %d of %s: read %d texts, wrote them to %s/items, by class", JOB, number, texts_path, n, out)

    query = measured(stream, settings).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if not told["batches"]:
        log.info("%s: nothing new under %s", JOB, texts_path)
    sums = totals_of(spark, out)
    if sums is not None:
        sums.write.mode("overwrite").partitionBy("class").parquet(f"{out}/totals")
        told["totals"] = spark.read.parquet(f"{out}/totals").count()
        log.info("%s: wrote %d rows to %s/totals, by class", JOB, told["totals"], out)
    return told


def items(spark: SparkSession, out: str) -> DataFrame:
    """All texts taken in so far."""
    return spark.read.schema(ITEMS).parquet(f"{out}/items")


def totals_of(spark: SparkSession, out: str) -> DataFrame | None:
    """Sums of all batches; None before the first one."""
    from pyspark.errors import AnalysisException

    kinds = "class string, source string, size int, texts long, lines long, data_lines long, numbers long, batch long"
    try:
        return summed(spark.read.schema(kinds).parquet(f"{out}/counts"), "class", "source", "size")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


if __name__ == "__main__":
    sys.exit(main(JOB, run, {"texts": "folder of Parquet files of texts, or a pattern", "out": "folder of the output", "checkpoint": "folder of the stream's checkpoint"}))
