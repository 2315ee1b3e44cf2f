"""Helpers shared by the corpus operators: shared storage, words, hashes, held-out folds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern: a word is a longest run of other characters.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, which a cluster has to set; a temporary one where one machine runs all."""
    from punctaria.operators.components import shared_folder

    return shared_folder(spark)


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/punctaria/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._punctaria_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these; only once nothing reads it any more."""
    for df in written:
        path = getattr(df, "_punctaria_path", None)
        if path is not None:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def tidy(run):
    """A function over Arrow batches that gives memory back when a task ends: Spark keeps its Python workers for later tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return wrapped


def small_batches(spark: SparkSession) -> None:
    """Arrow batches that stay small where rows hold whole texts. Plans take the setting when they run, so it stays set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def words(text: Column) -> Column:
    """Array of words of a text, empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


#: What lower() might change besides A-Z; beyond Latin, all but the blocks without case, as Unicode versions differ.
_OTHER_CASE = r"[[\p{javaUpperCase}\p{javaTitleCase}]&&[^A-Z]]|[\x{250}-\x{2FFF}\x{A000}-\x{10FFFF}]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else. lower() is many times faster than translate() and gives the same where no other letter has case."""
    return F.when(text.rlike(_OTHER_CASE), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
