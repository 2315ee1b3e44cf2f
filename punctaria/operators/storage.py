"""Tables written to the folder that all executors share, which cuts lineage and survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the session's checkpoint folder. Where neither is set, a temporary folder if one machine runs all; on a cluster
    executors could not see each other's files there, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="punctaria-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/punctaria/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._punctaria_path = path
    return out


def delete(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote; only once nothing reads it any more."""
    for df in tables:
        paths = getattr(df, "_punctaria_path", None) or ()
        for path in (paths,) if isinstance(paths, str) else paths:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
