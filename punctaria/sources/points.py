"""Readers and writers of point tables and result tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

# Parameters of a segmentation where its file is missing.
SEGMENTATION_DEFAULTS = {"quantile_of_nonzero": True, "intensity_quantile_cutoff": 0.95, "sigma_gaussian_filter": 5, "N_x": 500, "pad_cell_border": 20}


def read_text_points(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated x and y, '#' starts a comment; other columns are left out. Adds the file's path."""
    value = F.trim(F.regexp_replace("value", "#.*$", ""))
    parts = F.split(value, r"\s+")
    return spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).filter(value != "").select(parts[0].cast("double").alias("x"), parts[1].cast("double").alias("y"), "file")


def read_points(spark: SparkSession, path: str, fmt: str | None = None, scale: float = 1.0) -> DataFrame:
    """Distinct points in lexicographic order with that order as ``pid``, times ``scale``. Formats: text, csv, tsv, parquet, hdf5."""
    fmt = fmt or {"csv": "csv", "tsv": "tsv", "parquet": "parquet", "hdf5": "hdf5", "h5": "hdf5"}.get(path.rsplit(".", 1)[-1], "text")
    if fmt == "text":
        raw = read_text_points(spark, path)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    elif fmt == "hdf5":
        raw = read_hdf5_points(spark, path)
    else:
        raw = spark.read.csv(path, sep="\t" if fmt == "tsv" else ",", header=True, inferSchema=False)
        raw = raw.select(F.col(raw.columns[0]).cast("double").alias("x"), F.col(raw.columns[1]).cast("double").alias("y"))
    return with_pid(raw.select("x", "y")).select("pid", (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y"))


def read_hdf5_points(spark: SparkSession, path: str, dataset: str = "locs") -> DataFrame:
    """Fields x and y of a compound dataset; needs h5py on the executors."""

    def run(frames):
        import io

        import h5py
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                with h5py.File(io.BytesIO(content), "r") as f:
                    yield pd.DataFrame({"x": f[dataset]["x"], "y": f[dataset]["y"]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "x double, y double")


def with_pid(points: DataFrame) -> DataFrame:
    """Distinct points numbered in lexicographic order."""
    from punctaria.operators.ranks import ranked

    return ranked(points.distinct(), "x", "y", name="pid").select("pid", *points.columns)


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """Space separated x and y without a header."""
    return spark.read.csv(path, sep=" ", schema=POINT)


def read_csv_guarded(spark: SparkSession, path: str, most: int = 20_000) -> DataFrame | None:
    """First two columns of a comma CSV; None if it has ``most`` rows or more."""
    raw = spark.read.csv(path, header=False)
    out = raw.select(F.col(raw.columns[0]).cast("double").alias("x"), F.col(raw.columns[1]).cast("double").alias("y"))
    return out if out.limit(most).count() < most else None


def read_table(spark: SparkSession, path: str, delimiter: str = "\t", columns: list[int] | None = None, scale: float = 1.0, scaled: tuple[int, ...] = ()) -> DataFrame:
    """Delimited table with one header row; columns by position, some of them times ``scale``."""
    raw = spark.read.csv(path, sep=delimiter, header=True)
    names = [raw.columns[i] for i in columns] if columns is not None else raw.columns
    return raw.select(*((F.col(f"`{n}`").cast("double") * (scale if raw.columns.index(n) in scaled else 1.0)).alias(n) for n in names))


def read_series_table(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A headed table of results whose columns may be text: each column as a number if all of its values are, else as it stands."""
    return spark.read.csv(path, sep=delimiter, header=True, inferSchema=True, enforceSchema=False)


def read_number_lists(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, v): the numbers of each line of text files that has any, in order; lines are numbered from 0 within a file, which is read whole."""
    from punctaria.functions.scalar import numbers_in

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = texts.select("file", F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return lines.select("file", "line", numbers_in(F.col("value")).alias("v")).filter(F.size("v") > 0)


def read_partitioned_points(spark: SparkSession, pattern: str) -> DataFrame:
    """One data set per file: x, y and the number in the file's name as ``tid``, which sorts naturally."""
    return read_text_points(spark, pattern).withColumn("tid", F.regexp_extract("file", r"(\d+)\.[A-Za-z]+$", 1).cast("int")).select("tid", "x", "y")


def read_fixed_width(spark: SparkSession, path: str, shape_path: str, dtype: str = "<f8", rows_a_task: int = 100_000) -> DataFrame:
    """(row, v) of a binary matrix whose [rows, columns] a JSON file gives. Tasks read ranges of rows, each by one seek."""
    import numpy as np
    import pyarrow as pa

    n, width = json.loads(spark.read.text(shape_path, wholetext=True).first()[0])
    stride = width * np.dtype(dtype).itemsize

    def run(batches):
        from pyarrow import fs as pafs

        store, name = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for start in batch.column(0).to_pylist():
                m = min(rows_a_task, n - start)
                with store.open_input_file(name) as f:
                    f.seek(start * stride)
                    v = np.frombuffer(f.read(m * stride), dtype).astype(float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * width, pa.int32()), pa.array(v))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + m)), lists], ["row", "v"])

    tasks = max(1, -(-n // rows_a_task))
    return spark.range(0, n, rows_a_task, numPartitions=tasks).mapInArrow(run, "row long, v array<double>")


def append_records(df: DataFrame, path: str) -> None:
    """Add rows to a growing set of records."""
    df.write.mode("append").parquet(path)


def read_records(spark: SparkSession, path: str, condition: str | None = None) -> DataFrame:
    """All records that were appended, or those that meet a condition, which the scan sees."""
    out = spark.read.parquet(path)
    return out if condition is None else out.filter(condition)


def read_parameters(path: str, defaults: dict | None = None) -> dict:
    """A JSON parameter file over defaults; the defaults alone if it is missing."""
    try:
        with open(path) as f:
            return (defaults or {}) | json.load(f)
    except FileNotFoundError:
        if defaults is None:
            raise
        return dict(defaults)


def read_roi_text(spark: SparkSession, path: str, flip_from: float | None = None) -> DataFrame:
    """ROI vertices, tab separated; y counted from ``flip_from`` downwards if given."""
    raw = spark.read.csv(path, sep="\t", schema=POINT)
    return raw if flip_from is None else raw.withColumn("y", F.lit(float(flip_from)) - F.col("y"))


def ring_json(vertices: DataFrame) -> DataFrame:
    """One closed ring [[x, y], ...] as JSON from ordered vertices (i, x, y)."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.array(p["x"], p["y"]))
    return vertices.agg(ring.alias("ring")).select(F.to_json(F.concat("ring", F.slice("ring", 1, 1))).alias("json"))


def clean_log(log: DataFrame, id_column: str = "FileID") -> DataFrame:
    """Rows of a log without repeated header lines, all columns but the id as numbers."""
    kept = log.filter(~F.col(id_column).contains(id_column))
    return kept.select(id_column, *(F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in log.columns if c != id_column))


def name_parts(name, pattern: str = r"[,_()\-]"):
    """A file name's pieces between separators."""
    return F.split(name, pattern)


def values_in_name(name, wanted: dict[str, tuple[int, str]], pattern: str = r"[,_()\-]"):
    """Columns of numbers from a file name: for each, the piece at a position (from 1), if the one before it is the expected token."""
    parts = name_parts(name, pattern)
    return [F.when(F.try_element_at(parts, F.lit(at - 1)) == token, F.try_element_at(parts, F.lit(at)).try_cast("double")).alias(column) for column, (at, token) in wanted.items()]


def queue_slice(files: DataFrame, start: int, finish: int, reverse: bool = False, name: str = "file") -> DataFrame:
    """Files number ``start`` up to but not ``finish`` of a queue in natural order, forwards or backwards, with their number."""
    from punctaria.operators.ranks import ranked

    number = F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("bigint")
    order = [number.desc_nulls_last(), F.desc(name)] if reverse else [number.asc_nulls_last(), F.asc(name)]
    return ranked(files, *order, name="ordinal").filter((F.col("ordinal") >= start) & (F.col("ordinal") < finish))


def matched_regions(regions: DataFrame, files: DataFrame, pattern: str = r"^(.*?)(?:_roi\d*)?\.[A-Za-z]+$") -> DataFrame:
    """Region files joined with the data file of the same name: (stem, file, ...) on what the pattern's group takes of ``region_file`` and ``file``."""
    stem = lambda c: F.regexp_extract(c, pattern, 1).alias("stem")
    return regions.select(stem("region_file"), "*").join(files.select(stem("file"), "*"), "stem")


def write_text(df: DataFrame, path: str, sep: str = " ", comment: str | None = None) -> None:
    """Columns as plain text; a comment line first if given."""
    line = F.concat_ws(sep, *(F.col(c).cast("string") for c in df.columns))
    rows = df.select(line.alias("value"))
    if comment is not None:
        rows = df.sparkSession.createDataFrame([(f"# {comment}",)], "value string").unionAll(rows)
    rows.write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, sep=sep)


def write_fixed(df: DataFrame, path: str, number: str = "%10.3f", sep: str = "\t") -> None:
    """A headed table with every number in one format."""
    kinds = {f.name: f.dataType for f in df.schema}
    cells = [F.format_string(number, F.col(c).cast("double")) if isinstance(kinds[c], T.NumericType) else F.col(c).cast("string") for c in df.columns]
    df.select(*(x.alias(c) for x, c in zip(cells, df.columns, strict=True))).write.mode("overwrite").csv(path, header=True, sep=sep, ignoreLeadingWhiteSpace=False)


def write_settings(path: str, settings: dict) -> None:
    """Settings as JSON, keys in order."""
    with open(path, "w") as f:
        json.dump(settings, f, indent=1, sort_keys=True)


def download(df: DataFrame, path: str, most: int = 1_000_000) -> int:
    """Labelled points as one CSV file on the driver, for tables of at most ``most`` rows. Returns the number of rows."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write_csv writes them from the executors")
    rows.to_csv(path, index=False)
    return len(rows)


def label_matrix(assignment: DataFrame, columns: list) -> DataFrame:
    """Points by clusterings: one column of labels for each idx in ``columns``."""
    return assignment.groupBy("pid").pivot("idx", columns).agg(F.first("label"))


def rectangular(values: DataFrame, group: str, value: str, groups: list) -> DataFrame:
    """Ragged columns side by side, short ones filled with null."""
    numbered = values.withColumn("row", F.row_number().over(Window.partitionBy(group).orderBy(value)))
    return numbered.groupBy("row").pivot(group, groups).agg(F.first(value))


def rectangular_rows(values: DataFrame, group: str, value: str, width: int) -> DataFrame:
    """Ragged rows, one for each group: value_1 to value_``width`` in order, short ones filled with null."""
    lists = values.groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("__l"))
    return lists.select(group, *(F.try_element_at("__l", F.lit(k)).alias(f"value_{k}") for k in range(1, width + 1)))


def pooled(tables: dict[str, DataFrame], name: str = "source") -> DataFrame:
    """Tables one under the other, each row with the name of its own; columns that one lacks are null."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.select(F.lit(k).alias(name), "*") for k, df in tables.items()))


def replicate_table(values: DataFrame, replicate: str, condition: str, value: str, conditions: list) -> DataFrame:
    """One statistic with a row for each replicate and a column for each condition."""
    return values.groupBy(replicate).pivot(condition, conditions).agg(F.first(value, ignorenulls=True))


class Cache:
    """Results kept as Parquet by name and a hash of their parameters; computed once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def get(self, name: str, parameters: dict, compute) -> DataFrame:
        import hashlib

        key = hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:16]
        path = f"{self.folder}/{name}-{key}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            compute().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
