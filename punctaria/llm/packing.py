"""Optimal length buckets and token-budget batches.

The global histogram of token counts is one combined count; ``u`` different lengths need u * (u + 1) / 2 tokens at least, so it has few rows on any corpus.
Dynamic programming over it chooses the bucket boundaries that pad least, exactly whatever the number of lengths or the longest of them. Inside a bucket every batch
holds as many documents as its token budget has room for at the bucket's length, at least one.

A document's place in its bucket is counted in two steps: rows are dealt to cells of a bucket by a hash, numbered inside a cell, and
cells are offset by the sums of those before. Cells grow in number with the rows, so no task holds a bucket.

Defined results: null and empty texts have no tokens and are in the first bucket at the least length, which is 1; repeated rows are each packed, numbered in any
order among themselves; equal lengths always share a bucket; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, tidy
from .lengths import VOCABULARY, counter, vocabulary

BUCKETS, BUDGET, CELL_ROWS = 16, 65_536, 50_000
#: Cuts that are compared at a time, or those of one length where they are more; a matter of memory, not of results.
MAX_POINTS = 20_000


def _layer(best: np.ndarray, lengths: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least padded sizes, last cuts or -1) of the first j+1 lengths with one bucket more than in ``best``."""
    new, arg = best.copy(), np.full(len(best), -1)
    lo, hi, a, b = (np.array([x]) for x in (0, len(best) - 1, 0, len(best) - 1))
    while len(lo):
        j = (lo + hi) // 2
        width, at = np.maximum(np.minimum(b, j - 1) - a + 1, 0), a.copy()
        ends, i = np.cumsum(width), 0
        while i < len(j):
            stop = max(i + 1, int(np.searchsorted(ends, ends[i] - width[i] + MAX_POINTS, "right")))
            some = i + np.flatnonzero(width[i:stop])
            i = stop
            if not len(some):
                continue
            w = width[some]
            first = np.cumsum(w) - w
            k, to = np.arange(w.sum()) + np.repeat(a[some] - first, w), np.repeat(j[some], w)
            total = best[k] + lengths[to] * (number[to + 1] - number[k + 1])
            least = np.minimum.reduceat(total, first)
            places = np.flatnonzero(total == np.repeat(least, w))
            at[some] = k[places[np.searchsorted(places, first)]]
            won = some[least < new[j[some]]]
            new[j[won]], arg[j[won]] = least[least < new[j[some]]], at[won]
        lo, hi, a, b = np.concatenate([lo, j + 1]), np.concatenate([j - 1, hi]), np.concatenate([a, at]), np.concatenate([at, b])
        left = lo <= hi
        lo, hi, a, b = lo[left], hi[left], a[left], b[left]
    return new, arg


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over sorted lengths such that the padding up to them is least.

    cost(i, j) = length[j] * number(i..j) - sum(i..j) meets the quadrangle inequality, so the best last cut moves only forward and each layer is found by
    divide and conquer, a level of midpoints at a time.
    """
    u = len(lengths)
    if not u:
        return []
    if u <= buckets:
        return [int(x) for x in lengths]
    number = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    best = lengths * number[1:]  # one bucket: padded size of the first j+1 lengths
    cuts = []
    for _ in range(1, buckets):
        best, arg = _layer(best, lengths, number)
        cuts.append(arg)
    out, j = [], u - 1
    for arg in reversed(cuts):
        out.append(j)
        if arg[j] < 0:
            continue
        j = int(arg[j])
    out.append(j)
    return sorted({int(lengths[x]) for x in out})


def token_counts(docs: DataFrame, vocab: bytes) -> DataFrame:
    """(doc_id, n_tokens) of each row; 0 for null and empty texts."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        count = counter(vocab)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t or "") for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long")


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch, place) for rows (doc_id, n_tokens); batches are numbered inside a bucket."""
    rows = lengths.select("doc_id", "n_tokens", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(1)).cast("long").alias("__n"))
    histogram = rows.groupBy(F.col("__n").alias("l")).count().toPandas().sort_values("l")
    bounds = optimal_boundaries(histogram["l"].to_numpy(), histogram["count"].to_numpy(), buckets)
    bucket, bound = F.lit(0), F.lit(bounds[-1] if bounds else 1)
    for k in range(len(bounds) - 2, -1, -1):
        bound = F.when(F.col("__n") <= bounds[k], F.lit(bounds[k])).otherwise(bound)
    for k in range(len(bounds) - 1):
        bucket = bucket + (F.col("__n") > bounds[k]).cast("int")
    cells = max(1, -(-int(histogram["count"].sum()) // CELL_ROWS))
    placed = rows.select("doc_id", "n_tokens", bucket.alias("bucket"), bound.cast("long").alias("bucket_length"), F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(cells)).cast("int").alias("cell"))
    sizes = placed.groupBy("bucket", "cell").count()
    offsets = sizes.select("bucket", "cell", (F.sum("count").over(Window.partitionBy("bucket").orderBy("cell")) - F.col("count")).alias("before"))
    numbered = placed.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("doc_id", "n_tokens")) - 1)
    out = numbered.join(offsets, ["bucket", "cell"]).withColumn("rank", F.col("before") + F.col("r"))
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket_length")), F.lit(1)).cast("long")
    return out.select("doc_id", "n_tokens", "bucket", "bucket_length", F.floor(F.col("rank") / room).cast("long").alias("batch"), F.pmod(F.col("rank"), room).cast("int").alias("place"))


def query(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    spark = docs.sparkSession
    return pack(materialise(token_counts(docs.select("doc_id", "text"), vocabulary(spark, vocabulary_path)), "token-counts"))
