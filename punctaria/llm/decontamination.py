"""Benchmark decontamination by a prefix-filtered set join.

Native DataFrame operator. Each window of an item is a set of positioned tokens whose containment in a
document must be total, so one token of it, its rarest by document frequency over the whole corpus, is a
sufficient prefix. The documents' tokens meet only those prefixes; the position of the token bounds where the window must lie in the
document, its length whether it fits, and an exact comparison of the words there confirms it. Only confirmed windows
are shuffled.

Windows are broadcast in blocks of at most ``BLOCK_WINDOWS`` rows, each with a pass over the documents, so what is
broadcast has a fixed bound whatever the size of the benchmark.

Defined results: a null or wordless document has no words and is clean; null or wordless items have no window; an
item shorter than a window is one window; items with equal windows each count; documents with equal id and text are judged
alike and those with equal id and different text apart; empty tables give clean documents or no rows; other columns pass through
``keep_clean`` unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_ascii, materialise

WINDOW = 10
BLOCK_WINDOWS = 100_000
BROADCAST_IDS = 500_000
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD), "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows (w, item_ids), item ids as sorted strings."""
    ws = items.select(F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - size + 1, F.lit(1)))
    each = ws.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, size))).alias("w"))
    return each.groupBy("w").agg(F.array_sort(F.collect_set(F.coalesce("item_id", F.lit("")))).alias("item_ids"))


def _with_prefix(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Windows with their rarest token and its first place in the window; document frequencies cover every document."""
    tokens = found.select(F.explode("w").alias("t")).distinct()
    # The tokens of at most BLOCK_WINDOWS windows: bounded.
    frequency = docs.select(F.explode(F.array_distinct(item_words(F.col("text")))).alias("t")).join(F.broadcast(tokens), "t").groupBy("t").count()
    each = found.select("w", "item_ids", F.posexplode("w").alias("off", "t")).join(F.broadcast(frequency), "t", "left")  # one row a token
    best = each.groupBy("w").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("off"), F.col("t"))).alias("p"), F.first("item_ids").alias("item_ids"))
    # A token that no document has rules its windows out.
    return best.filter("p.n > 0").select("w", "item_ids", F.col("p.off").alias("off"), F.col("p.t").alias("t"))


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, h, spans, item_ids), written, of each document with an occurring window; h is the text's hash."""
    all_windows = materialise(windows(items, size), "benchmark-windows")
    n = all_windows.count()
    blocks = max(1, -(-n // BLOCK_WINDOWS))
    parts, prefixes = [], []
    for k in range(blocks):
        block = all_windows.filter(F.pmod(F.xxhash64("w"), F.lit(blocks)) == k) if blocks > 1 else all_windows
        prefix = materialise(_with_prefix(block, docs), "benchmark-prefixes")
        prefixes.append(prefix)
        ws = docs.select("doc_id", F.xxhash64("text").alias("h"), item_words(F.col("text")).alias("ws"))
        each = ws.select("doc_id", "h", "ws", F.posexplode("ws").alias("pos", "t"))
        met = each.join(F.broadcast(prefix), "t").withColumn("start", F.col("pos") - F.col("off"))
        met = met.filter((F.col("start") >= 0) & (F.col("start") + F.size("w") <= F.size("ws")))
        met = met.filter(F.slice("ws", F.greatest(F.col("start"), F.lit(0)) + 1, F.size("w")) == F.col("w"))
        parts.append(met.select("doc_id", "h", F.struct("start", F.size("w").alias("len")).alias("span"), "item_ids"))
    met = reduce(DataFrame.unionAll, parts)
    out = met.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    out = materialise(out, "benchmark-hits")
    discard(all_windows, *prefixes)
    return out


def _covered(spans: Column) -> Column:
    """Number of positions in a union of (start, len) spans sorted by start."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    return F.aggregate(spans, zero, lambda acc, s: F.struct(F.greatest(acc["upto"], s["start"] + s["len"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(acc["upto"], s["start"]))).alias("n")))["n"]


def judge(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids) of each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    found = hits(docs, items, size).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), _covered(F.col("spans")).cast("long").alias("n_hit"), "item_ids")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["__id"]) & (rows["h"] == found["__h"]), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), ids.alias("item_ids"))


def keep_clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without any window of an item."""
    found = hits(docs.select("doc_id", "text"), items, size).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    side = F.broadcast(found) if found.count() <= BROADCAST_IDS else found  # more are shuffled
    return docs.join(side, docs["doc_id"].eqNullSafe(found["__id"]) & (F.xxhash64(docs["text"]) == found["__h"]), "left_anti").select(*docs.columns)


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return judge(docs, items).drop("item_ids")
