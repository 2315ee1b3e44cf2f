"""Near-duplicate detection by a signature-coordinate inverted join.

1. Each document becomes its set of word shingles, a key of the set and a MinHash signature. Documents with equal sets
   are one class from here on, found by a map-side combined minimum, so copies are never expanded.
2. Classes are posted under their coordinate-value pairs. Pairs that only one class has are skipped. Two classes that agree
   on at least ``matches`` coordinates share one of the rarest ``s - matches + 1`` of a class's ``s`` shared
   pairs, so only that prefix is kept.
3. In each posting list the most widely shared class is the centre, and the others meet it alone: collisions of their
   signatures are counted, those below ``matches`` dropped, and the rest confirmed on full sets. Components of the confirmed links
   settle most lists.
4. For lists that still hold several components the rest is done exactly on shingles: a class can only link to another component
   if enough of its shingles occur there, and such pairs share one of its rarest shingles (prefix filter on
   the full sets; at the first one they share, what is left of either list bounds what they can share at all). Those pairs too are confirmed on full sets.

So every pair is either within a component already, confirmed, or ruled out by a bound; list sizes are never capped. A pair at the
threshold itself is missed by step 2 with a probability of ``MISS`` at most.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; rows of equal ``doc_id`` are one document;
a null ``doc_id`` is linked with nothing, has a null component and is kept; ties go to the smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctaria.operators.components import connected_components

from .common import discard, materialise, small_batches, tidy
from .hashing import WordHashes, shingle_hashes

SHINGLE, PERCENT, COORDINATES, MISS = 5, 80, 32, 2e-5
#: The similarity that op8 is asked for.
QUERY_PERCENT = 85
#: Ids broadcast to pick candidate texts; above it the join shuffles instead.
BROADCAST_IDS = 500_000
_CHUNK = 200_000


def match_threshold(percent: int, coordinates: int, miss: float = MISS) -> int:
    """The largest number of matching coordinates that a pair at the threshold falls short of with probability ``miss`` at most."""
    p, below, m = percent / 100, 0.0, 0
    while m < coordinates and (below := below + math.comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)) <= miss:
        m += 1
    return max(1, m)


def _constants(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**63, k, np.uint64), rng.integers(0, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, size: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig) of each row; the key has 128 bits, coordinates have 32."""

    def run(batches):
        xors, odds = _constants(coordinates)
        cache = WordHashes()

        def flush(sets):
            full = [s for s in sets if len(s)]
            sigs = [b""] * len(sets)
            if full:
                x, at = np.concatenate(full), np.cumsum([0, *map(len, full[:-1])])
                rows = np.stack([(np.minimum.reduceat((x ^ c) * a, at) >> np.uint64(32)).astype(np.uint32) for c, a in zip(xors, odds, strict=True)], 1).view(np.int32)
                it = iter(rows.tolist())
                sigs = [next(it) if len(s) else [] for s in sets]
            else:
                sigs = [[] for _ in sets]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            return [len(s) for s in sets], keys, sigs

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n, keys, sigs, sets, held = [], [], [], [], 0
            for t in texts:
                s = shingle_hashes(cache.of((t.as_py() or b"").lower().split()), size)
                sets.append(s)
                held += len(s)
                if held >= _CHUNK:
                    for to, new in zip((n, keys, sigs), flush(sets), strict=True):
                        to.extend(new)
                    sets, held = [], 0
            for to, new in zip((n, keys, sigs), flush(sets), strict=True):
                to.extend(new)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "set_key", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_shingles long, set_key binary, sig array<int>")


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, s) of the documents whose ids are in ``ids`` (id); s is the sorted set of shingle hashes."""

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(cache.of((t.as_py() or b"").lower().split()), size).view(np.int64) for t in batch.column(1)]
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "s"])

    small = ids.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(F.broadcast(ids) if small else ids, "id", "left_semi")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(tidy(run), f"id {kind}, s array<bigint>")
    return out


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those similar on full sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", shared.alias("k"), (F.size("sa") + F.size("sb")).alias("n"))
    return both.filter(100 * F.col("k") >= percent * (F.col("n") - F.col("k"))).select("a", "b")


def _near(n1, n2, percent: int):
    """Length bound: sizes too far apart cannot reach the similarity."""
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT, size: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """Confirmed links (a, b) between class representatives, enough of them to connect every linked pair."""
    matches = match_threshold(percent, coordinates)
    posts = classes.select("rep", F.posexplode("sig").alias("k", "v"))
    common = materialise(posts.groupBy("k", "v").agg(F.count("*").alias("f")).filter("f > 1"), "common-coordinates")
    tokens = posts.join(common, ["k", "v"]).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("f", "k", "v"))).alias("t")).filter(F.size("t") >= matches)
    spread = F.aggregate("t", F.lit(0.0), lambda s, x: s + F.log(x["f"].cast("double")))
    kept = tokens.select("rep", spread.alias("spread"), F.slice("t", 1, F.size("t") - matches + 1).alias("p"))
    lists = materialise(kept.join(classes.select("rep", "n", "sig"), "rep").select("rep", "n", "sig", "spread", F.explode("p").alias("p")).select(F.col("p.k").alias("k"), F.col("p.v").alias("v"), "rep", "n", "sig", "spread"), "postings")

    centres = lists.groupBy("k", "v").agg(F.max(F.struct("spread", F.negative("rep").alias("order"), "rep", "n", "sig")).alias("c"), F.count("*").alias("size")).filter("size > 1")
    met = lists.join(centres.select("k", "v", F.col("c.rep").alias("a"), F.col("c.n").alias("na"), F.col("c.sig").alias("sa")), ["k", "v"]).filter("rep != a")
    agree = F.size(F.filter(F.zip_with("sig", "sa", lambda x, y: x == y), lambda same: same))
    star = met.filter(_near(F.col("n"), F.col("na"), percent) & (agree >= matches)).select("a", F.col("rep").alias("b")).distinct()
    star = materialise(star, "star-pairs")

    candidates = materialise(lists.join(centres.select("k", "v"), ["k", "v"], "left_semi").select(F.col("rep").alias("id")).distinct(), "candidates")
    sets = materialise(shingle_sets(docs, candidates, size), "candidate-sets")
    first = materialise(_confirm(star, sets, percent), "star-links")
    stars = connected_components(first)
    members = materialise(stars, "star-components")

    # What is left: lists that hold several components.
    placed = lists.select("k", "v", F.col("rep").alias("id")).join(members, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("k", "v").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("k", "v")
    open_ids = placed.join(mixed, ["k", "v"], "left_semi").select("id", "component").distinct()
    rest = materialise(sets.join(open_ids, "id").select("id", "component", F.size("s").alias("n"), F.explode("s").alias("g")), "open-shingles")
    # Shingles seen in more than one component, rarest first. Written, as a join of two plain exchanges is one that Spark can split at a hot key.
    across = materialise(rest.groupBy("g").agg(F.count("*").alias("f"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("g", "f"), "open-across")
    fewest = F.ceil(F.col("n") * F.lit(percent) / 100)
    able = rest.join(across, "g").groupBy("id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("t")).filter(F.size("t") >= fewest)
    prefix = able.select("id", "component", "n", F.size("t").alias("s"), F.posexplode(F.slice("t", 1, (F.size("t") - fewest + 1).cast("int"))).alias("i", "p"))
    prefix = materialise(prefix.select("id", "component", "n", (F.col("s") - F.col("i")).alias("left"), F.col("p.g").alias("g")), "open-prefixes")
    p, q = prefix.alias("p"), prefix.alias("q")
    # At the first shingle that a pair shares, no more can be shared than what is left of either list from there.
    reach = (100 + percent) * F.least("p.left", "q.left") >= percent * (F.col("p.n") + F.col("q.n"))
    cross = p.join(q, (F.col("p.g") == F.col("q.g")) & (F.col("p.component") < F.col("q.component")) & _near(F.col("p.n"), F.col("q.n"), percent) & reach)
    cross = cross.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    second = materialise(_confirm(cross, sets, percent), "open-links")
    out = materialise(first.unionByName(second), "links")
    discard(rest, across, prefix, common, lists, star, candidates, sets, stars, members, first, second)
    return out


def components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = materialise(signatures(docs.select("doc_id", "text"), size, coordinates), "signatures")
    classes = rows.filter("doc_id is not null and n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = materialise(classes, "classes")
    found = links(docs, classes, percent, size, coordinates)
    members = connected_components(found)
    discard(found)
    named = classes.select("set_key", "rep").join(members.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    out._reads = (rows, classes, members)
    return out


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of ``docs``.

    Of rows with equal ids, which are one document, the one with the smallest text stays, and of equal texts one.
    """
    found = components(docs, percent)
    drop = materialise(found.filter("not kept").select(F.col("doc_id").alias("__drop")).distinct(), "near-copies")
    discard(*found._reads)
    side = F.broadcast(drop) if drop.count() <= BROADCAST_IDS else drop
    kept = docs.join(side, docs["doc_id"] == F.col("__drop"), "left_anti").select(*docs.columns)
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__n")).filter("__n > 1").select(F.col("doc_id").alias("__again"))
    again = materialise(again, "repeated-ids")
    if not again.take(1):
        return kept
    order = Window.partitionBy("doc_id").orderBy("text")
    one = kept.join(again, kept["doc_id"] == F.col("__again"), "left_semi").withColumn("__r", F.row_number().over(order)).filter("__r = 1")
    return kept.join(again, kept["doc_id"] == F.col("__again"), "left_anti").unionByName(one.select(*docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return components(docs, QUERY_PERCENT)
