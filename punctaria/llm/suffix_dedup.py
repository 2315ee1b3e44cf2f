"""Removal of long repeated byte strings by suffix order and previous factors.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere: anywhere (``keep="none"``), or only earlier
(``keep="first"``, order of doc_id, then of position). Sorting the suffixes of a whole corpus in one place is impossible, so:

1. Equal whole texts are found by their hash, with counts combined before the shuffle; one of each class goes on.
2. Anchors: every window of ``length`` bytes names the smallest hash among its ``GRAM``-byte strings. Equal windows name equal
   anchors at equal offsets, so only windows of one anchor have to be compared. Runs of windows with a common anchor make one row.
   Anchors found once are settled.
3. Rows whose whole stretch of bytes is found twice or more are settled by a combined count.
4. What remains are the ends of repeats. One row of each distinct stretch is laid into a block with all others of its anchor; the
   block's suffixes are sorted by prefix doubling up to ``length``. The longest previous factor of a suffix, cut at ``length``, is the longer of
   its common prefixes with the previous and the next suffix in that order that start at a smaller position (its nearest smaller positions on either side); where it has ``length``
   bytes, an earlier copy exists. The same with larger positions gives later copies.
5. Anchors with more than ``GROUP_ROWS`` distinct stretches are dealt over several blocks; the distinct windows of those blocks meet in a
   combined minimum by window hash.

Every step's rows are linear in the bytes, and no step holds the rows of an unbounded key together. Hashes of 64 bits stand for
anchors, stretches and windows of split anchors; windows within a block are compared byte by byte. Rows are told apart by doc_id and a hash of 128 bits of their text.

Defined results: a null or empty text has no bytes and loses none; texts below ``length`` bytes lose none; rows of equal id and text
are copies of each other for ``keep="none"`` and one document for ``keep="first"``; rows of equal id and different text are different
documents; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches, tidy

LENGTH, GRAM = 200, 32
#: Distinct stretches of an anchor in one block, and bytes of a block's suffix array.
GROUP_ROWS, BLOCK_BYTES = 4_500, 1 << 18
BROADCAST_IDS = 500_000
_PIECE_BITS = 20
_PIECE = 1 << _PIECE_BITS
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class _Rolling:
    """Hashes of any stretch of a piece from prefix sums, modulo 2^64, of random byte values times powers of an odd base."""

    def __init__(self, size: int = _PIECE) -> None:
        base, self.size = 0x5851F42D4C957F2D, size
        self.table = np.random.default_rng(7).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = self._powers(base)
        self.inverse = self._powers(pow(base, -1, 2**64))

    def _powers(self, base: int) -> np.ndarray:
        out = np.full(self.size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def sums(self, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.table[b] * self.power[: len(b)], out=out[1:])
        return out


def _window_minima(v: np.ndarray, width: int) -> np.ndarray:
    span, n = 1, len(v) - width + 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[:n], v[width - span : width - span + n])


def _anchors(b: np.ndarray, rolling: _Rolling, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, stretch, lo, hi) of the runs of window starts lo..hi that name the same anchor."""
    found = []
    step = _PIECE - length + 1
    for at in range(0, len(b) - length + 1, step):
        piece = b[at : at + _PIECE]
        sums = rolling.sums(piece)
        n = len(piece) - GRAM + 1
        grams = _mix((sums[GRAM:] - sums[:n]) * rolling.inverse[:n])
        order = (grams & ~np.uint64(_PIECE - 1)) | np.arange(n, dtype=np.uint64)
        pos = (_window_minima(order, length - GRAM + 1) & np.uint64(_PIECE - 1)).astype(np.int64)
        lo = np.concatenate([[0], np.flatnonzero(pos[1:] != pos[:-1]) + 1])
        hi = np.concatenate([lo[1:] - 1, [len(pos) - 1]])
        at_pos = pos[lo]
        shape = ((hi - lo).astype(np.uint64) << np.uint64(32)) | (at_pos - lo).astype(np.uint64)
        stretch = _mix((sums[hi + length] - sums[lo]) * rolling.inverse[lo] + _mix(shape))
        found.append((grams[at_pos], stretch, lo + at, hi + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, tag, tag2, a, c, lo, hi) of all texts of ``docs`` (doc_id, tag, tag2, text)."""

    def run(batches):
        rolling = _Rolling()
        for batch in batches:
            ids, tags, tags2, texts = batch.columns
            of, parts, held = [], [], 0

            def out(of, parts):
                rows = pa.array(np.repeat(np.array(of), [len(p[0]) for p in parts]))
                a, c, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
                return pa.RecordBatch.from_arrays([ids.take(rows), tags.take(rows), tags2.take(rows), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["doc_id", "tag", "tag2", "a", "c", "lo", "hi"])  # noqa: B023

            for i, t in enumerate(texts):
                b = np.frombuffer(t.as_py() or b"", np.uint8)
                if len(b) >= length:
                    of.append(i)
                    parts.append(_anchors(b, rolling, length))
                    held += len(parts[-1][0])
                    if held > 200_000:
                        yield out(of, parts)
                        of, parts, held = [], [], 0
            if parts:
                yield out(of, parts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*ROW, F.col("text").cast("binary")).mapInArrow(tidy(run), f"doc_id {kind}, tag long, tag2 long, a long, c long, lo int, hi int")


def _ranked(high: np.ndarray, bits: int) -> np.ndarray:
    """Dense ranks of keys below 2^(63 - bits): the place goes into the low bits, so that one plain sort does it."""
    mask = np.uint64((1 << bits) - 1)
    keys = np.sort((high << np.uint64(bits)) | np.arange(len(high), dtype=np.uint64))
    value = keys >> np.uint64(bits)
    rank = np.empty(len(high), np.uint64)
    rank[(keys & mask).astype(np.int64)] = np.concatenate([[0], np.cumsum(value[1:] != value[:-1])]).astype(np.uint64)
    return rank


def suffix_ranks(text: np.ndarray, length: int, levels: list | None = None) -> np.ndarray:
    """Rank in suffix order of each suffix of a byte array, cut at ``length`` bytes; equal prefixes have equal ranks.

    Prefix doubling: ranks of a few bytes, then of pairs of ranks of half the width; each (width, ranks) goes into ``levels``.
    """
    n = len(text)
    bits = max(1, n.bit_length())
    width = min(length, (63 - bits) // 8)
    padded = np.concatenate([text, np.zeros(width, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key << np.uint64(8)) | padded[k : n + k]
    rank = _ranked(key, bits)
    levels = [] if levels is None else levels
    levels.append((width, rank))
    while width < length:
        shift = min(width, length - width)
        second = np.zeros(n, np.uint64)
        second[: n - shift] = rank[shift:] + np.uint64(1)
        pair = (rank << np.uint64(bits)) | second
        rank = _ranked(pair, bits) if 3 * bits <= 63 else np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        width += shift
        levels.append((width, rank))
    return rank


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(ranks cut at ``length`` bytes, [(width, ranks cut at that width)]) of prefix doubling, narrow widths first."""
    levels: list[tuple[int, np.ndarray]] = []
    return suffix_ranks(text, length, levels), levels


def common_prefixes(text: np.ndarray, levels: list[tuple[int, np.ndarray]], x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Common prefix, cut at ``length``, of the suffixes that start at x and y, which have at least that many bytes: by ranks of falling widths, then by bytes."""
    out = np.zeros(len(x), np.int64)
    for width, rank in reversed(levels):
        for _ in range(2 if width < length else 1):  # a width is less than twice the next one
            fits = np.flatnonzero(out + width <= length)
            out[fits[rank[x[fits] + out[fits]] == rank[y[fits] + out[fits]]]] += width
    least = levels[0][0]
    for _ in range(least):
        fits = np.flatnonzero(out < length)
        fits = fits[text[x[fits] + out[fits]] == text[y[fits] + out[fits]]]
        if not len(fits):
            break
        out[fits] += 1
    return out


def _nearest_smaller(at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For suffixes that start at ``at``, in suffix order, where ``lcp`` is each one's common prefix with the one before it: the common prefix with the nearest one before it that
    starts at a smaller position, 0 without one.

    Pointers jump over pointers: all between a suffix and where it points start at larger positions than itself, so it may take over the pointer of
    what it points at if that starts later, with the smaller of both common prefixes.
    """
    to, least = np.arange(-1, len(at) - 1), lcp.copy()
    todo = np.arange(len(at))
    while len(todo):
        todo = todo[to[todo] >= 0]
        todo = todo[at[to[todo]] > at[todo]]
        over = to[todo]
        least[todo], to[todo] = np.minimum(least[todo], least[over]), to[over]
    return np.where(to >= 0, least, 0)


def previous_factors(at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, in suffix order, from its start and its common prefix with the suffix before it (the first one's is not read)."""
    lcp = np.concatenate([[0], lcp[1:]])[: len(at)]
    back = np.concatenate([[0], lcp[:0:-1]])[: len(at)]
    return np.maximum(_nearest_smaller(at, lcp), _nearest_smaller(at[::-1], back)[::-1])


def previous_and_next(rank: np.ndarray, common=None, length: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes given in text order: does an earlier, does a later one share a prefix of ``length``?

    ``common`` gives the common prefixes of suffixes at two places of ``rank``; without it equal ranks share 1, others 0.
    """
    bits = max(1, len(rank).bit_length())
    if 2 * bits <= 63:
        keys = np.sort((rank << np.uint64(bits)) | np.arange(len(rank), dtype=np.uint64))
        order = (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
    else:
        order = np.argsort(rank, kind="stable")
    same = rank[order[1:]] == rank[order[:-1]]
    lcp = np.zeros(len(rank), np.int64)
    lcp[1:] = np.where(same, length, 0)
    if common is not None:
        other = np.flatnonzero(~same)
        lcp[1:][other] = common(order[other], order[other + 1])
    earlier, later = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    earlier[order] = previous_factors(order, lcp) >= length
    later[order] = previous_factors(len(rank) - 1 - order, lcp) >= length
    return earlier, later


def _block(table: pa.Table, length: int, keep: str, rolling: _Rolling) -> pa.RecordBatch:
    """(doc_id, tag, tag2, lo, hi, w) of the stretches (doc_id, tag, tag2, lo, bytes, split) of a block.

    w is null for a repeated run of window starts lo..hi; of a split anchor's windows that no earlier one of the block equals it is
    the hash, for the anchor's other blocks.
    """
    order = pc.sort_indices(table, sort_keys=[*((k, "ascending") for k in ROW), ("lo", "ascending")], null_placement="at_start")
    table = table.take(order).combine_chunks()
    held = table["bytes"].combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    begin = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
    text = np.frombuffer(held.buffers()[2], np.uint8)[begin[0] : begin[-1]]
    begin = begin - begin[0]
    runs = np.diff(begin) - length + 1
    first = np.cumsum(runs) - runs
    owner = np.repeat(np.arange(len(runs)), runs)
    inner = np.arange(len(owner)) - first[owner]
    starts = begin[owner] + inner
    rank, levels = suffix_order(text, length)
    earlier, later = previous_and_next(rank[starts], lambda x, y: common_prefixes(text, levels, starts[x], starts[y], length), length)
    gone = earlier | later if keep == "none" else earlier
    head = np.zeros(len(gone) + 1, bool)  # a run ends with its stretch
    head[first] = head[-1] = True
    up = np.flatnonzero(gone & (head[:-1] | ~np.concatenate([[False], gone[:-1]])))
    down = np.flatnonzero(gone & (head[1:] | ~np.concatenate([gone[1:], [False]])))
    lo = table["lo"].to_numpy().astype(np.int64)
    split = table["split"].to_numpy(zero_copy_only=False)
    alone = np.flatnonzero(split[owner] & ~earlier) if split.any() else np.empty(0, np.int64)
    w = np.empty(0, np.int64)
    if len(alone):
        rolling = rolling if len(text) <= rolling.size else _Rolling(len(text))
        sums = rolling.sums(text)
        w = _mix((sums[starts[alone] + length] - sums[starts[alone]]) * rolling.inverse[starts[alone]]).view(np.int64)
    of = np.concatenate([owner[up], owner[alone]])
    where = pa.array(of)
    at = np.concatenate([lo[owner[up]] + inner[up], lo[owner[alone]] + inner[alone]])
    upto = np.concatenate([lo[owner[down]] + inner[down], lo[owner[alone]] + inner[alone]])
    null = np.concatenate([np.ones(len(up), bool), np.zeros(len(alone), bool)])
    cols = [*(table[k].combine_chunks().take(where) for k in ROW), pa.array(at.astype(np.int32)), pa.array(upto.astype(np.int32)), pa.array(np.concatenate([np.zeros(len(up), np.int64), w]), mask=null)]
    return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], [*ROW, "lo", "hi", "w"])


def _block_rows(stretches: DataFrame, length: int, keep: str) -> DataFrame:
    """What ``_block`` finds in all blocks. Rows come by anchor and salt; a block ends with an anchor."""
    kind = stretches.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held, size, last, rolling = [], 0, None, _Rolling(2 * _PIECE)

        for batch in batches:
            a, salt = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("a", "salt"))
            bytes_at = batch.column(batch.schema.get_field_index("bytes"))
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(bytes_at).to_numpy().astype(np.int64))])
            rows = pa.Table.from_batches([batch]).select([*ROW, "lo", "bytes", "split"])
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (salt[1:] != salt[:-1])) + 1
            if last is not None and (a[0], salt[0]) != last:
                cuts = np.concatenate([[0], cuts])
            done = 0
            for cut in cuts:
                if size + sizes[cut] - sizes[done] >= BLOCK_BYTES:
                    held.append(rows.slice(done, cut - done))
                    yield _block(pa.concat_tables(held), length, keep, rolling)
                    held, size, done = [], 0, cut
            held.append(rows.slice(done))
            size += sizes[-1] - sizes[done]
            last = (a[-1], salt[-1])
        if size:
            yield _block(pa.concat_tables(held), length, keep, rolling)

    return stretches.mapInArrow(tidy(run), f"doc_id {kind}, tag long, tag2 long, lo int, hi int, w long")


def _stretches(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted (doc_id, tag, tag2, a, salt, split, lo, hi)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, tags, tags2, texts, lists = batch.columns
            for i in range(len(ids)):
                b, rows = texts[i].as_py(), lists[i].as_py()
                n = len(rows)
                at = pa.array([i] * n, pa.int64())
                cols = [[r[k] for r in rows] for k in ("a", "salt", "split", "lo")]
                yield pa.RecordBatch.from_arrays([ids.take(at), tags.take(at), tags2.take(at), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int32()), pa.array([b[r["lo"] : r["hi"] + length] for r in rows], pa.binary())], [*ROW, "a", "salt", "split", "lo", "bytes"])

    lists = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("a", "salt", "split", "lo", "hi")).alias("rows"))
    rows = _only(docs, wanted.select(*ROW).distinct())
    rows = _with_row(rows, lists).dropDuplicates(ROW)
    return rows.select("doc_id", "tag", "tag2", F.col("text").cast("binary").alias("text"), "rows").mapInArrow(tidy(run), f"doc_id {kind}, tag long, tag2 long, a long, salt int, split boolean, lo int, bytes binary")


#: What tells rows apart: the id, which may be null or repeated, and 128 bits of the text's hash.
ROW = ["doc_id", "tag", "tag2"]


def _tagged(docs: DataFrame) -> DataFrame:
    """``docs`` with the two halves of the text's hash, which have seeds of their own."""
    return docs.withColumns({"tag": F.xxhash64("text"), "tag2": F.xxhash64(F.lit(0x5EED), "text")})


def _first(row: str = "first") -> Column:
    """Is a row the one in the struct?"""
    return F.col(f"{row}.doc_id").eqNullSafe(F.col("doc_id")) & (F.col(f"{row}.tag") == F.col("tag")) & (F.col(f"{row}.tag2") == F.col("tag2"))


def _with_row(docs: DataFrame, side: DataFrame, how: str = "inner", names: list[str] = ROW) -> DataFrame:
    """``docs`` joined by row, whose columns are called ``names`` there."""
    side = side.withColumnsRenamed({k: f"__{k}_of" for k in ROW})
    on = docs[names[0]].eqNullSafe(F.col("__doc_id_of"))
    for k, name in zip(ROW[1:], names[1:], strict=True):
        on = on & (docs[name] == F.col(f"__{k}_of"))
    return docs.join(side, on, how).drop(*(f"__{k}_of" for k in ROW))


def _only(docs: DataFrame, rows: DataFrame, anti: bool = False, names: list[str] = ROW) -> DataFrame:
    """Rows of ``docs`` with (or without) an entry in ``rows``: a checked number of them is broadcast, more are shuffled."""
    small = rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return _with_row(docs, F.broadcast(rows) if small else rows, "left_anti" if anti else "left_semi", names)


def repeated_runs(docs: DataFrame, length: int = LENGTH, keep: str = "none", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, tag, tag2, spans), written: for each document with a repeat, byte spans [lo, hi) that go, unmerged. ``docs`` has those three and text."""
    small_batches(docs.sparkSession)
    long = docs.filter(F.octet_length("text") >= length)
    keyed = long.select(*ROW, F.md5(F.col("text").cast("binary")).alias("m"), F.octet_length("text").alias("n"))
    texts = keyed.groupBy("m", "n").agg(F.count("*").alias("rows"), F.min(F.struct(*ROW)).alias("first")).filter("rows > 1")
    copies = materialise(keyed.join(texts, ["m", "n"]).select(*ROW, "n", _first().alias("is_first")), "copies")
    later = copies.filter("not is_first").select(*ROW).distinct()
    one_each = _only(long.select(*ROW, "text"), later, anti=True)

    rows = materialise(_anchor_rows(one_each, length), "anchors")
    # Aggregated sides are written first: a join of two plain exchanges is one that Spark can split at a hot key.
    shared = materialise(rows.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "shared")
    rows2 = materialise(rows.join(shared, "a"), "shared-anchors")
    discard(rows, shared)
    # Null ids first in order, like the minimum of a struct.
    stretch = materialise(rows2.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "lo", "hi")).alias("first")), "stretches")
    twice = stretch.filter("n > 1").select("a", "c", "first")
    full = rows2.join(twice, ["a", "c"])
    if keep == "first":
        full = full.filter(~(_first() & (F.col("lo") == F.col("first.lo"))))
    full = full.select(*ROW, "lo", "hi")

    several = materialise(stretch.groupBy("a").agg(F.count("*").alias("k")).filter("k > 1").select("a", F.ceil(F.col("k") / group_rows).cast("int").alias("blocks")), "open-anchors")
    wanted = stretch.join(several, "a").select("first.*", "a", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).otherwise(F.lit(0)).alias("salt"), (F.col("blocks") > 1).alias("split"))
    wanted = materialise(wanted, "open-stretches")
    laid = _stretches(docs.select(*ROW, "text"), wanted, length)
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    laid = laid.repartition(int(parts), "a", "salt").sortWithinPartitions("a", "salt")
    block = materialise(_block_rows(laid, length, keep), "block-runs")
    ends = block.filter("w is null").select(*ROW, "lo", "hi")
    windows = block.filter("w is not null").select(*ROW, "lo", "w")
    met = windows.groupBy("w").agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "lo")).alias("first")).filter("n > 1")
    across = windows.join(met, "w")
    if keep == "first":
        across = across.filter(~(_first() & (F.col("lo") == F.col("first.lo"))))
    across = across.select(*ROW, "lo", F.col("lo").alias("hi"))
    spans = full.unionByName(ends).unionByName(across).select(*ROW, "lo", (F.col("hi") + length).alias("hi"))
    whole = copies if keep == "none" else copies.filter("not is_first")
    spans = spans.unionByName(whole.select(*ROW, F.lit(0).alias("lo"), F.col("n").alias("hi")))
    # A set: rows of equal id and text say the same.
    out = materialise(spans.groupBy(*ROW).agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    discard(copies, rows2, stretch, several, wanted, block)
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of a union of spans."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left without merged spans."""
    at, kept = 0, []
    for lo, hi in spans:
        kept.append(text[at:lo])
        at = hi
    return b"".join([*kept, text[at:]])


def cut_characters(text: bytes, spans: list[tuple[int, int]]) -> str:
    """Like ``cut``, keeping whole every character that a span holds only in part."""
    whole = []
    for lo, hi in spans:
        while lo < hi and lo < len(text) and text[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
            hi -= 1
        whole.append((lo, hi))
    return cut(text, whole).decode("utf-8")


def digests(docs: DataFrame, length: int = LENGTH, keep: str = "none", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs``."""
    docs = _tagged(docs.select("doc_id", "text"))
    found = repeated_runs(docs, length, keep, group_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts, lists = batch.columns
            n, gone, spans, sha = [], [], [], []
            for t, rows in zip(texts, lists, strict=True):
                b = t.as_py()
                runs = merge([(r["lo"], r["hi"]) for r in rows.as_py()])
                n.append(len(b))
                gone.append(sum(hi - lo for lo, hi in runs))
                spans.append(len(runs))
                sha.append(hashlib.sha256(cut(b, runs)).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = found.select(*ROW)
    hit, clean = _with_row(_only(docs, rows), found), _only(docs, rows, anti=True)
    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    clean = clean.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    return clean.unionByName(hit.select("doc_id", F.col("text").cast("binary").alias("text"), "spans").mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """``docs`` without repeated strings; ``n_chars`` follows the text where it is a column. Documents of which nothing but white space is left go."""
    names = ["doc_id", "__tag", "__tag2"]
    tagged = _tagged(docs.select("doc_id", "text"))
    found = repeated_runs(tagged, length, keep).withColumnRenamed("spans", "__spans")
    tagged = docs.withColumns({"__tag": F.xxhash64("text"), "__tag2": F.xxhash64(F.lit(0x5EED), "text")})

    @F.pandas_udf("string")
    def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_characters(bytes(t), merge([(r["lo"], r["hi"]) for r in rows])) for t, rows in zip(text, spans, strict=True)])

    rows = found.select(*ROW)
    hit = _with_row(_only(tagged, rows, names=names), found, names=names).withColumn("text", kept(F.col("text").cast("binary"), F.col("__spans")))
    hit = hit.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _only(tagged, rows, anti=True, names=names).select(*docs.columns).unionByName(hit.select(*docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return digests(docs)
