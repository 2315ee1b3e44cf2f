"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built, from a bounded sample: at most ``TRAIN_CHARS`` normalised symbols, or an equal part of ``TOTAL_CHARS`` where
there are many languages, of the documents with the smallest id hashes; of a document at most its first ``MAX_DOC_CHARS`` characters are learned from. A text is parsed greedily
into phrases, each the longest string that occurs in the sample. The number of phrases times the logarithm of the sample's size is the cross-parsing estimate of the text's bits: the
language with the lowest wins. Whole texts are parsed, in blocks of ``BLOCK`` symbols that start a new phrase each; all blocks of a batch
advance together through a dense transition table.

Letters that are not among the commonest of all samples together are written as ``DIGITS`` symbols, their code point in base 16, so any number of scripts keeps all its letters.

Defined results: a null text or one without a letter is ``und`` with score 0; without any labelled row every text is ``und``;
ties go to the first language in order; rows with a null language are not learned from; repeated rows are predicted alike; more than ``MAX_LANGUAGES`` labels
are an error. The score is the share of the second-best estimate in the sum of the best two, doubled and reduced to 0..1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, small_batches, tidy

TRAIN_CHARS, TOTAL_CHARS, MAX_DOC_CHARS, MAX_LANGUAGES = 30_000, 600_000, 20_000, 8192
#: Rows of a language that pass the first, rough choice, at least.
TRAIN_DOCS = 64
ALPHABET, DIGITS, BLOCK = 64, 5, 2048
_DIGIT = ALPHABET - 16  # the first of 16 digit symbols
_WRITTEN = 255


def automaton(symbols: list[int]) -> np.ndarray:
    """Dense transitions of the suffix automaton of a symbol sequence: rows are states, -1 where there is none."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(nxt), ALPHABET), -1, np.int32)
    for s, row in enumerate(nxt):
        for c, t in row.items():
            table[s, c] = t
    return table


def parsing_table(table: np.ndarray) -> np.ndarray:
    """Transitions that never end: where a phrase cannot go on, the bitwise complement of the state after starting anew with the character.

    The last row is the state between phrases, where every parse starts and where a character that is not in the sample, a phrase of its own, leads.
    """
    between = len(table)
    anew = ~np.where(table[0] >= 0, table[0], between)
    return np.concatenate([np.where(table >= 0, table, anew[None, :]), anew[None, :]]).astype(np.int32)


class Alphabet:
    """Symbols of characters: 0 for anything but letters, 1.. for the samples' commonest lower-case letters; other letters are written in digit symbols."""

    def __init__(self, texts: list[str]) -> None:
        counts: dict[str, int] = {}
        for t in texts:
            for ch in t.lower():
                if ch.isalpha():
                    counts[ch] = counts.get(ch, 0) + 1
        letters = sorted(sorted(counts), key=lambda ch: -counts[ch])[: _DIGIT - 1]
        symbol = {ch: i + 1 for i, ch in enumerate(letters)}
        self.table, self.low = np.zeros(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint32)
        for cp in range(0x10000):
            ch = chr(cp)
            if ch.isalpha():
                low = ch.lower()
                self.table[cp] = symbol.get(low, _WRITTEN)
                self.low[cp] = ord(low[0])

    def symbols(self, text: str) -> np.ndarray:
        """Symbols with runs of other characters as one 0, none at the ends."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(cp, 0xFFFF)
        out, low = self.table[at], self.low[at]
        if len(cp) and int(cp.max()) > 0xFFFF:
            high = cp > 0xFFFF
            out[high] = [_WRITTEN if chr(c).isalpha() else 0 for c in cp[high]]
            low[high] = cp[high]
        keep = out != 0
        keep[1:] |= out[:-1] != 0
        out, low = out[keep], low[keep]
        if len(out) and out[-1] == 0:
            out, low = out[:-1], low[:-1]
        written = out == _WRITTEN
        if not written.any():
            return out
        size = np.where(written, DIGITS, 1)
        of = np.repeat(np.arange(len(out)), size)
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        digits = (low[of] >> (4 * (DIGITS - 1 - place)).astype(np.uint32)) & np.uint32(15)
        return np.where(written[of], digits + _DIGIT, out[of]).astype(np.uint8)


def phrases(streams: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
    """Number of phrases of each stream by each table."""
    blocks = [(i, s[a : a + BLOCK]) for i, s in enumerate(streams) for a in range(0, len(s), BLOCK)]
    out = np.zeros((len(streams), len(tables)), np.int64)
    if not blocks:
        return out
    blocks.sort(key=lambda b: -len(b[1]))
    sizes = np.array([len(b[1]) for b in blocks])
    grid = np.zeros((sizes[0], len(blocks)), np.uint8)
    for j, (_, s) in enumerate(blocks):
        grid[: len(s), j] = s
    owner = np.array([b[0] for b in blocks])
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    for k, table in enumerate(tables):
        flat = table.ravel()
        state = np.full(len(blocks), len(table) - 1, np.int32)
        count = np.zeros(len(blocks), np.int32)
        for i in range(sizes[0]):
            n = active[i]
            t = flat[state[:n] * ALPHABET + grid[i, :n]]
            over = t >> 31
            count[:n] -= over
            state[:n] = t ^ over
        np.add.at(out[:, k], owner, count)
    return out


def train(docs: DataFrame, learn: Column) -> tuple[list[str], tuple[np.ndarray, np.ndarray] | None, list[np.ndarray], list[float]]:
    """(languages, alphabet's tables, parsing tables, weights of a phrase) from the bounded sample of rows for which ``learn`` holds."""
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.select("doc_id", "lang", F.xxhash64("doc_id", "text").alias("h"), F.substring("text", 1, MAX_DOC_CHARS).alias("text"))
    # One row for each language.
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return [], None, [], []
    most = min(TRAIN_CHARS, TOTAL_CHARS // len(sizes))
    # Per language a hash threshold that several times the sample passes, then the smallest hashes of those.
    share = [(r["lang"], min(1.0, max(4.0 * most / max(r["chars"], 1), TRAIN_DOCS / r["rows"]))) for r in sizes]
    few = known.join(F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, share double")), "lang").filter(F.pmod("h", F.lit(1 << 20)) <= F.col("share") * (1 << 20))
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1))
    few = few.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < most)
    rows = few.select("lang", "h", "text").toPandas().sort_values(["lang", "h", "text"])
    languages = sorted(rows["lang"].unique().tolist())
    alphabet = Alphabet(rows["text"].tolist())
    tables, weights = [], []
    for lang in languages:
        symbols: list[int] = []
        for t in rows.loc[rows["lang"] == lang, "text"]:
            symbols += [0, *alphabet.symbols(t).tolist()]
            if len(symbols) >= most:
                break
        symbols = symbols[:most]
        tables.append(parsing_table(automaton(symbols)))
        weights.append(float(np.log2(max(2, len(symbols)))))
    return languages, (alphabet.table, alphabet.low), tables, weights


def predict(docs: DataFrame, model: tuple[list[str], tuple[np.ndarray, np.ndarray] | None, list[np.ndarray], list[float]]) -> DataFrame:
    """(doc_id, lang_pred, score, phrases_per_char) of each row; phrases of the best language, a symbol."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        languages, letters, tables, weights = held.value
        alphabet = Alphabet.__new__(Alphabet)
        alphabet.table, alphabet.low = letters or (None, None)
        none = np.empty(0, np.uint8)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            streams = [alphabet.symbols(t) if languages else none for t in texts]
            size = np.array([len(s) for s in streams])
            rates = phrases(streams, tables) * np.array(weights) / np.maximum(size, 1)[:, None] if languages else np.ones((len(texts), 1))
            best = rates.argmin(1) if len(texts) else np.empty(0, int)
            pred, score = [], []
            for j, b in enumerate(best):
                if not size[j]:
                    pred.append("und")
                    score.append(0.0)
                    continue
                first, second = np.partition(rates[j], 1)[:2] if len(languages) > 1 else (rates[j, 0], 1.0)
                pred.append(languages[b])
                score.append(float(min(1.0, max(0.0, 2 * second / (first + second) - 1))) if first + second > 0 else 0.0)
            rate = rates[np.arange(len(texts)), best] / (np.array(weights)[best] if languages else 1.0) if len(texts) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], ["doc_id", "lang_pred", "score", "phrases_per_char"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double, phrases_per_char double")


FOLDS, HELD_OUT = 4, 2


def query(docs: DataFrame) -> DataFrame:
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    model = train(docs, ~held_out)
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "phrases_per_char")
