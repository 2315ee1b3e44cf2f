"""Words of a corpus grouped with their spelling variants, by automata over halves of words.

1. Words are counted in tasks and their counts combined before the shuffle; those with ``MIN_COUNT`` occurrences or more are the vocabulary.
2. Two words are near if one inserted, deleted or replaced character makes one the other. That edit leaves one half of either word as it is: the first ``l // 2`` characters, at the
   start of the other word, or the rest, at its end. Shards of Aho-Corasick automata hold both halves of every word; a half's shard follows from its text. A word is scanned in
   the shards that can hold its beginnings and endings of the lengths in question, four at most, whatever the number of shards.
3. A hit counts if the half stands at the start (or the end) of the scanned word and the lengths differ by one at most. The other halves are then compared: one by one where few words share the half, by
   their texts without one character where many do, so that a half which very many words share makes no pairs but near ones. A half of more than ``HALF_WORDS`` words is split over several shards, and
   the words that look for it are scanned in each of them.
4. Each word's most frequent near word is its form if it occurs ``RATIO`` times as often or more. Chains of forms are followed by doubling; their length is at most the logarithm of the largest count.

Counting also takes a typing slip into account that depends on nothing but the document and the word (``slips``): it makes variants in texts that have none.

Defined results: null and empty texts have no words; a null id is an empty one; rows count one by one, so repeated rows count again; ties go to the smallest word in code-point order; an empty
table gives an empty result; extra columns are left out. Words of any length are handled; those of which the other half has more than ``INDEXED`` characters are compared one by one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches, tidy

MIN_LENGTH, MIN_COUNT, RATIO, SLIP = 6, 5, 5, 199
#: Words of a shard's automaton, words of one half in one shard, and the number of words and the length up to which halves are compared one by one or by their parts.
SHARD_WORDS, HALF_WORDS, FEW, INDEXED = 20_000, 50_000, 16, 32
#: Distinct words that a task holds before it gives their counts on.
HELD_WORDS = 200_000


def slipped(word: str, h: int) -> str:
    """The word without one character where ``SLIP`` divides its hash."""
    if h % SLIP:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, slips: bool = True) -> DataFrame:
    """(word, n) of all words of ``MIN_LENGTH`` characters or more in ``docs`` (doc_id, text) that occur ``MIN_COUNT`` times or more, written."""
    small_batches(docs.sparkSession)

    def run(batches):
        pattern, counts = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}"), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                lower = text.lower().decode()  # of bytes: A-Z only
                found = Counter(m.group() for m in pattern.finditer(lower)) if len(lower) > 1 << 20 else Counter(pattern.findall(lower))
                if not slips:
                    counts.update(found)
                    continue
                start = zlib.crc32(b"" if doc is None else str(doc).encode())
                start = zlib.crc32(b":", start)
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % SLIP == 0:
                        word = slipped(word, h)
                        if len(word) < MIN_LENGTH:
                            continue
                    counts[word] += n
            if len(counts) > HELD_WORDS:
                yield out()
                counts = Counter()
        if counts:
            yield out()

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialise(counted.filter(F.col("n") >= MIN_COUNT), "words")


def near(a: str, b: str) -> bool:
    """Does exactly one inserted, deleted or replaced character make one the other?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class _Half:
    """Words of one length that share a half: their other halves, found one by one or by what is left of them without a character."""

    def __init__(self, first: bool) -> None:
        self.first, self.words, self.index = first, [], None

    def rest(self, word: str, size: int) -> str:
        return word[size:] if self.first else word[: len(word) - size]

    def near(self, word: str, size: int) -> list[int]:
        """Places in ``words`` of those near a word that has this half of ``size`` characters."""
        own = self.rest(word, size)
        if len(self.words) <= FEW or len(own) > INDEXED:
            return [i for i, w in enumerate(self.words) if near(w[0], word)]
        if self.index is None:
            self.index = defaultdict(list)
            for i, (w, _) in enumerate(self.words):
                r = self.rest(w, size)
                self.index[r].append(i)
                for k in range(len(r)):
                    self.index[k, r[:k] + r[k + 1 :]].append(i)
        length, found = len(self.words[0][0]), set()
        if length == len(word):  # replaced
            for k in range(len(own)):
                found.update(self.index.get((k, own[:k] + own[k + 1 :]), ()))
        elif length < len(word):  # the word has one more
            for k in range(len(own)):
                found.update(self.index.get(own[:k] + own[k + 1 :], ()))
        else:
            for k in range(len(own) + 1):
                found.update(self.index.get((k, own), ()))
        return [i for i in found if near(self.words[i][0], word)]


class Shard:
    """An automaton over halves of words."""

    def __init__(self) -> None:
        self.halves: dict[str, dict] = defaultdict(dict)
        self.automaton = None

    def add(self, half: str, first: bool, word: str, n: int) -> None:
        held = self.halves[half]
        key = (first, len(word))
        if key not in held:
            held[key] = _Half(first)
        held[key].words.append((word, n))

    def scan(self, word: str):
        """(near word, its n) of the words whose half is found where it has to be; some more than once."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for half, held in self.halves.items():
                self.automaton.add_word(half, (len(half), held))
            self.automaton.make_automaton()
        if not self.halves:
            return
        for end, (size, held) in self.automaton.iter(word):
            places = ([True] if end + 1 == size else []) + ([False] if end + 1 == len(word) else [])
            for first in places:
                for length in (len(word) - 1, len(word), len(word) + 1):
                    half = held.get((first, length))
                    if half is not None:
                        for i in half.near(word, size):
                            yield half.words[i]


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n), written: all pairs of near words a < b of ``words`` (word, n)."""
    spark = words.sparkSession
    length = F.char_length("word")
    size = F.floor(length / 2).cast("int")
    left = lambda k: F.struct(F.lit(True).alias("first"), F.substring("word", F.lit(1), k).alias("half"))
    right = lambda k: F.struct(F.lit(False).alias("first"), F.substring("word", length - k + 1, k).alias("half"))
    held = words.select("word", "n", F.explode(F.array(left(size), right(length - size))).alias("h")).select("word", "n", "h.*")
    # Lengths of halves of words that are one shorter, as long, or one longer.
    sizes = [F.floor((length + d) / 2).cast("int") for d in (-1, 0, 1)]
    others = [(length + d - F.floor((length + d) / 2)).cast("int") for d in (-1, 0, 1)]
    asked = words.select("word", "n", F.explode(F.array_distinct(F.array(*(left(k) for k in sizes), *(right(k) for k in others)))).alias("h")).select("word", "n", "h.*")

    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // SHARD_WORDS))
    crowded = materialise(held.groupBy("first", "half").agg(F.count("*").alias("words")).filter(F.col("words") > HALF_WORDS), "crowded-halves")
    splits = crowded.select("first", "half", F.ceil(F.col("words") / HALF_WORDS).cast("int").alias("splits"))  # each stands for many words

    def dealt(rows: DataFrame, asks: bool) -> DataFrame:
        """Rows with the shard of their half, and of one of its parts (or all) where it is split."""
        rows = rows.join(splits, ["first", "half"], "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
        part = F.explode(F.sequence(F.lit(0), F.col("splits") - 1)) if asks else F.pmod(F.xxhash64("word"), F.col("splits")).cast("int")
        return rows.withColumn("part", part).withColumn("shard", F.pmod(F.xxhash64("first", "half", "part"), F.lit(shards)).cast("int"))

    scanned = dealt(asked, True).select("shard", F.lit(1).alias("role"), "word", "n").distinct()
    both = dealt(held, False).select("shard", F.lit(0).alias("role"), "word", "n", "half", "first")
    both = both.unionByName(scanned.withColumns({"half": F.lit(None).cast("string"), "first": F.lit(None).cast("boolean")}))
    laid = both.repartition(shards, "shard").sortWithinPartitions("shard", "role")

    def run(batches):
        shard, number = Shard(), None
        for batch in batches:
            found = []
            for k, role, word, n, half, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != number:
                    shard, number = Shard(), k
                if role == 0:
                    shard.add(half, first, word, n)
                    continue
                for other, m in set(shard.scan(word)):
                    found.append((word, other, n, m) if word < other else (other, word, m, n))
            if found:
                a, b, a_n, b_n = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(a_n, pa.int64()), pa.array(b_n, pa.int64())], ["a", "b", "a_n", "b_n"])

    out = materialise(laid.mapInArrow(tidy(run), "a string, b string, a_n long, b_n long").distinct(), "near-words")
    discard(crowded)
    return out


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of ``words`` (word, n)."""
    pairs = near_pairs(words)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))
    is_form = F.col("form_n") >= ratio * F.col("n")
    found = materialise(found.select("word", "n", "n_near", F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms")
    # A form occurs more often than its word, so chains have an end; each round doubles what is followed.
    roots = materialise(found.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while roots.filter("moved").take(1):
        further = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        before, roots = roots, materialise(further.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(before)
    roots = roots.select("word", "root")
    out = found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    discard(pairs)
    return out


def query(docs: DataFrame) -> DataFrame:
    return variants(word_counts(docs))
