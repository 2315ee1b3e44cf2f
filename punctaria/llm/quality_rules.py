"""Quality rules: base counts and divergence from language references.

Native DataFrame operator. A first pass sums, for each reference language, the character-class and
common-word histograms of all documents labelled with it (one row for each language of the fixed
parameter ``COMMON_WORDS``, so its size is bounded). A second pass computes everything else of a
document inside its own row: no shuffle, no join.

Defined results: a null text has no words, lines or characters; a null or wrong ``lang`` is of no
matter for a verdict, as a document is compared with every reference and the nearest counts, but one labelled with a language that
has no reference is not rejected by a divergence; a text
shorter than the guards is never rejected by a divergence; without any reference, as without a column ``lang``, nothing is; a text without common words diverges
like any other: all its words are in the histogram's class of every other word;
repeated rows are judged each for itself; other columns of the input pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words

# Frequent function words of each reference language.
COMMON_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "mit", "von", "den", "dem", "ein", "für"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "with"],
    "es": ["el", "los", "las", "del", "que", "y", "una", "por", "con", "para", "se", "como"],
    "fr": ["le", "la", "les", "de", "des", "et", "est", "un", "que", "dans", "pour", "sur"],
}
#: Character classes found by pattern in what is left of a text without lower-case letters, white space and wide characters.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "stop": r"[.,;:!?'\"()\-]"}
_PLAIN = r"[a-z\x20\x09-\x0D\x{80}-\x{10FFFF}]+"
#: Classes of a histogram: those, other characters, white space, UTF-8 bytes beyond one a character, lower-case and wide characters.
N_CLASSES = len(CLASSES) + 4

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
GUARD_CHARS, GUARD_WORDS = 200, 50
MAX_CLASS_JS = 0.3
#: The largest common-word distance from a reference, as a share of the distance that a text without any common word has from it; its
#: square grows by ``WORD_NOISE`` over the number of words, about twice what a text drawn from the reference is off by chance.
MAX_WORD_SHARE, WORD_NOISE = 0.5, 4.0


def _vocabulary() -> list[str]:
    return sorted({w for ws in COMMON_WORDS.values() for w in ws})


def _rest(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _PLAIN, "")


def _classes(text: Column, rest: Column, word_chars: Column) -> Column:
    """Counts by character class."""
    text = F.coalesce(text, F.lit(""))
    found = [F.length(rest) - F.length(F.regexp_replace(rest, f"{p}+", "")) for p in CLASSES.values()]
    other = F.length(rest) - sum(found[1:], found[0])
    space = F.length(text) - word_chars
    return F.array(*found, other, space, F.octet_length(text) - F.length(text), word_chars - F.length(rest)).cast("array<double>")


def _common(ws: Column) -> Column:
    return F.filter(ws, lambda w: w.isin(*_vocabulary()))


def _word_counts(common: Column, n: Column) -> Column:
    """Counts of each common word and, last, of every other word of ``n``."""
    found = F.transform(F.array(*map(F.lit, _vocabulary())), lambda w: (F.size(common) - F.size(F.array_remove(common, w))).cast("double"))
    return F.concat(found, F.array((n - F.size(common)).cast("double")))


def references(docs: DataFrame) -> list[tuple[str, list[float], list[float]]]:
    """(language, class shares, shares of common words and all others) of each reference language that has labelled text with common words; at most ``len(COMMON_WORDS)`` rows."""
    if "lang" not in docs.columns:
        return []
    n_classes, n_words = N_CLASSES, len(_vocabulary()) + 1
    per_doc = docs.select("lang", "text").filter(F.col("lang").isin(*COMMON_WORDS) & F.col("text").isNotNull()).select("lang", "text", words(F.col("text")).alias("ws"), _rest(F.col("text")).alias("rest"))
    per_doc = per_doc.select("lang", _classes(F.col("text"), F.col("rest"), F.length(F.array_join("ws", ""))).alias("c"), _common(F.col("ws")).alias("k"), F.size("ws").alias("n")).select("lang", "c", _word_counts(F.col("k"), F.col("n")).alias("w"))
    sums = per_doc.groupBy("lang").agg(F.array(*(F.sum(F.col("c")[i]) for i in range(n_classes))).alias("c"), F.array(*(F.sum(F.col("w")[i]) for i in range(n_words))).alias("w"))
    shares = lambda xs: [x / max(sum(xs), 1.0) for x in xs]
    return sorted((r["lang"], shares(r["c"]), shares(r["w"])) for r in sums.collect() if sum(r["c"]) > 0 and sum(r["w"][:-1]) > 0)


def max_word_js(shares: list[float]) -> float:
    """The largest common-word distance of a long text from a reference."""
    o = shares[-1]  # every other word; a text without common words has 1 there
    none = math.sqrt((math.log2(2 / (1 + o)) + (1 - o) + (o * math.log2(2 * o / (1 + o)) if o > 0 else 0.0)) / 2)
    return MAX_WORD_SHARE * none


def _js_distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of a share array from fixed shares.

    Σ p log p + Σ q log q - Σ (p+q) log((p+q)/2), halved; terms of 0 are 0.
    """
    xlog = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))
    q_self = sum(x * math.log2(x) for x in q if x > 0)
    terms = F.zip_with(p, F.array(*map(F.lit, q)), lambda a, b: xlog(a) - xlog_mid(a, b))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return F.sqrt(F.greatest(F.lit(0.0), (total + F.lit(q_self)) / 2))


def xlog_mid(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, (a + b) * F.log2((a + b) / 2)).otherwise(F.lit(0.0))


def _repeat_words(hashes: Column) -> Column:
    """From the hash of each window, the number of words in windows found twice or more."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(hashes)

    def twice(s: Column) -> Column:
        at = F.filter(F.transform(s, lambda x, j: F.when(((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"])) | ((j < n - 1) & (s[F.least(j + 1, n - 1)]["h"] == x["h"])), x["i"])), lambda x: x.isNotNull())
        return F.sort_array(at)

    def covered(s: Column) -> Column:
        return F.aggregate(s, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")))["n"]

    # transform over a one-element array binds each array once.
    return F.transform(F.array(pairs), lambda s: covered(F.transform(F.array(twice(s)), lambda a: a)[0]))[0]


def judge(docs: DataFrame, refs: list[tuple[str, list[float], list[float]]] | None = None, prefix: str = "") -> DataFrame:
    """``docs`` with the counts and verdicts as columns named ``prefix`` + name."""
    refs = references(docs) if refs is None else refs
    text = F.coalesce(F.col("text"), F.lit(""))
    p = f"__qr_{prefix}"
    out = docs.withColumn(f"{p}w", words(F.col("text")))
    ws = F.col(f"{p}w")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({f"{p}h": F.transform(ws, lambda w: F.xxhash64(w)), f"{p}l": lines, f"{p}k": _common(ws), f"{p}r": _rest(F.col("text")), f"{prefix}word_chars": F.length(F.array_join(ws, "")).cast("long")})
    out = out.withColumn(f"{p}c", _classes(F.col("text"), F.col(f"{p}r"), F.col(f"{prefix}word_chars")))
    h = F.col(f"{p}h")
    n = F.size(ws)
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*(h[i + k] for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn(f"{p}x", windows)
    x = F.col(f"{p}x")
    out = out.withColumns({
        f"{prefix}n_words": n.cast("long"),
        f"{prefix}n_symbols": F.length(F.regexp_replace(F.col(f"{p}r"), r"[^#*$%&|<>]+", "")).cast("long"),
        f"{prefix}n_dup_lines": (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("long"),
        f"{prefix}n_repeat_words": F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(_repeat_words(x)).cast("long"),
        f"{p}d": _word_counts(F.col(f"{p}k"), n),
    })
    shares = lambda a: F.transform(a, lambda v: v / F.greatest(F.aggregate(a, F.lit(0.0), lambda s, t: s + t), F.lit(1.0)))
    out = out.withColumns({f"{p}p": shares(F.col(f"{p}c")), f"{p}q": shares(F.col(f"{p}d"))})
    out = out.withColumns({f"{p}a": F.array(*(_js_distance(F.col(f"{p}p"), r[1]) for r in refs)).cast("array<double>"), f"{p}b": F.array(*(_js_distance(F.col(f"{p}q"), r[2]) for r in refs)).cast("array<double>")})
    nearest = lambda col: F.array_min(F.concat(col, F.array(F.lit(1.0)))) if refs else F.lit(0.0)
    limits = F.array(*(F.lit(max_word_js(r[2]) ** 2) for r in refs)).cast("array<double>")
    like_one = F.exists(F.zip_with(f"{p}b", limits, lambda js, limit: js * js <= limit + WORD_NOISE / n), lambda x: x) if refs else F.lit(True)
    out = out.withColumns({f"{prefix}class_js": nearest(F.col(f"{p}a")), f"{prefix}word_js": nearest(F.col(f"{p}b")), f"{p}o": (n >= GUARD_WORDS) & ~like_one})
    diverges = ((F.length(text) >= GUARD_CHARS) & (F.col(f"{prefix}class_js") > MAX_CLASS_JS)) | F.col(f"{p}o")
    # A label that names a language without a reference leaves nothing to compare with.
    if "lang" in docs.columns:
        diverges = diverges & (F.col("lang").isNull() | F.col("lang").isin(*(r[0] for r in refs)))
    out = out.withColumn(f"{prefix}base_failed", (F.col(f"{prefix}n_words") < MIN_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{prefix}n_words")))
    # A filter stays above an indeterminate column; pushed down, it would hold a copy of every expression below.
    stays = F.monotonically_increasing_id() >= 0
    out = out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & ~diverges & stays)
    return out.drop(*(f"{p}{k}" for k in "whlckrxdpqabo"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    return judge(docs, prefix="__qr_").filter("__qr_kept").select(*docs.columns)


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_js", "word_js"]


def query(docs: DataFrame) -> DataFrame:
    return judge(docs.select(*(c for c in ("doc_id", "text", "lang") if c in docs.columns))).select(*RESULT)
