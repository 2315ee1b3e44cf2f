"""Toxicity by Levenshtein automata over a lexicon trie, scored in context windows.

The lexicon is a trie of terms: a fixed list of insults, and words and word stems learned from labelled rows by greedy cover.
The automaton of every term within its edit distance is intersected with the trie and made deterministic as it meets characters: a state is the set of
(trie node, edits so far) that are alive, and its transitions are kept, so a word costs one lookup a character and most words die early. Stems match by prefix, with
edits too. Words of clean labelled texts that are near a term by chance only match as they are, and a term that many such words are near takes no edits. A word with digits or symbols between letters is
matched whole where no part of it matches.

Each match is seen in a window of ``WINDOW`` words on either side: quotation marks around it or a reporting word before it count as quotation,
an address of the second person as abuse. A logistic layer over the counts of a text gives its score; quoted matches count for less there.

Learning uses at most ``MAX_TRAIN`` labelled documents, those with the smallest id hashes; scoring covers every whole text.

Defined results: a null, empty or wordless text has no match and the score of none; without labelled rows the fixed list and fixed weights hold;
rows with null labels are not learned from; repeated rows score alike; labels of repeated ids count once, the largest,
with the smallest of their texts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches, tidy
from .hashing import WordHashes, shingle_hashes

# Insults known without labels; words that report speech; words that address the reader.
SEED_TERMS = ["idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting", "trash", "clown"]
REPORTING = ["said", "says", "wrote", "called", "quoted", "word", "term", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"]
ADDRESS = ["you", "your", "youre", "du", "dich", "dein", "ihr", "tu", "toi", "vous", "votre", "tú", "usted", "ustedes"]
# Opening and closing quotation marks. An apostrophe is none.
QUOTES = [("“", "”"), ("„", "“"), ("„", "”"), ("«", "»"), ("»", "«")]

MAX_TRAIN, MAX_TRAIN_BYTES, WINDOW, THRESHOLD = 12_000, 100_000, 6, 0.3
STEM_LENGTHS, MAX_TERMS, MIN_SUPPORT, MIN_SHARE, MAX_CLEAN_SHARE = tuple(range(4, 11)), 2000, 3, 0.01, 0.02
#: The share of clean texts in which new words may be near a term by chance, for it to take edits.
MAX_CHANCE = 0.001
CACHE_WORDS, CACHE_STATES, STEM_EDIT_LETTERS = 200_000, 50_000, 7
#: What a misspelled match counts for against a match as it is, and a quoted one against one that is not.
MISSPELLED, QUOTED = 0.8, 0.2
#: Weights without labels: bias, matches, what is more or less than that in misspelled ones, stems, share of words, quoted, addressed.
FIXED = np.array([-3.0, 3.0, 0.0, 3.0, 2.0, -1.0, 1.0])
_WORD = re.compile(r"[^\W\d_]+")
#: Letters with one or two digits or symbols between them.
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:(?:(?!\s)[\W\d_]){1,2}[^\W\d_]++)+")


def edits_allowed(term: str, stem: bool = False) -> int:
    """Terms of three letters only match as they are. A stem needs more letters, as it matches with anything behind it."""
    return 0 if len(term) < (STEM_EDIT_LETTERS if stem else 4) else 1 if len(term) < 10 else 2


class Lexicon:
    """Trie of (term, is_stem), with the deterministic automaton of all terms within their edits; words of ``plain`` match without edits only, and terms among them take none."""

    def __init__(self, terms: list[tuple[str, bool]], plain: frozenset[str] = frozenset()) -> None:
        self.plain = plain
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool, int]]] = [[]]  # of a node: (term, is_stem, edits allowed)
        self.reach = [0]  # the most edits of any term below a node
        self.terms = sorted(terms)
        for k, (term, stem) in enumerate(self.terms):
            allowed = 0 if term in plain else edits_allowed(term, stem)
            node = 0
            self.reach[0] = max(self.reach[0], allowed)
            for ch in term:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][ch]
                self.reach[node] = max(self.reach[node], allowed)
            self.ends[node].append((k, stem, allowed))
        self.letters = {ch for row in self.children for ch in row}
        self.words: dict[str, tuple[int, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        """Start without any state; they are made anew as words need them."""
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, alive: set[tuple[int, int]]) -> int:
        """Number of the state, -1 for a dead one. Letters of a term may be left out: those steps are taken at once."""
        best: dict[int, int] = {}
        todo = list(alive)
        while todo:
            node, e = todo.pop()
            if best.get(node, 99) <= e:
                continue
            best[node] = e
            if e < self.reach[node]:
                todo += [(c, e + 1) for c in self.children[node].values() if e + 1 <= self.reach[c]]
        key = frozenset(best.items())
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.ids[key]

    def _step(self, state: int, ch: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            nxt = self.children[node].get(ch)
            if nxt is not None and e <= self.reach[nxt]:
                out.add((nxt, e))
            if e < self.reach[node]:
                out.add((node, e + 1))
                out.update((c, e + 1) for c in self.children[node].values() if e + 1 <= self.reach[c])
        # A stem that ends here holds whatever follows.
        return self._state(out)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, the first of equally near ones; None if there is none. A stem matches any word that starts with it, or
        with something within its edits."""
        found = self.words.get(word, 0)
        if found != 0:
            return found
        if len(self.sets) > CACHE_STATES:
            self._forget()
        state, best = self.start, None
        other = "\0"  # one key for all letters that no term has
        for ch in word:
            key = ch if ch in self.letters else other
            nxt = self.moves[state].get(key)
            if nxt is None:
                nxt = self.moves[state][key] = self._step(state, key)
            state = nxt
            if state < 0:
                break
            if best is None or best[1]:
                stems = [(e, k) for node, e in self.sets[state] for k, stem, allowed in self.ends[node] if stem and e <= allowed]
                if stems and (best is None or min(stems) < best[::-1]):
                    e, k = min(stems)
                    best = (k, e)
        if state >= 0:
            whole = [(e, k) for node, e in self.sets[state] for k, stem, allowed in self.ends[node] if not stem and e <= allowed]
            if whole and (best is None or min(whole)[0] == 0 or min(whole)[0] <= best[1]):
                e, k = min(whole)
                best = (k, e)
        if best is not None and best[1] and word in self.plain:
            best = None
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        self.words[word] = best
        return best


def _distinct(texts: list[str]) -> list[bool]:
    """False for a text that shares a smallest shingle hash with an earlier one: copies would make each of their words look learned."""
    hashes, seen, out = WordHashes(), set(), []
    odd = np.array([1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
    for t in texts:
        s = shingle_hashes(hashes.of(t.encode("utf-8", "surrogatepass").lower().split()), 5)
        keys = {(j, int((s * a).min())) for j, a in enumerate(odd)} if len(s) else set()
        out.append(not keys & seen)
        seen |= keys
    return out


def mine(texts: list[str], labels: list[int]) -> list[tuple[str, bool]]:
    """Terms and stems of toxic texts that hardly occur in clean ones.

    The most frequent come first, of equally frequent ones the most specific; one is taken if it covers texts that none before it does, or if no
    clean text has it, but not if a stem taken before holds it or a term taken before accounts for it.
    """
    toxic, clean = [], Counter()
    n_clean = 0
    for t, y, new in zip(texts, labels, _distinct(texts), strict=True):
        if not new:
            continue
        ws = set(_WORD.findall(t.lower()))
        grams = {(w, False) for w in ws if len(w) >= 4} | {(w[:n], True) for w in ws for n in STEM_LENGTHS if len(w) > n}
        if y:
            toxic.append(grams)
        else:
            n_clean += 1
            clean.update(grams)
    n_toxic, n_clean = max(1, len(toxic)), max(1, n_clean)
    support = Counter(g for gs in toxic for g in gs)
    ok = {g for g, n in support.items() if n >= MIN_SUPPORT and clean[g] / n_clean <= MAX_CLEAN_SHARE * n / n_toxic}
    where: dict = {}
    for i, gs in enumerate(toxic):
        for g in gs & ok:
            where.setdefault(g, set()).add(i)
    left, out, stems = set(range(len(toxic))), [], set()
    for g in sorted(ok, key=lambda g: (-len(where[g]), -len(g[0]), g)):
        if len(out) >= MAX_TERMS:
            break
        held = any(g[0][:n] in stems for n in STEM_LENGTHS)
        explained = g[1] and any(t.startswith(g[0]) and len(where[t, s]) >= 0.8 * len(where[g]) for t, s in out)
        if held or explained:
            continue
        if len(where[g] & left) >= MIN_SUPPORT or (clean[g] == 0 and len(where[g]) >= max(MIN_SUPPORT, MIN_SHARE * n_toxic)):
            out.append(g)
            left -= where[g]
            if g[1]:
                stems.add(g[0])
    return out


def in_quotes(before: str, after: str) -> bool:
    """Is a place between two texts in quotation marks that open in the first and close in the second?"""
    if before.count('"') % 2 and '"' in after:
        return True
    return any(before.rfind(a) > before.rfind(b) and b in after for a, b in QUOTES)


def design(x: np.ndarray) -> np.ndarray:
    """What the logistic layer sees of rows of ``counts``.

    Matches in quotation count for ``QUOTED`` of one. Misspelled matches join the exact ones, each for ``MISSPELLED`` of one, so that they weigh what exact ones were learned to weigh
    even if the labelled rows have none; a column of their own lets labels say otherwise.
    """
    exact, edits, stems = np.expm1(x[:, 1:4]).T
    own = 1 - (1 - QUOTED) * x[:, 5]
    return np.stack([x[:, 0], np.log1p(own * (exact + MISSPELLED * edits)), np.log1p(own * edits), np.log1p(own * stems), own * x[:, 4], x[:, 5], x[:, 6]], 1)


def counts(text: str, lexicon: Lexicon) -> np.ndarray:
    """Bias, then log counts of exact, misspelled and stem matches, share of words, and counts of quoted and addressed matches. A misspelled stem is misspelled."""
    out = np.zeros(7)
    out[0] = 1.0
    low = text.lower()
    ws = _WORD.findall(low)
    known = lexicon.words
    hit = {w for w in set(ws) if known.get(w, 0) is not None and lexicon.match(w) is not None}
    masked = {m.start(): m.group() for m in _MASKED.finditer(low) if hit.isdisjoint(_WORD.findall(m.group())) and lexicon.match(m.group()) is not None}
    if not hit and not masked:
        return out
    spans = [(m.start(), m.end()) for m in _WORD.finditer(low)]
    quoted = addressed = 0
    kinds = [0, 0, 0]
    for i, w in enumerate(ws):
        w = masked.get(spans[i][0], w)
        if w not in hit and spans[i][0] not in masked:
            continue
        k, e = lexicon.match(w)
        kinds[1 if e else 2 if lexicon.terms[k][1] else 0] += 1
        near = ws[max(0, i - WINDOW) : i + WINDOW + 1]
        before, after = low[spans[max(0, i - WINDOW)][0] : spans[i][0]], low[spans[i][1] : spans[min(len(ws) - 1, i + WINDOW)][1] + 1]
        if in_quotes(before, after) or any(x in REPORTING for x in near[: min(i, WINDOW)]):
            quoted += 1
        if any(x in ADDRESS for x in near):
            addressed += 1
    total = sum(kinds)
    out[1:4] = np.log1p(kinds)
    out[4:] = min(1.0, 20 * total / len(ws)), quoted / total, addressed / total
    return out


def clean_words(texts: list[str], labels: list[int], lexicon: Lexicon) -> frozenset[str]:
    """Words that are within the edits of a term but belong to clean texts, by the rule that also keeps clean words from being terms; and the terms
    that clean words come near so often by chance that new ones will too: words seen in one clean text only tell how often (Good and Turing)."""
    seen: tuple[Counter, Counter] = Counter(), Counter()
    for t, y in zip(texts, labels, strict=True):
        low = t.lower()
        seen[y].update(w for w in {*_WORD.findall(low), *_MASKED.findall(low)} if (m := lexicon.match(w)) is not None and m[1])
    n_toxic = max(1, sum(labels))
    n_clean = max(1, len(labels) - n_toxic)
    plain = {w for w, n in seen[0].items() if n / n_clean > MAX_CLEAN_SHARE * seen[1][w] / n_toxic}
    once = Counter(lexicon.terms[lexicon.match(w)[0]][0] for w in plain if seen[0][w] == 1)
    return frozenset(plain | {t for t, n in once.items() if n / n_clean > MAX_CHANCE})


def fit(texts: list[str], labels: list[int]) -> tuple[list[tuple[str, bool]], frozenset[str], np.ndarray]:
    """(terms, words that only match as they are, weights)."""
    terms = sorted({(t, False) for t in SEED_TERMS} | set(mine(texts, labels)))
    y = np.array(labels, float)
    near = Lexicon(terms)
    plain = clean_words(texts, labels, near)
    if len(set(labels)) < 2:
        return terms, plain, FIXED
    # Weights see a text as they will see new ones: with the clean words of the other half only.
    halves = [Lexicon(terms, clean_words(texts[1 - h :: 2], labels[1 - h :: 2], near)) for h in (0, 1)]
    x = design(np.stack([counts(t, halves[i % 2]) for i, t in enumerate(texts)]))
    w = FIXED.copy()
    ridge = np.where(np.arange(len(FIXED)) == 2, 1.0, 0.05)  # what sets misspelled matches apart takes more evidence
    for _ in range(50):  # Newton steps with a ridge around the fixed weights
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - FIXED)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        w -= np.clip(step, -1, 1)
        w[[1, 3]] = np.maximum(w[[1, 3]], 0)  # a match never speaks for a text
        w[2] = max(w[2], -MISSPELLED * w[1])
        if np.abs(step).max() < 1e-6:
            break
    return terms, plain, w


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_train: int = MAX_TRAIN) -> tuple[list[tuple[str, bool]], frozenset[str], np.ndarray]:
    """Fit on the bounded sample of labelled rows for which ``learn`` holds."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).filter(learn)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # At most max_train ids and texts of MAX_TRAIN_BYTES each: longer documents are scored, not learned from.
    few = docs.select("doc_id", "text").filter(F.octet_length("text") <= MAX_TRAIN_BYTES).join(F.broadcast(chosen), "doc_id")
    sample = few.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toPandas().sort_values("doc_id")
    return fit(sample["text"].tolist(), sample["y"].tolist())


def score(docs: DataFrame, model: tuple[list[tuple[str, bool]], frozenset[str], np.ndarray]) -> DataFrame:
    """(doc_id, score, n_matches) of each row."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        terms, plain, weights = held.value
        lexicon = Lexicon(terms, plain)
        for batch in batches:
            x = np.stack([counts(t.as_py() or "", lexicon) for t in batch.column(1)]) if len(batch) else np.empty((0, 7))
            p = 1 / (1 + np.exp(-np.clip(design(x) @ weights, -30, 30)))
            n = np.rint(np.expm1(x[:, 1:4]).sum(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(n)], ["doc_id", "score", "n_matches"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double, n_matches long")


FOLDS, HELD_OUT = 4, 2


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    model = train(docs, labels, ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_matches")
