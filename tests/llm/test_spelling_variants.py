"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from punctaria.llm import spelling_variants as V


def edits_one(a, b):
    """By the full table of edit distances."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1] == 1


def plain_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_variants(words):
    near = {w: [v for v in words if edits_one(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def made_words(rng, n, letters="abcé", shortest=6, longest=9):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(shortest, longest))) for _ in range(n)]


def rows_of(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_shard_finds_all_near_words_and_no_others():
    rng = random.Random(1)
    words = list(dict.fromkeys(made_words(rng, 300, "ab", 6, 8) + ["prefix" + w for w in made_words(rng, 120, "abcd", 5, 7)] + [w + "a" * 60 for w in made_words(rng, 30, "ab", 2, 4)]))
    shard = V.Shard()
    for w in words:
        shard.add(w[: len(w) // 2], True, w, 1)
        shard.add(w[len(w) // 2 :], False, w, 1)
    for w in words:
        assert {v for v, _ in shard.scan(w)} == {v for v in words if edits_one(w, v)}, w
    assert any(half.index is not None for held in shard.halves.values() for half in held.values())
    assert all(V.near(a, b) == edits_one(a, b) for a in words[::7] for b in words[::5])
    assert list(V.Shard().scan("anything")) == []


@pytest.mark.parametrize("half_words", [V.HALF_WORDS, 7])
def test_variants_against_all_pairs(spark, monkeypatch, half_words):
    monkeypatch.setattr(V, "HALF_WORDS", half_words)
    monkeypatch.setattr(V, "SHARD_WORDS", 40)
    rng = random.Random(2)
    words = {w: 5 ** rng.randint(1, 5) + rng.randint(0, 3) for w in made_words(rng, 400) + ["common" + w for w in made_words(rng, 150, "ab", 2, 6)]}
    got = rows_of(V.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain_variants(words)
    assert any(f is not None and f != r for _, f, r, *_ in got)


def test_query_against_plain_counts(spark):
    rng = random.Random(3)
    vocabulary = made_words(rng, 60, "abcdé", 6, 8) + ["Überfluß", "naïveté", "ÀÉÎÕÜ×÷", "short"]
    rows = [(rng.choice([None, i, i, i]), " ".join(rng.choice(vocabulary[: 5 + i % 60]) for _ in range(rng.randint(0, 300)))) for i in range(400)]
    rows += [(1, None), (2, ""), (3, "İSTANBUL " * 9), (4, "x" * 3_000 + " " + "x" * 2_999 + "y")] * 5 + [rows[0]] * 3
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, word string, n long").repartition(5)
    got = rows_of(V.query(docs))
    assert got == plain_variants(plain_counts(rows))
    assert any(form for _, form, *_ in got)


def test_empty_table(spark):
    got = V.query(spark.createDataFrame([], "doc_id long, text string"))
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert got.count() == 0
