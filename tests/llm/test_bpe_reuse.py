"""Byte-pair encoding by shared chunks against the tokenizers library on whole texts."""

import hashlib
import random

import numpy as np
import pytest

from punctaria.llm import bpe_reuse as B


@pytest.fixture(scope="module")
def content():
    with open(B.default_vocabulary(), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(content):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content)


HARD = [
    "It's we'll I'M 'S don'́t x's", "été É ́a ́", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|> <|end", "가 ᄀ ᅡᆨ", "ΣΑΣ Σας İi ǅ ß",
    "12 345,6 7 8\x1c9\x85x", "\x02 a\x02b \x02\x02", "日本語のテキスト。漢字", "🙂👩‍👩‍👧!!! ...", "\t\n\r\x0b\x0c", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "q̣̇ q̣̇",
]


def made_text(rng, n):
    return "".join(rng.choice(HARD + [" ", " ", "\n", "the", " of ", "Überraschung ", "word"]) for _ in range(n))


def test_repaired_joins_give_the_ids_of_whole_texts(content, library):
    encoder, rng = B.Encoder(content), random.Random(3)
    for _ in range(300):
        text = made_text(rng, rng.randint(1, 12))
        expected = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text.encode()).tolist() == expected, text
        at = sorted(rng.sample(range(1, len(text) + 1), min(len(text), rng.randint(1, 8))))
        parts = [text[a:b].encode() for a, b in zip([0, *at], [*at, len(text)], strict=True) if a < b]
        assert B.joined(encoder, (encoder.piece(p) for p in parts)).tolist() == expected, parts
        ids = np.array(expected, np.uint16)
        assert encoder.decode(ids).decode() == library.decode(expected, skip_special_tokens=False)


def test_cuts_depend_on_content_alone():
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh é\n") for _ in range(20_000))
    a, b = ("x" * 777 + passage).encode(), ("yz " * 1500 + passage).encode()
    chunks = [{t[lo:hi] for lo, hi in zip([0, *B.cuts(t)[:-1]], B.cuts(t), strict=True)} for t in (a, b)]
    assert len(chunks[0] & chunks[1]) > 0.6 * len(chunks[0])
    for t in (a, b, b"", b"z", ("é" * 200_000).encode()):
        ends = B.cuts(t)
        assert (ends[-1] if ends else 0) == len(t)
        assert all(hi - lo <= B.MAX_BYTES for lo, hi in zip([0, *ends], ends, strict=False))
        for lo, hi in zip([0, *ends], ends, strict=False):
            t[lo:hi].decode()


def plain(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_query_against_the_library(spark, library):
    rng = random.Random(7)
    passage = " ".join(rng.choice(HARD + ["plain", "words", "over", "and", "over"]) + str(rng.randint(0, 99)) for _ in range(1500))
    rows = [(i, (made_text(rng, 5) * rng.randint(0, 60)) + (passage if i % 3 == 0 else passage[rng.randint(0, 5000) :][:9000] if i % 3 == 1 else ""), "en", i) for i in range(60)]
    rows += [(None, "null id", "x", 1), (None, passage, "x", 1), (7, "again", None, None), (7, "again", None, None), (8, None, None, None), (9, "", "q", 3), (10, " \n ", "q", 3), (11, passage * 8, "q", 1), (12, "漢字" * 60_000, "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, row long").repartition(6)
    got = sorted(map(repr, ((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in B.query(docs).collect())))
    assert got == sorted(repr((d, *plain(library, t))) for d, t, _, _ in rows)


def test_ids_and_round_trip(spark, library):
    docs = spark.createDataFrame([(i, f"The same passage again, {i % 3}. " * 200) for i in range(12)], "doc_id long, text string")
    encoded = B.encode(docs)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in docs.collect()}
    texts = {r["doc_id"]: r["text"] for r in B.decode(encoded).collect()}
    assert texts == {r["doc_id"]: library.decode(r["ids"], skip_special_tokens=False) for r in encoded.collect()}


def test_empty_table(spark):
    got = B.query(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == 0


def test_a_vocabulary_that_keeps_white_space_is_refused():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        B.Encoder(f.read())
