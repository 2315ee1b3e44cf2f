"""Near-dedup, suffix dedup and the pipeline against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from punctaria.llm import near_dedup, packing, suffix_dedup
from punctaria.llm.common import read

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def edited(words, n, rng):
    out = list(words)
    for k in rng.choice(len(out), n, replace=False):
        out[k] = f"e{rng.integers(1e9)}"
    return " ".join(out)


def test_near_groups_of_all_kinds(spark, table):
    rng = np.random.default_rng(3)
    docs = dict(table)
    base = [f"b{k}" for k in range(120)]
    for k in range(60):  # a large group around a base, most of it linked only through others
        docs[10_000 + k] = edited(base, int(rng.integers(0, 5)), rng)
    chain = [f"c{k}" for k in range(100)]
    for k in range(6):  # each like the next, ends unlike
        docs[11_000 + k] = " ".join(chain[:60] + [f"x{j}" for j in range(k)] + chain[60 + k :])
    common = " ".join(f"p{k}" for k in range(40))
    for k in range(40):  # a passage that unlike documents share
        docs[12_000 + k] = common + " " + " ".join(f"u{k}_{j}" for j in range(60))
    docs |= {13_000: None, 13_001: "", 13_002: " \n", 13_003: "Two words", 13_004: "two WORDS", 13_005: "a b c d e", 13_006: "A b c d e", 13_007: "word " * 40_000, 13_008: "word " * 9}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("sig", F.lit(1)).withColumn("kept", F.lit("mine"))
    want, sizes = brute.near_components(docs)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in near_dedup.query(frame).collect()}
    assert got == {d: (want[d], sizes[d], want[d] == d) for d in docs}
    kept = near_dedup.keep_one(frame, 85)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {d for d in docs if want[d] == d}
    want, _ = brute.near_components(docs, 80)
    assert {r["doc_id"] for r in near_dedup.keep_one(frame).collect()} == {d for d in docs if want[d] == d}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text), (1, text), (1, "another text of the same id here"), (2, text + " more"), (None, text), (None, text), (3, "unlike all of the others in here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_dedup.query(frame).collect())
    assert got == sorted([("1", "1", True)] * 3 + [("2", "1", False), ("3", "3", True)] + [("None", "None", True)] * 2)
    assert sorted(str(r["doc_id"]) for r in near_dedup.keep_one(frame).collect()) == ["1", "3", "None", "None"]
    assert near_dedup.query(frame.limit(0)).count() == near_dedup.keep_one(frame.limit(0)).count() == 0


def test_match_threshold():
    m = near_dedup.match_threshold(85, 32)
    assert 12 <= m <= 20 and near_dedup.match_threshold(95, 32) > m


def odd_texts(rng):
    passage = "".join(rng.choice(list("abcdefgh "), 300))
    other = lambda n: "".join(rng.choice(list("ijklmnop é"), n))
    rows = [(k, other(int(rng.integers(0, 400))) + passage[int(rng.integers(0, 90)) :] + other(int(rng.integers(0, 300)))) for k in range(25)]
    rows += [(30, None), (31, ""), (32, "x" * 199), (33, "y" * 200), (34, "z" * 201), (35, "abc" * 400), (36, "abc" * 300), (37, passage + passage), (38, other(3000)), (39, other(50))]
    rows += [(40, rows[0][1]), (41, rows[0][1]), (42, "é" * 150 + passage[:260] + "ü" * 90)]
    return rows


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("group", [suffix_dedup.GROUP_ROWS, 2])
def test_repeats_against_brute_force(spark, keep, group):
    rows = odd_texts(np.random.default_rng(8))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.lit("x")).withColumn("spans", F.lit(1))
    want = {d: brute.repeat_digest(*x) for (d, _), x in zip(rows, brute.repeat_spans(rows, keep=keep), strict=True)}
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digests(frame, keep=keep, group_rows=group).collect()}
    assert got == want


def test_long_text_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    a, b = ("".join(rng.choice(list("abcdefghijklmnop"), 1_200_000)) for _ in "ab")
    rows = [(1, a + "|" + b), (2, "-" + b[999_000:1_000_400] + "+" + a[1_048_000:1_049_500])]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2900, 2), 2: (2900, 2)}


def test_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(1)
    t, u = ("".join(rng.choice(list("abcdef"), 500)) for _ in "tu")
    rows = [(1, t), (1, t), (2, u), (2, u[:350] + t[:100]), (None, "q" + u[100:])]
    want = sorted((str(d), *brute.repeat_digest(*x)) for (d, _), x in zip(rows, brute.repeat_spans(rows), strict=True))
    got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in suffix_dedup.query(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want and [w[1:3] for w in want][:2] == [(500, 500)] * 2
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.query(empty).count() == suffix_dedup.remove_repeats(empty).count() == 0


def test_removal_keeps_characters_and_columns(spark):
    rows = odd_texts(np.random.default_rng(8))
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = suffix_dedup.remove_repeats(frame)
    assert out.columns == frame.columns
    want = {}
    for (d, t), (b, spans) in zip(rows, brute.repeat_spans(rows, keep="first"), strict=True):
        want[d] = suffix_dedup.cut_characters(b, spans) if spans else t
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {d: t for d, t in want.items() if not (t != dict(rows)[d] and not t.strip())}
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())


def test_ranks_are_suffix_order():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    rank = suffix_dedup.suffix_ranks(text, 20)
    keys = [text[i : i + 20].tobytes() for i in range(381)]
    order = sorted(range(381), key=lambda i: keys[i])
    assert all((rank[x] <= rank[y]) and ((rank[x] == rank[y]) == (keys[x] == keys[y])) for x, y in zip(order, order[1:], strict=False))
    earlier, later = suffix_dedup.previous_and_next(rank[:381])
    assert earlier.tolist() == [keys[i] in keys[:i] for i in range(381)] and later.tolist() == [keys[i] in keys[i + 1 :] for i in range(381)]


def test_pipeline_against_brute_force(spark):
    from punctaria.llm import quality_rules

    docs = read(spark, SF, "documents")
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    good = {r["doc_id"]: r["text"] for r in docs.join(quality_rules.query(docs).filter("kept"), "doc_id").select("doc_id", "text").collect()}
    component, _ = brute.near_components(good, 80)
    one = sorted((d, t) for d, t in good.items() if component[d] == d)
    cut = {d: suffix_dedup.cut_characters(b, spans) for (d, _), (b, spans) in zip(one, brute.repeat_spans(one, keep="first"), strict=True)}
    cut = {d: t for d, t in cut.items() if t.strip()}
    clean = {d for d, w in brute.contamination(cut, items).items() if not w[4]}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == clean and len(corpus_pipeline.STAGES) == 5
    from punctaria.llm.lengths import VOCABULARY, encoder, vocabulary

    encode = encoder(vocabulary(spark, VOCABULARY))
    assert all(got[d]["n_tokens"] == len(encode(cut[d])) <= got[d]["bucket_length"] for d in clean)
    room = {r["bucket"]: max(1, packing.BUDGET // r["bucket_length"]) for r in got.values()}
    assert all(r["place"] < room[r["bucket"]] for r in got.values())


def test_every_stage_returns_the_columns_of_documents(spark):
    docs = read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


def test_pipeline_stage_takes_a_similarity_of_80_percent(spark):
    rng = np.random.default_rng(5)
    docs = dict(read(spark, SF, "documents").select("doc_id", "text").collect())
    for k in range(60):  # pairs of 70 to 95 %: 0 to 30 of 200 words at the end differ
        words = [f"s{k}_{j}" for j in range(200)]
        docs[20_000 + 2 * k] = " ".join(words)
        docs[20_001 + 2 * k] = " ".join(words[: 200 - k // 2] + [f"t{k}_{j}" for j in range(k // 2)])
    docs[30_000] = " ".join(f"v{j}" for j in range(94))  # 90 shingles
    docs[30_001] = " ".join(f"v{j}" for j in range(84)) + " " + " ".join(f"w{j}" for j in range(10))  # 80 of 100
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want, _ = brute.near_components(docs, 80)
    other, _ = brute.near_components(docs)
    got = {r["doc_id"] for r in corpus_pipeline.distinct_documents(spark, frame, SF).collect()}
    assert got == {d for d in docs if want[d] == d} != {d for d in docs if other[d] == d}
    assert 30_001 not in got
    assert {r["doc_id"] for r in near_dedup.query(frame).filter("kept").collect()} == {d for d in docs if other[d] == d}


def test_previous_factors_against_a_plain_version():
    rng = np.random.default_rng(4)
    for n, letters, length in ((1, 2, 5), (2, 1, 5), (60, 1, 7), (300, 2, 20), (500, 3, 9), (400, 26, 30)):
        text = rng.integers(97, 97 + letters, n + length).astype(np.uint8)
        rank, levels = suffix_dedup.suffix_order(text, length)
        order = np.lexsort([np.arange(n), rank[:n]])
        s = [text[i : i + length].tobytes() for i in range(n)]
        common = lambda x, y: next((k for k in range(length) if x[k] != y[k]), length)  # noqa: E731, B023
        lcp = np.concatenate([[0], suffix_dedup.common_prefixes(text, levels, order[:-1], order[1:], length)]).astype(np.int64)
        assert lcp[1:].tolist() == [common(s[x], s[y]) for x, y in zip(order, order[1:], strict=False)]
        got = np.zeros(n, np.int64)
        got[order] = suffix_dedup.previous_factors(order, lcp)
        assert got.tolist() == [max((common(s[i], s[j]) for j in range(i)), default=0) for i in range(n)]


def test_rows_of_null_ids_are_told_apart_by_more_than_32_bits(spark):
    """Texts of one 32-bit hash, found by their birthday: neither takes the other's spans."""
    rng = np.random.default_rng(12)
    passages = ["".join(rng.choice(list("abcdefgh "), 300)) for _ in range(2)]
    n = 150_000
    made = spark.range(n).select("id", F.concat(F.lit(passages[0]), F.lit(" "), F.sha2(F.col("id").cast("string"), 256)).alias("t")).unionAll(spark.range(n).select("id", F.concat(F.lit(passages[1][:250]), F.lit(" "), F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256)).alias("t")))
    twins = made.groupBy(F.hash("t").alias("h")).agg(F.sort_array(F.collect_list("t")).alias("ts")).filter("size(ts) = 2").filter(F.substring(F.col("ts")[0], 1, 40) != F.substring(F.col("ts")[1], 1, 40)).orderBy("h").first()["ts"]
    rows = [(None, twins[0]), (None, twins[1]), (1, "one " + passages[0] + " tail"), (2, passages[1] + " other tail")]
    want = sorted((str(d), *brute.repeat_digest(*x)) for (d, _), x in zip(rows, brute.repeat_spans(rows), strict=True))
    got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in suffix_dedup.query(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want and min(w[2] for w in want) >= 250


def test_many_rows_of_one_id_and_text(spark):
    text = "".join(np.random.default_rng(3).choice(list("abcdef "), 400))
    frame = spark.createDataFrame([(1, text)] * 300 + [(2, text[:250])], "doc_id long, text string")
    got = {(r["doc_id"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.query(frame).collect()}
    assert got == {(1, 400, 1), (2, 250, 1)} and suffix_dedup.query(frame).count() == 301
