"""Toxicity, quality, language, training order and packing."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctaria.llm import language_id, lengths, packing, quality_classifier, registry, toxicity, training_order
from punctaria.llm.common import fold, read

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "123 !!! ???"), (5, "word " * 30_000), (6, "😀😀"), (None, "some text here"), (7, "same"), (7, "same"), (8, "漢字かな"), (9, "a\x00b")]


def odd(spark):
    return spark.createDataFrame([(d, t, None, "en", 1, "x") for d, t in ODD], "doc_id long, text string, score double, lang string, predicted int, held_out string")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_levenshtein():
    terms = ["idiot", "pathetic", "disgusting", "scum", "worthless"]
    lexicon = toxicity.Lexicon([(t, False) for t in terms])
    rng = np.random.default_rng(0)
    words = set(terms)
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(rng.integers(0, 4)):
                k = rng.integers(0, len(w) + 1)
                w[k : k + rng.integers(0, 2)] = list(rng.choice(list("abcdeitz"), rng.integers(0, 2)))
            words.add("".join(w))
    for w in words:
        near = [(distance(w, t), t) for t in terms if distance(w, t) <= toxicity.edits_allowed(t)]
        got = lexicon.match(w)
        assert (got is None) == (not near) and (got is None or (got[1], lexicon.terms[got[0]][0]) == min(near, key=lambda x: (x[0], x[1])))


def test_stems_and_context():
    lexicon = toxicity.Lexicon([("zork", True), ("idiot", False)])
    assert lexicon.match("zorkable") and not lexicon.match("zor") and not lexicon.match("azorkable")
    plain = toxicity.counts("you are an idiot", lexicon)
    quoted = toxicity.counts("the word “idiot” is in this book", lexicon)
    assert plain[6] == 1 and plain[5] == 0 and quoted[5] == 1
    assert toxicity.FIXED @ quoted < toxicity.FIXED @ plain


def test_toxicity_held_out(spark):
    sf = SF.replace("0.01", "0.1")  # toxic stems of other languages need more than a few labelled rows
    got = registry.op2_toxicity(spark, sf).join(read(spark, sf, "labels"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_quality_held_out(spark):
    got = registry.op6_quality_classifier(spark, SF).join(read(spark, SF, "labels"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9 and got.score.between(0, 1).all()


def test_language_held_out(spark):
    got = registry.op7_language_id(spark, SF).join(read(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_odd_texts_score(spark):
    docs, labels = odd(spark), read(spark, SF, "labels")
    few = spark.createDataFrame([(1, None, 1), (4, 1, None), (7, 0, 0), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for q in (toxicity.query, quality_classifier.query):
        for lab in (labels, labels.limit(0), few):
            rows = q(docs, lab).collect()
            assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        assert q(docs.limit(0), labels).count() == 0
    rows = language_id.query(docs).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 4, 6)} == dict.fromkeys((1, 2, 3, 4, 6), "und")
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (5, 7, None)} == {"en"}
    none = language_id.query(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and language_id.query(docs.limit(0)).count() == 0


def test_folds(spark):
    import zlib

    ids = [0, 1, 17, 123456, -5]
    got = {r["id"]: r["f"] for r in spark.createDataFrame([(i,) for i in ids], "id long").select("id", fold(F.col("id"), 4).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in ids}


def test_phrases_are_longest_matches():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 4, 200).tolist()
    table = language_id.parsing_table(language_id.automaton(sample))
    text = "".join(map(str, sample))
    streams = [rng.integers(0, 5, n).astype(np.uint8) for n in (0, 1, 7, 300, language_id.BLOCK + 50)]

    def plain(s):
        n, at = 0, 0
        while at < len(s):
            k = at + 1
            while k < len(s) and "".join(map(str, s[at : k + 1])) in text:
                k += 1
            n, at = n + 1, k
        return n

    want = [sum(plain(s[a : a + language_id.BLOCK].tolist()) for a in range(0, len(s), language_id.BLOCK)) for s in streams]
    assert language_id.phrases(streams, [table])[:, 0].tolist() == want


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = "The quick, brown föx\njumps " * 40
    whole = [np.sort(f) for f in quality_classifier.features(text)]
    monkeypatch.setattr(quality_classifier, "_PIECE", 64)
    assert all((np.sort(f) == w).all() for f, w in zip(quality_classifier.features(text), whole, strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_feistel_is_a_permutation(n):
    p = training_order.feistel(np.arange(n), n, 7)
    assert sorted(p.tolist()) == list(range(n)) and (training_order.feistel(p, n, 7, inverse=True) == np.arange(n)).all()
    assert n < 64 or (p != training_order.feistel(np.arange(n), n, 8)).any()


def test_shards_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([*ODD, *((100 + k, f"text number {k} " * (k + 1)) for k in range(60))], "doc_id long, text string").repartition(3)
    docs = docs.sortWithinPartitions("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    vocab, path = lengths.vocabulary(spark, lengths.VOCABULARY), (tmp_path / "out").as_uri()
    rows = training_order.materialise_order(docs, path, vocab, seq_len=32, shard_slots=20).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and all(r["byte_offset"] % 64 == 0 for r in rows) and len({r["shard"] for r in rows}) > 1
    ids = training_order.read_slots(path, 0, 10**9)
    assert (training_order.read_slots(path, 13, 30) == ids[13:43]).all()
    encode, got = lengths.encoder(vocab), []
    for r in sorted(rows, key=lambda r: r["seq"]):
        got += ids[r["slot"]][: r["n_tokens"]].tolist()
    pieces, now = [], []
    for t in got:
        if t == lengths.END:
            pieces.append(tuple(now))
            now = []
        else:
            now.append(t)
    want = [tuple(encode(r["text"]).tolist()) for r in docs.collect() if r["text"]]
    assert sorted(pieces) == sorted(want) and not now
    empty = training_order.materialise_order(docs.limit(0), (tmp_path / "none").as_uri(), vocab)
    assert empty.count() == 0 and len(training_order.read_slots((tmp_path / "none").as_uri(), 0, 5)) == 0


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(80):
        u, b = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        n = np.sort(rng.choice(np.arange(1, 40), u, replace=False))
        c = rng.integers(1, 20, u)
        cost = lambda bs: sum(int(c[i]) * (min(x for x in bs if x >= n[i]) - int(n[i])) for i in range(u))  # noqa: B023,E731
        best = min(cost((*x, int(n[-1]))) for r in range(min(b, u)) for x in itertools.combinations(n[:-1].tolist(), r))
        got = packing.optimal_boundaries(n, c, b)
        assert len(got) <= b and cost(got) == best


def test_batches_fit_and_hold_everything(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 50)
    rows = [(k % 400, int(v)) for k, v in enumerate(np.random.default_rng(3).geometric(0.01, 600))] + [(None, 5), (None, None), (7, 0), (8, 100_000)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=6, budget=2000).toPandas()
    assert len(out) == len(rows) and not out.duplicated(["bucket", "batch", "place"]).any()
    assert (out.n_tokens.fillna(0) <= out.bucket_length).all()
    size = out.groupby(["bucket", "batch"]).agg(n=("place", "size"), length=("bucket_length", "first"))
    assert ((size.n * size.length <= 2000) | (size.n == 1)).all()
    full = size.reset_index().groupby("bucket")
    assert all((g.n.iloc[:-1] == max(1, 2000 // g.length.iloc[0])).all() for _, g in full)
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_lengths_are_rounded_beyond_the_point_limit(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_POINTS", 10)
    out = packing.pack(spark.createDataFrame([(k, k + 1) for k in range(100)], "doc_id long, n_tokens long"), buckets=4).toPandas()
    assert (out.n_tokens <= out.bucket_length).all() and out.bucket.nunique() <= 4


def test_packing_of_texts(spark):
    out = packing.query(odd(spark)).collect()
    assert len(out) == len(ODD) and {r["n_tokens"] for r in out if r["doc_id"] in (1, 2)} == {0}


def least_padding(n, c, b):
    """By trying every last cut."""
    number = np.concatenate([[0], np.cumsum(c)])
    best = n * number[1:]
    for _ in range(1, b):
        best = np.array([min([best[j], *(best[k] + n[j] * (number[j + 1] - number[k + 1]) for k in range(j))]) for j in range(len(n))])
    return best[-1] - (n * c).sum()


@pytest.mark.parametrize("points", [packing.MAX_POINTS, 7])
def test_boundaries_are_lengths_and_pad_least_whatever_the_longest(spark, monkeypatch, points):
    monkeypatch.setattr(packing, "MAX_POINTS", points)
    rng = np.random.default_rng(6)
    n = np.sort(np.concatenate([rng.choice(np.arange(1, 3000), 150, replace=False), [54_006, 2_000_001]]))
    c = rng.integers(1, 50, len(n))
    out = packing.pack(spark.createDataFrame([(k, int(v)) for k, v in enumerate(np.repeat(n, c))], "doc_id long, n_tokens long"), buckets=9).toPandas()
    assert set(out.bucket_length) <= set(n.tolist()) and out.bucket_length.nunique() <= 9
    assert (out.bucket_length - out.n_tokens).sum() == least_padding(n, c, 9)


def test_many_lengths_stay_exact():
    n = np.arange(1, 60_001)
    got = packing.optimal_boundaries(n, np.ones(len(n), int), 16)
    assert len(got) == 16 and np.diff([0, *got]).tolist() == [3750] * 16


def test_misspelled_short_terms_stems_and_masked_letters():
    lexicon = toxicity.Lexicon([*((t, False) for t in toxicity.SEED_TERMS), ("zorkels", True)], frozenset({"crown"}))
    for w, term in [("loserr", "loser"), ("clwn", "clown"), ("scumm", "scum"), ("mron", "moron"), ("zorkelsings", "zorkels"), ("zorklsings", "zorkels"), ("zoorkelsings", "zorkels")]:
        assert lexicon.terms[lexicon.match(w)[0]][0] == term
    assert lexicon.match("crown") is None and lexicon.match("clown") == (lexicon.terms.index(("clown", False)), 0) and lexicon.match("zork") is None
    for text in ("what a mor0n", "you st*pid", "tr4sh", "an idi0t here", "cl**n"):
        found = toxicity.counts(text, lexicon)
        assert (np.rint(np.expm1(found[1:4])).astype(int).tolist() == [0, 1, 0]) == (text != "cl**n")  # two edits of five letters
    assert np.expm1(toxicity.counts("me@idiot.com and scum-2", lexicon)[1]) == pytest.approx(2)
    assert toxicity.counts("don't mind the e-mail of 3rd parties", lexicon)[1:].sum() == 0


def test_clean_words_near_terms_are_learned():
    texts = [f"the crown of number {k} is gold" for k in range(30)] + [f"you clown {k} are trash" for k in range(30)]
    terms, plain, _ = toxicity.fit(texts, [0] * 30 + [1] * 30)
    assert "crown" in plain and toxicity.Lexicon(terms, plain).match("crown") is None
    assert toxicity.Lexicon(terms, plain).match("clwn") is not None


@pytest.mark.parametrize("kept", [0.0, training_order.KEPT, 1.0])
def test_slot_is_the_permutation_of_the_sequence_number(spark, tmp_path, monkeypatch, kept):
    monkeypatch.setattr(training_order, "KEPT", kept)
    docs = spark.createDataFrame([*ODD, *((100 + k, f"text number {k} " * (k + 1)) for k in range(60))], "doc_id long, text string").repartition(3).withColumn("slot", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("part", F.lit(2))
    vocab, path = lengths.vocabulary(spark, lengths.VOCABULARY), (tmp_path / "out").as_uri()
    rows = sorted(training_order.materialise_order(docs, path, vocab, seq_len=32, shard_slots=20).collect(), key=lambda r: r["seq"])
    n = len(rows)
    assert [r["seq"] for r in rows] == list(range(n)) and [r["slot"] for r in rows] == training_order.feistel(np.arange(n), n).tolist()
    assert training_order.feistel(np.array([r["slot"] for r in rows]), n, inverse=True).tolist() == list(range(n))
    assert all((r["shard"], r["byte_offset"]) == (r["slot"] // 20, r["slot"] % 20 * 64) for r in rows)
    files = sorted((tmp_path / "out").glob("shard-*.bin"))
    assert [f.stat().st_size for f in files] == [20 * 64] * (n // 20) + ([n % 20 * 64] if n % 20 else []) and not list((tmp_path / "out").glob("_shard*"))
    again = training_order.materialise_order(docs, path, vocab, seq_len=32, shard_slots=20)  # over the files of another attempt
    assert again.count() == n


@pytest.mark.parametrize("piece", [7, lengths.PIECE])
def test_pieces_give_the_ids_of_whole_texts(monkeypatch, piece):
    import random

    import tiktoken

    import base64

    content = open(lengths.VOCABULARY, "rb").read()
    encode, count = lengths.encoder(content), lengths.counter(content)
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
    plain = tiktoken.Encoding("plain", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(lengths, "PIECE", piece)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["a", "b1", "'s", "漢", "é", " ", "  ", "\n", "\n\n", "\t", "　", "\x1c", "!!", "12", "\xa0"]) for _ in range(rnd.randrange(25))) + " " * rnd.choice([0, 9]) + rnd.choice(["", "x", " y", "\n"]) for _ in range(3000)]
    texts += ["ab" * 65_000, "x-1" * 60_000, "漢字" * 60_000, "a " * 90_000, " " * 150_000 + "x", "q" + "\n" * 150_000]
    for t in texts:
        assert encode(t).tolist() == plain.encode_ordinary(t) and count(t) == len(encode(t))
    assert len(encode("z" + " " * 2_000_000 + "z")) > 1  # the library alone cannot


def test_misspelled_and_quoted_terms_in_held_out_rows(spark):
    """Edits find terms that are misspelled, and quotation lowers scores, though the labelled rows have neither."""
    import random
    import re

    sf = SF.replace("0.01", "0.1")
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").filter("toxic is not null and length(text) < 20000").select("doc_id", "text", "toxic").toPandas().sort_values("doc_id")
    import zlib

    held = np.array([zlib.crc32(str(i).encode()) % toxicity.FOLDS == toxicity.HELD_OUT for i in rows.doc_id])
    terms, plain, weights = toxicity.fit(rows.text[~held].tolist(), rows.toxic[~held].tolist())
    rnd, toxic = random.Random(5), rows.toxic[held].to_numpy() == 1

    def changed(t, f):
        return re.sub(r"\b(" + "|".join(toxicity.SEED_TERMS) + r")\b", lambda m: f(m.group()), t, flags=re.I)

    def typo(w):
        k = rnd.randrange(1, len(w) - 1)
        return w[:k] + rnd.choice(["", w[k] * 2, "x"]) + w[k + 1 :]

    full, exact = toxicity.Lexicon(terms, plain), toxicity.Lexicon(terms, plain)
    exact.reach = [0] * len(exact.reach)
    exact._forget()
    score = lambda texts, lexicon: 1 / (1 + np.exp(-(toxicity.design(np.stack([toxicity.counts(t, lexicon) for t in texts])) @ weights)))
    texts = rows.text[held].tolist()
    typos = [changed(t, typo) for t in texts]
    with_edits, without = score(typos, full) >= 0.3, score(typos, exact) >= 0.3
    assert with_edits[toxic].mean() > without[toxic].mean() + 0.2 and with_edits[~toxic].mean() < 0.02
    quoted = score([changed(t, lambda w: f'"{w}"') for t in texts], full)
    as_is = score(texts, full)
    assert (quoted <= as_is + 1e-9).all() and quoted[toxic].mean() < as_is[toxic].mean() - 0.1
    assert weights[1] > 0 and toxicity.MISSPELLED * weights[1] + weights[2] > 0


def test_apostrophes_are_no_quotation():
    lexicon = toxicity.Lexicon([(t, False) for t in toxicity.SEED_TERMS])
    assert toxicity.counts("you don't listen you idiot and it's sad", lexicon)[5] == 0
    assert toxicity.counts("you don’t listen you idiot and it’s sad", lexicon)[5] == 0
    assert toxicity.counts('one "first" idiot "second" part', lexicon)[5] == 0
    assert all(toxicity.counts(t, lexicon)[5] == 1 for t in ('he was an "idiot" there', "das Wort „idiot“ hier", "un « idiot » là", "a “real idiot” here"))


def test_states_of_the_automaton_are_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_STATES", 5)
    lexicon = toxicity.Lexicon([(t, False) for t in toxicity.SEED_TERMS])
    assert [lexicon.match(w) is not None for w in ("idiot", "idoit", "pathetc", "worthles", "garden", "kitchen", "scumm")] == [True, False, True, True, False, False, True]
    assert len(lexicon.sets) < 50


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1.0
    return (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_quality_by_grams_alone_ranks_held_out_rows(spark):
    sf = SF.replace("0.01", "0.1")
    got = registry.op6_quality_classifier(spark, sf).join(read(spark, sf, "labels").filter("quality is not null"), "doc_id").toPandas()
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held.quality.to_numpy() == 1) > 0.94
    assert (held.predicted == 1)[held.quality == 1].mean() > 0.99


def test_quality_scores_against_plain_means(spark):
    """The query's scores are the softmax of means that a plain loop gives."""
    docs, labels = read(spark, SF.replace("0.01", "0.001"), "documents"), read(spark, SF.replace("0.01", "0.001"), "labels")
    weight, bias = quality_classifier.train(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0)
    weight = weight.astype(np.float32)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.query(docs, labels).collect()}
    for r in docs.select("doc_id", "text").collect():
        parts = [(s, [float(weight[b]) for b in f]) for s, f in zip(quality_classifier.SHARES, quality_classifier.features(r["text"] or ""), strict=True) if len(f)]
        z = bias + (sum(s * sum(v) / len(v) for s, v in parts) / sum(s for s, _ in parts) if parts else 0)
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
    words, pairs = quality_classifier.word_grams("The cat  the CAT\nthe")
    assert words[0] == words[2] == words[4] and words[1] == words[3] and pairs[0] == pairs[2] and len(pairs) == 4


def test_many_scripts_long_documents_and_small_samples(spark, monkeypatch):
    """Languages whose letters are none of the commonest, that only have documents beyond the learned part, or few words, are predicted too."""
    rng = np.random.default_rng(9)
    rows, scripts = [], {f"s{k:02d}": [chr(c) for c in range(0x4E00 + 300 * k, 0x4E00 + 300 * k + 60)] for k in range(12)}
    scripts |= {"high": [chr(c) for c in range(0x10400, 0x10420)], "latin": list("abcdefghij"), "latin2": list("jihgfklmno")}
    make = lambda letters, n: " ".join("".join(rng.choice(letters, int(rng.integers(2, 6)), p=None)) for _ in range(n))
    for lang, letters in scripts.items():
        rows += [(len(rows) + k, make(letters, 60), lang) for k in range(6)]
    rows += [(900, make([chr(c) for c in range(0x3B1, 0x3C9)], 9000), "long"), (901, "ოთხი სიტყვა", "few")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    new = [(5000 + k, make(letters, 30), lang) for k, (lang, letters) in enumerate(scripts.items())] + [(6000, make([chr(c) for c in range(0x3B1, 0x3C9)], 20), "long"), (6001, "სიტყვა", "few")]
    for total in (language_id.TOTAL_CHARS, 17 * 400):
        monkeypatch.setattr(language_id, "TOTAL_CHARS", total)
        model = language_id.train(docs, F.lit(True))
        assert model[0] == sorted({lang for _, _, lang in rows}) and max(len(t) for t in model[2]) <= 2 * min(language_id.TRAIN_CHARS, total // 17) + 2
        got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(spark.createDataFrame(new, "doc_id long, text string, lang string"), model).collect()}
        assert got == {d: lang for d, _, lang in new}


def test_symbols_write_rare_letters_out():
    alphabet = language_id.Alphabet(["abc" * 50 + "".join(chr(c) for c in range(0x4E00, 0x4E40))])
    got = alphabet.symbols(" Ab, \U00010401漢")
    assert (got[:2] < language_id._DIGIT).all() and got[2] == 0
    code = lambda part: sum((int(x) - language_id._DIGIT) << (4 * (language_id.DIGITS - 1 - k)) for k, x in enumerate(part))
    assert code(got[3:8]) == 0x10401 and (code(got[8:]) == 0x6F22 or len(got) == 9)


def test_predictions_against_a_plain_parser(spark):
    """The query's languages are those of a parser that looks phrases up in the sample's text."""
    rows = [(k, f"{w} garden of number {k} and the house" if k % 2 else f"{w} jardin de nombre {k} et la maison", "en" if k % 2 else "fr") for k, w in enumerate("alpha beta gamma delta kappa sigma theta omega".split())]
    docs = spark.createDataFrame([*rows, (50, "the house of the garden", None), (51, "la maison et le jardin", None), (52, "", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True))
    alphabet = language_id.Alphabet.__new__(language_id.Alphabet)
    alphabet.table, alphabet.low = model[1]
    samples = {}
    known = docs.filter("lang is not null").select("lang", F.xxhash64("doc_id", "text").alias("h"), "text").collect()
    for lang in model[0]:
        samples[lang] = "".join(chr(x) for r in sorted((r for r in known if r["lang"] == lang), key=lambda r: r["h"]) for x in [0, *alphabet.symbols(r["text"]).tolist()])
    for r in language_id.predict(docs, model).collect():
        s = "".join(map(chr, alphabet.symbols({d: t for d, t, _ in [*rows, (50, "the house of the garden", None), (51, "la maison et le jardin", None), (52, "", None)]}[r["doc_id"]])))
        bits = {}
        for lang, sample in samples.items():
            n, at = 0, 0
            while at < len(s):
                k = at + 1
                while k < len(s) and s[at : k + 1] in sample:
                    k += 1
                n, at = n + 1, k
            bits[lang] = n * np.log2(len(sample))
        assert r["lang_pred"] == (min(sorted(bits), key=bits.get) if s else "und")
