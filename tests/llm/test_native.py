"""Quality rules, URL filters and decontamination."""

import pytest
from pyspark.sql import functions as F

from punctaria.llm import decontamination, quality_rules, registry, url_filters

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The garden of the house was quiet, and the children were in the kitchen with their mother. It is for them that we wrote this, and that is all there was to say on the matter."
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "a b c d e f g h a b c d e f g h i", "en"), (5, "x\n\nx\r\nx\n y \n y ", "fr"), (6, "word " * 3000, "en"), (7, "$$$ ### " * 60, "en"), (None, PROSE, "en"), (8, PROSE, None), (8, PROSE, None),
    (9, "é" * 40 + " Ünï " * 30, "de"), (10, "one two three four five six seven eight\x0bone two three four five six seven eight", "xx"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, lang, None, None) for d, t, lang in rows], SCHEMA)


def test_base_counts_on_the_table_and_odd_texts(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), docs_of(spark, ODD)):
        got = quality_rules.judge(docs).select("text", *quality_rules.RESULT[1:7]).collect()
        assert all(tuple(r)[1:] == brute.base_counts(r["text"]) for r in got)
        assert len(got) == docs.count()


def test_verdicts(spark):
    rows = ODD + [(20 + k, PROSE.replace("garden", f"garden{k}"), "en") for k in range(30)] + [(60, "§%$ 73# @@ ~~ ^^ <> {} [] == ++ " * 20, "en"), (61, "漢字" * 200 + " かな" * 200, "ja")]
    got = {r["doc_id"]: r for r in quality_rules.query(docs_of(spark, rows)).collect()}
    assert all(got[20 + k]["kept"] for k in range(30))
    assert not got[60]["base_failed"] or not got[60]["kept"]
    assert got[60]["class_js"] > quality_rules.MAX_CLASS_JS and not got[60]["kept"]
    assert got[61]["kept"] == (not got[61]["base_failed"])  # no reference for its language
    assert not got[1]["kept"] and not got[2]["kept"]


def test_divergence_is_the_jensen_shannon_distance(spark):
    import numpy as np

    p, q = np.array([0.2, 0.5, 0.3, 0.0]), np.array([0.0, 0.4, 0.4, 0.2])
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    df = spark.createDataFrame([(p.tolist(),)], "p array<double>")
    got = df.select(quality_rules._js_distance(F.col("p"), q.tolist())).first()[0]
    assert got == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


def test_filter_returns_the_columns_it_got(spark):
    docs = docs_of(spark, ODD).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(1)).withColumn("w", F.lit(2))
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns and set(r["kept"] for r in out.collect()) <= {"mine"}
    want = [r["doc_id"] for r in quality_rules.query(docs_of(spark, ODD)).collect() if r["kept"]]
    assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in out.collect())
    assert quality_rules.keep_good(docs.limit(0)).count() == 0
    assert quality_rules.query(docs.limit(0)).count() == 0


URLS = [
    (1, "http://a.net/x"), (2, "https://WWW.Example.NET/en/1"), (3, "http://example.net/fr"), (4, "http://sub.example.com/de/1?x"), (5, "http://example.com/en"), (6, "ftp://b.org/fr/"), (7, "http://b.org/de/"), (8, "no url"), (9, None), (10, "http://net"), (11, "http://notexample.com/de/1"), (12, "://x.net/#f"), (13, "HTTP://A.NET?q=http://b.org/fr/"), (13, "HTTP://A.NET?q=http://b.org/fr/"),
]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = brute.low(__import__("re").split(r"[/?#]", rest)[0])
    path = __import__("re").split(r"[?#]", rest[len(host) :])[0]
    fits = [(len(r), r, a) for a, r in url_filters.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits)[1:] if fits else None


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in URLS], "page_id long, url string, html string")
    got = url_filters.query(pages).collect()
    assert len(got) == len(URLS)
    urls = dict(URLS)
    for r in got:
        host, path, rule = plain_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule[0] if rule else None, rule[1] if rule else "allow")


def test_table_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    for r in registry.op5_url_filters(spark, SF).collect():
        host, path, rule = plain_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule[0] if rule else None)


def test_aliases_take_a_block_unless_one_is_allowed(spark):
    link = '<html><head><link href="{}" rel="canonical"></head></html>'
    rows = [
        (1, "http://a.com/1", link.format("http://bad.net/p")),  # canonical target is blocked by rule
        (2, "http://b.com/2", '<meta http-equiv="refresh" content="0; url=http://a.com/1">'),  # two steps away
        (3, "http://c.com/3", link.format("/4")), (4, "http://www.c.com/4?utm_source=x#y", None),
        (5, "http://d.com/5", link.format("http://other.net/q")), (6, "http://example.net/en/6", link.format("http://d.com/5")),  # an allow in the component
        (7, "http://e.com/7", "<link rel=canonical href=//bad.net/p/>"), (8, "http://e.com/7", None), (9, None, link.format("http://bad.net/p")), (10, "http://f.com", "<link rel='canonical'"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "allow", 10: "allow"}
    log = spark.createDataFrame([("http://f.com/", "http://bad.net/p"), (None, "x")], "src string, dst string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, redirects=log).collect()}[10] == "block"
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_contamination_on_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute.contamination(docs, items)
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.op10_decontamination(spark, SF).collect()}
    assert got == want and any(w[4] for w in want.values())


def test_odd_items_and_documents(spark, monkeypatch):
    long = " ".join(f"w{k}" for k in range(30))
    items = [(1, None), (2, ""), (3, "Short ITEM"), (4, long), (5, long), (10, "ÉTÉ été"), (None, "null item here")]
    docs = [(1, None), (2, ""), (3, "a short item, a SHORT   item"), (4, f"x {long} y {long}"), (5, " ".join(long.split()[3:12])), (6, " ".join(long.split()[3:13])), (7, "ÉTÉ été ete"), (8, "filler " * 20000 + long), (9, "the null item here"), (4, "short item"), (None, long), (None, long)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit(0)).withColumn("start", F.lit(0))
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(dict(enumerate(t for _, t in docs)), [("" if k is None else k, t) for k, t in items])
    for block in (decontamination.BLOCK_WINDOWS, 5):  # several broadcasts give the same
        monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", block)
        got = sorted((str(r["doc_id"]), tuple(r)[1:]) for r in decontamination.query(d, i).collect())
        assert got == sorted((str(docs[k][0]), w) for k, w in want.items())
    kept = decontamination.keep_clean(d, i)
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(docs[k][0]) for k, w in want.items() if not w[4])
    assert decontamination.query(d.limit(0), i).count() == 0
    assert not any(r["contaminated"] for r in decontamination.query(d, i.limit(0)).collect())


def test_texts_of_few_common_words_diverge(spark):
    words = [f"zq{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows = [(k, f"{PROSE} {k} " + " ".join(PROSE.split()[::-1]), "en") for k in range(20)]
    rows += [(50, " | ".join(words), "en"), (51, " ".join(words), None), (52, " ".join(words[:40]), "en"), (53, " ".join(f"the {w} the" for w in words), "en"), (54, " ".join(words), "pl")]
    got = {r["doc_id"]: r for r in quality_rules.query(docs_of(spark, rows)).collect()}
    assert not any(got[k]["base_failed"] for k in (50, 51, 52, 53, 54))
    refs = quality_rules.references(docs_of(spark, rows[:20]))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs_of(spark, rows), refs).collect()}
    assert got == {k: k not in (50, 51, 53) for k in got}  # 52 is short, 54 has no reference for its language


def test_labelled_junk_is_rejected_and_prose_kept(spark):
    sf = SF.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = quality_rules.query(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double"))).collect()
    kept = {r[0]: r[1] for r in got}
    assert kept[0] < 0.06 and kept[1] > 0.99


def generated_pages(rng, n=400):
    """Pages of a few hundred names with chains, cycles, stars, self-links, repeated urls and links of every form."""
    hosts = ["a.com", "b.com", "shop.b.com", "x.net", "example.net", "sub.example.net", "example.com", "c.org", "d.edu", "Mixed.COM"]
    urls = [f"http://{h}/{p}" for h in hosts for p in ("", "en/1", "de/2", "fr/3", "fr/3?q=1", "q?x=1", *(f"p/{k}" for k in range(40)))]
    forms = ['<link rel="canonical" href="{}">', "<LINK href='{}' REL='Canonical'/>", '<meta http-equiv="refresh" content="0; url={}">', "<META HTTP-EQUIV=Refresh content='5;URL={}'>"]
    rows = []
    for k in range(n):
        url = urls[int(rng.integers(len(urls)))]
        links = [forms[int(rng.integers(4))].format(rng.choice([urls[int(rng.integers(len(urls)))], "/en/1", "//x.net/q", "4", "https://outside.net/z", "http://outside.edu/y"])) for _ in range(int(rng.choice([0, 0, 1])))]
        rows.append((k, url + str(rng.choice(["", "#top"])), "<html><link rel=stylesheet href=x.css>" + "".join(links) + "</html>"))
    rows += [(1000, None, forms[0].format("http://x.net/")), (1001, "no url", forms[0].format("http://x.net/")), (1002, "http://e.info/1", None), (1003, "http://e.info/2", "<link rel=canonical"), (1004, "http://e.info/3", '<link rel="canonical" href="">')]
    return rows


def plain_verdicts(rows):
    import re

    def parts(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
        return (brute.low(m[1]), m[2], m[3] or "") if m else ("", "", "")

    def name(url):
        host, path, query = parts(url)
        return host + (path or "/") + ("?" + query if query else "") if host else None

    parent, decided = {}, {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, url, _ in rows:
        rule = plain_rule(url)[2]
        if name(url) and rule:
            decided.setdefault(name(url), set()).add(rule[1])
    for _, url, html in rows:
        host, path, _ = parts(url)
        tags = re.findall(r"(?is)<link\b[^>]*>|<meta\b[^>]*>", html or "")
        for t in tags:
            m = re.search(r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", t) if re.match("(?i)<link", t) and re.search(r"""(?i)rel\s*=\s*["']?canonical""", t) else re.search(r"""(?is)content\s*=\s*["'][^"'>]*?url\s*=\s*([^"'\s>]+)""", t) if re.search("(?i)http-equiv", t) else None
            if not m or not name(url):
                continue
            to = m[1] if re.match("(?i)[a-z][a-z0-9+.-]*://", m[1]) else "http:" + m[1] if m[1].startswith("//") else f"http://{host}{m[1]}" if m[1].startswith("/") else f"http://{host}{re.sub('[^/]*$', '', path) or '/'}{m[1]}"
            if name(to):
                rule = plain_rule(to)[2]
                if rule:
                    decided.setdefault(name(to), set()).add(rule[1])
                parent[root(name(url))] = root(name(to))
    groups = {}
    for k, actions in decided.items():
        groups.setdefault(root(k), set()).update(actions)
    out = {}
    for i, url, _ in rows:
        host, path, rule = plain_rule(url)
        out[i] = (host, path, rule[0] if rule else None, rule[1] if rule else "block" if name(url) and groups.get(root(name(url))) == {"block"} else "allow")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_generated_pages_against_brute_force_and_sql(spark, seed):
    import duckdb
    import numpy as np

    rows = generated_pages(np.random.default_rng(seed), 120 if seed == 1 else 300)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("rule", F.lit("x"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.query(pages).collect()}
    want = plain_verdicts(rows)
    assert got == want
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.execute(registry.SQL["op5_url_filters"]).fetchall()} == want
    free = {i for i, w in want.items() if w[2] is None}
    assert any(want[i][3] == "block" for i in free) and any(want[i][3] == "allow" for i in free)


def test_spellings_are_one_only_if_asked_for(spark):
    rows = [(1, "http://www.a.com/x?utm_source=1", '<link rel="canonical" href="http://bad.net/p">'), (2, "http://a.com/x/", None), (3, "http://www.a.com/x?utm_source=1#f", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdicts = lambda **k: {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, **k).collect()}
    assert verdicts() == {1: "block", 2: "allow", 3: "block"} and verdicts(spellings=True) == {1: "block", 2: "block", 3: "block"}


def test_without_a_language_column_only_the_base_judges(spark):
    docs = docs_of(spark, ODD).drop("lang")
    assert all(r["kept"] == (not r["base_failed"]) for r in quality_rules.query(docs).collect())
    assert quality_rules.keep_good(docs).columns == docs.columns


def plain_verdict(text, lang, refs):
    """``kept`` of a text by plain Python."""
    import math
    import re

    t = text or ""
    base = brute.base_counts(t)
    if base[5]:
        return False
    if not refs or (lang is not None and lang not in [r[0] for r in refs]):
        return True

    def js(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        kl = lambda xs: sum(x * math.log2(x / y) for x, y in zip(xs, m, strict=True) if x > 0)
        return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))

    ws, vocabulary = brute.WORD.findall(t), sorted({w for v in quality_rules.COMMON_WORDS.values() for w in v})
    counts = [ws.count(w) for w in vocabulary]
    shares = [c / len(ws) for c in [*counts, len(ws) - sum(counts)]]
    plain = [c for c in t if c in "abcdefghijklmnopqrstuvwxyz"]
    classes = [sum(bool(re.match(p, c)) for c in t) for p in quality_rules.CLASSES.values()]
    space, wide = sum(c in " \t\n\v\f\r" for c in t), sum(ord(c) > 0x7F for c in t)
    other = len(t) - sum(classes) - space - wide - len(plain)
    classes += [other, space, len(t.encode()) - len(t), len(plain) + wide]
    total = max(sum(classes), 1)
    near_class = min(js([c / total for c in classes], r[1]) for r in refs)
    like_one = any(js(shares, r[2]) ** 2 <= quality_rules.max_word_js(r[2]) ** 2 + quality_rules.WORD_NOISE / len(ws) for r in refs)
    return not ((len(t) >= quality_rules.GUARD_CHARS and near_class > quality_rules.MAX_CLASS_JS) or (len(ws) >= quality_rules.GUARD_WORDS and not like_one))


def test_verdicts_against_plain_divergences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").unionByName(docs_of(spark, ODD).select("doc_id", "text", "lang"))
    refs = quality_rules.references(docs)
    got = quality_rules.judge(docs, refs).select("text", "lang", "kept").collect()
    assert all(r["kept"] == plain_verdict(r["text"], r["lang"], refs) for r in got)
    assert len({r["kept"] for r in got}) == 2
