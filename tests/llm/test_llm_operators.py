"""The training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import gc
import hashlib
import random
import re
import weakref
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridquarry.llm import byte_bpe, common, decontam, html_extract, near_dedup, quality, queries, secrets, token_counts, token_files, toxicity, url_filters
from oracle import compare
from llm_cases import DOCS, ODD, brute_groups, brute_spans, reference_encoding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    n, bad = compare(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert n and not bad


# ---- words and components -----------------------------------------------------------------------------------------


def test_word_hashes_agree_with_words():
    rng = random.Random(1)
    for size in (0, 1, 50, 5000, 200_000):
        text = "".join(rng.choice("ab \t\n\x0bé c") for _ in range(size)).encode()
        words = text.split()
        hashes = common.word_hashes(text)
        assert len(hashes) == len(words)
        by = {}
        for w, h in zip(words, hashes.tolist()):
            assert by.setdefault(w, h) == h
        assert len(set(by.values())) == len(by)
    long = b"z" * 150_000
    assert len(set(common.word_hashes(long + b" " + long + b" a").tolist())) == 2


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(4000, 4100)]
    parent = list(range(6000))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    seen = {x for e in edges for x in e}
    assert all(got.get(x, x) == root(x) for x in seen)
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 1 ------------------------------------------------------------------------------------------------------------


def test_url_filters(spark):
    at = lambda s: F.to_timestamp(F.lit(s))
    captures = spark.sql(
        """SELECT * FROM VALUES (1, 'http://a.b.example.org/ads/x', timestamp'2024-03-05'), (2, 'http://a.b.example.org/ads/x', timestamp'2024-01-01'),
        (3, 'https://user@OTHER.org:80/p', timestamp'2024-03-05'), (4, NULL, timestamp'2024-03-05'), (5, 'no url', timestamp'2024-03-05'), (6, 'http://example.org', NULL),
        (7, 'http://xexample.org/', timestamp'2024-03-05'), (1, 'http://a.b.example.org/ads/x', timestamp'2024-03-05') AS t(page_id, url, fetched)"""
    ).withColumn("action", F.lit("clash"))
    entries = spark.sql(
        """SELECT * FROM VALUES ('example.org', 'block', timestamp'2024-02-01'), ('example.org', 'allow', timestamp'2024-04-01'), ('other.org', 'allow', timestamp'2024-01-01'), ('other.org', 'block', timestamp'2024-01-01'),
        ('a.b.example.org/ads', 'allow', timestamp'2024-03-01'), (NULL, 'block', timestamp'2020-01-01'), ('x', NULL, timestamp'2020-01-01') AS t(key, action, since)"""
    )
    rows = sorted((r["page_id"], r["matched_key"], r["allowed"]) for r in url_filters.filtered(captures, entries).na.fill("").collect())
    assert rows == [(1, "a.b.example.org/ads", True)] * 2 + [(2, "", True), (3, "other.org", False), (4, "", True), (5, "", True), (6, "", True), (7, "", True)]
    assert url_filters.filtered(captures.limit(0), entries).count() == 0
    assert url_filters.filtered(captures, entries.limit(0)).where("NOT allowed").count() == 0


def test_url_filters_of_any_length(spark):
    """Long hosts and paths, keys with upper case, single labels, and captures long after an open entry."""
    host = ".".join("abcdefghij") + ".Org"
    urls = [f"http://{host}/", f"http://x.{host}/", f"http://{host[2:]}/", "http://p.org/1/2/3/4/5/6", "http://p.org/1/2/3/4", "http://p.org/Ads/x", "http://p.org/ads/x", "http://q.zip/", "http://localhost/"]
    captures = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("fetched", F.to_timestamp(F.lit("2151-05-05")))
    keys = [host, "p.org/1/2/3/4/5", "P.org/Ads", "zip", "LOCALHOST"]
    entries = spark.createDataFrame([(k, "block") for k in keys], "key string, action string").withColumn("since", F.to_timestamp(F.lit("2024-01-01")))
    late = spark.createDataFrame([("zip", "allow")], "key string, action string").withColumn("since", F.to_timestamp(F.lit("2150-01-01")))
    want = {0: False, 1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False, 8: False}
    assert {r["page_id"]: r["allowed"] for r in url_filters.filtered(captures, entries).collect()} == want
    assert {r["page_id"]: r["allowed"] for r in url_filters.filtered(captures, entries.union(late)).collect()} == want | {7: True}


def test_url_filters_odd_times_and_names(spark):
    """Columns named like inner ones are kept; entries and captures of any year meet."""
    captures = spark.createDataFrame([(1, "http://a.org/", "x", 0), (2, "http://b.org/", "y", 1)], "page_id long, url string, hit string, month int")
    captures = captures.withColumn("key", F.lit("k")).withColumn("since", F.lit("s")).withColumn("until", F.lit("u")).withColumn("fetched", F.to_timestamp(F.when(F.col("page_id") == 1, "1971-05-05").otherwise("9990-01-01")))
    entries = spark.createDataFrame([("a.org", "block", "0300-01-01"), ("a.org", "allow", "1972-01-01"), ("b.org", "block", "9000-01-01")], "key string, action string, at string").select("key", "action", F.to_timestamp("at").alias("since"))
    rows = {r["page_id"]: r for r in url_filters.filtered(captures, entries).collect()}
    assert [(rows[i]["hit"], rows[i]["month"], rows[i]["key"], rows[i]["until"], rows[i]["allowed"]) for i in (1, 2)] == [("x", 0, "k", "u", False), ("y", 1, "k", "u", False)]
    assert url_filters.filtered(captures.withColumn("fetched", F.lit(None).cast("timestamp")), entries).where("allowed").count() == 2


# ---- 2 ------------------------------------------------------------------------------------------------------------


def test_html_of_the_tables(spark):
    """The tables' pages hold their text in one article of a heading and paragraphs."""
    import html

    n = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = r["html"].partition("<article>")[2].partition("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", body)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts]
        assert html_extract.main_text(r["html"]) == "\n".join(w for w in want if w), r["page_id"]
        n += 1
    assert n


PAGE = """<!doctype html><html><head><title>T</title><script>if (a<b) x="<p>no</p>"</script></head><body>
<header class="site-header"><a href=/>Home</a></header><div id=menu><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>
<div class="cookie-notice">We use cookies, accept them.</div>
<div class="content"><h1>A&nbsp;title &amp; more</h1><p>First paragraph, with <b>bold</b> and <a href=x>a link</a>, is long enough to count.
<p>Second paragraph:<br>it has a break, an entity &eacute; and &#x41;.<ul><li>An item of the article, also text.</ul>
<form><label>Your name</label><input></form><div class="ad-box">Buy now!</div><style>p{}</style></div>
<aside>Related stories, many of them.</aside><section id="comments"><h2>Comments</h2><p>I, a reader, disagree with all of this text, at length.</p></section>
<footer>&copy; 2024</footer></body></html>"""


def test_html_rules():
    assert html_extract.main_text(PAGE).split("\n") == [
        "A title & more",
        "First paragraph, with bold and a link, is long enough to count.",
        "Second paragraph: it has a break, an entity é and A.",
        "An item of the article, also text.",
    ]


def test_html_names():
    text = "A long enough sentence, with commas, for the article of this page."
    for before, after in (("<article class='post has-sidebar'>", "</article>"), ("<main id=main><div class='with-comments'>", "</div></main>"), ("<div class=story>", "</div>")):
        page = f"<body><div class=leftnav><a href=x>Menu entry</a></div>{before}<p>{text}</p>{after}<div id='userComments'><p>{text} Not so.</p></div><article class=comment><p>{text} I agree.</p></article></body>"
        assert html_extract.main_text(page) == text, before


def test_html_parts():
    """A text that is split over parts is whole, with the lesser parts, with and without articles."""
    para = lambda n: [f"This is paragraph {i} of part {n}, long enough, with commas, to be content." for i in range(17 if n == 1 else 3)]
    put = lambda n: "".join(f"<p>{t}</p>" for t in para(n))
    want = "\n".join(para(1) + para(2))
    for tag, close in (('<div class="part">', "</div>"), ("<section>", "</section>"), ("<article>", "</article>")):
        page = f'<body><div class="menu"><a href="/">Home</a></div><div class="content">{tag}{put(1)}{close}{tag}{put(2)}{close}</div><footer>End.</footer></body>'
        assert html_extract.main_text(page) == want, tag



def paragraphs(n, k=8):
    return [f"This is paragraph {i} of part {n}, long enough, with commas, to be content of it." for i in range(k)]


def put(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_html_spans():
    """The whole span of a text without article elements, and nothing beside it, without telling class names."""
    want = "\n".join(paragraphs(1, 1) + paragraphs(2))
    assert html_extract.main_text(f"<div class=content><div class=lead>{put(paragraphs(1, 1))}</div><div class=rest>{put(paragraphs(2))}</div></div>") == want
    links, end = "<a href=1>Home</a> <a href=2>News</a>", "Copyright notice 2024"
    for menu, foot in ((links, end), (f"<p>{links}</p>", f"<p>{end}</p>"), ("<ul><li><a href=1>Home</a><li><a href=2>News</a></ul>", f"<p>{end}</p>")):
        page = f"<body><div>{menu}</div><div>{put(paragraphs(1))}</div><div>{foot}</div></body>"
        assert html_extract.main_text(page) == "\n".join(paragraphs(1))
        text = " ".join(paragraphs(1))
        assert html_extract.main_text(f"<body><div>{menu}</div><div>{text}</div><div>{foot}</div></body>") == text


def test_html_words_in_names():
    """A mark in a name that is about something else is kept, and one that names boilerplate is not, inside an article too."""
    kept = "<p class=share-price>The price rose.</p><p class='notice-board'>A board.</p><p class=banner-story>Story.</p><table class=menu-prices><tr><td>Soup</td><td>5</td></tr></table>"
    gone = "<div class=ad-box>Buy now!</div><div class='post share-buttons'>Tell others.</div><div class=userComments><p>Not so, says a reader.</p></div>"
    want = paragraphs(1) + ["The price rose.", "A board.", "Story.", "Soup", "5"] + paragraphs(2)
    for tag in ("article", "div"):
        page = f"<body><{tag}>{put(paragraphs(1))}{kept}{gone}{put(paragraphs(2))}</{tag}></body>"
        assert html_extract.main_text(page).split("\n") == want, tag
    assert html_extract.main_text("<div class=comment><p>Only a comment, alone on this page.</p></div>") == "Only a comment, alone on this page."


def test_html_formulas():
    page = "<article><p>The formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, see <svg><title>T</title><text>label</text></svg> <object>text</object>.</p></article>"
    assert html_extract.main_text(page) == "The formula x=2 holds, see label text."


def test_html_scores_decide(spark, monkeypatch):
    """With constant scores every page of the tables gets another text."""
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    own = [html_extract.main_text(p) for p in pages]
    monkeypatch.setattr(html_extract, "scores", lambda page, weights: [1.0] * len(page.node))
    assert not any(html_extract.main_text(p) == t for p, t in zip(pages, own))


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<p>" * 50_000 + "</b>" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, "<b><div>" * 50_000 + "</b>" * 50_000, "<ul><li>x" * 50_000, "<p><button>" + "<x>" * 50_000 + "<div></div>" * 50_000])
def test_html_depth(page):
    """Time and memory are linear in the page, however it nests."""
    import time
    import tracemalloc

    start = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - start < 20
    tracemalloc.start()
    html_extract.main_text(page[: len(page) // 4])
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()


def test_html_odd(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, "u", "<p>"), (4, "u", "<<<a<b <!-- x"), (5, "u", "plain text"), (6, "u", "<a" * 50_000), (7, "u", "<div>" * 3000 + "x"), (8, None, "<article><p>" + "word " * 100_000 + "</article>"), (8, None, "<article><p>a</p></article>"), (9, "u", "<a href='x>y</a> <p>t\x00</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))
    got = html_extract.extracted(df).collect()
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (1, 2, 3)] == ["", "", ""]
    assert next(r["text"] for r in got if r["page_id"] == 5) == "plain text"
    assert max(r["n_chars"] for r in got) == 499_999
    assert html_extract.extracted(df.limit(0)).count() == 0


# ---- 3 ------------------------------------------------------------------------------------------------------------


def near_copies(n, seed=3):
    rng = random.Random(seed)
    base = [f"v{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_near_dedup(spark, odd, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", block)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 4_000_000 if block > 7 else 900)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(100 + i, t) for i, t in near_copies(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.groups(df, 4).collect()}
    assert got == brute_groups(rows)
    assert near_dedup.groups(df.limit(0)).count() == 0
    assert near_dedup.groups(spark.createDataFrame([(None, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")).count() == 3


def test_bit_estimates():
    rng = np.random.default_rng(4)
    for share in (0.0, 0.5, 0.8, 1.0):
        both = rng.integers(1, 1 << 63, 2000, dtype=np.uint64)
        n = int(2000 * share)
        a, b = np.r_[both[:n], rng.integers(1, 1 << 63, 2000 - n, dtype=np.uint64)], np.r_[both[:n], rng.integers(1, 1 << 63, 2000 - n, dtype=np.uint64)]
        sig = [np.frombuffer(near_dedup.signature(x)[0], np.uint64) for x in (a, b)]
        want = n / (4000 - n)
        assert abs(near_dedup.similarity(sig[0], sig[1][None, :])[0] - want) < 0.16


# ---- 4 ------------------------------------------------------------------------------------------------------------


def test_decontamination(spark, odd):
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((3, 5, 9, 30, 60, 200))))) for i in range(30)] + [(30, None), (31, " "), (32, "one TWO")]
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for i in range(80):
        w = [word() for _ in range(rng.choice((5, 50, 5000)))]
        item = (items[rng.randrange(30)][1]).split()
        if rng.random() < 0.5:
            item = [x if rng.random() > 0.03 else word() for x in item]
        at = rng.randrange(len(w))
        docs.append((1000 + i, " ".join(w[:at] + item + w[at:]).upper()))
    want = set()
    for d, t in docs:
        have = decontam.shingles_of((t or "").encode(), 5)
        for i, x in items:
            s = decontam.shingles_of((x or "").encode(), 5)
            if s and 100 * len(s & have) >= 80 * len(s):
                want.add((d, i, len(s & have), len(s)))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (50_000, 4):
        decontam.BLOCK = block
        assert {tuple(r) for r in decontam.contained(df, it).collect()} == want and len(want) > 40
    decontam.BLOCK = 50_000
    assert decontam.contained(df.limit(0), it).count() == 0 and decontam.contained(df, it.limit(0)).count() == 0


def test_small_items():
    """Items of few shingles are never missed, in texts of any length; equal items give a row each."""
    rng = random.Random(15)
    word = lambda: f"v{rng.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(5 + i % 16))) for i in range(3000)] + [(9000, "same words in two items")] * 2
    index = decontam.Index([(i, t.encode()) for i, t in items], 5, 80)
    for i, t in items[:3000]:
        w = [word() for _ in range(100)]
        own = t.split()
        if len(own) >= 14:
            own[-1] = word()  # one shingle of ten or more is gone
        at = rng.randrange(100)
        assert i in [r[0] for r in index.found(" ".join(w[:at] + own + w[at:]).encode())]
    assert [r[0] for r in index.found(b"x same words in two items y")] == [9000, 9000]


def test_decontamination_of_odd_rows(spark):
    """Columns that clash, repeated documents, equal items and null ids."""
    docs = spark.createDataFrame([(1, "a b c d e f", "p"), (1, "a b c d e f", "p"), (None, "a b c d e f", "q"), (2, "a b c", "r")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, "b c d e f", 1), (7, "b c d e f", 1), (8, "A B c", 2), (None, "b C d e f", 3)], "item_id long, text string, doc_id long")
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in decontam.contained(docs, items).collect())
    assert got == sorted([(d, i) for d in (1, 1, 0) for i in (7, 7, 0)] + [(2, 8)])


# ---- 5 ------------------------------------------------------------------------------------------------------------


def test_rollup(spark):
    cols = "doc_id long, op string, source string, lang string, tokenizer string, n_tokens long, seq int"
    rollup = token_counts.Rollup(spark, common.scratch_path(spark, "test-rollup"))
    assert rollup.totals().count() == 0
    one = spark.createDataFrame([(1, "upsert", "a", "en", "t", 5, 0), (2, "upsert", "a", None, "t", 7, 0), (3, "upsert", "b", "en", "t", None, 0), (None, "upsert", "b", "en", "t", 9, 0), (1, "upsert", "a", "en", "t", 6, 1)], cols)
    assert rollup.commit("1", one) and not rollup.commit("1", one)
    two = spark.createDataFrame([(1, "delete", None, None, "t", None, 0), (2, "upsert", "b", "de", "t", 8, 0), (9, "delete", "a", "en", "t", 1, 0)], cols)
    assert rollup.commit("2", two) and not rollup.commit("2", two)
    assert rollup.commit("3", two.limit(0))
    got = sorted(tuple(r) for r in rollup.totals().collect())
    assert got == [("b", "de", "t", 1, 8), ("b", "en", "t", 1, 0)]
    # a batch that failed before its marker was written is not read, and can be committed again
    rollup.spark.createDataFrame([(5, "t", "z", "en", 1, 100)], token_counts.LEDGER).write.parquet(f"{rollup.path}/ledger/4")
    assert sorted(tuple(r) for r in rollup.totals().collect()) == got
    assert rollup.commit("4", spark.createDataFrame([(3, "delete", "b", "en", "t", 0, 0)], cols))
    assert [tuple(r) for r in rollup.totals().collect()] == [("b", "de", "t", 1, 8)]


def test_token_counts(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.counted(odd, path, public_tokenizers.PATTERN, "v").collect()}
    enc = reference_encoding()
    assert got == {r[0]: len(enc.encode_ordinary(r[1] or "")) for r in ODD}


def test_totals_of_all_documents(spark, docs):
    """op5 counts every document, short ones too, with its own tokens."""
    rows = queries.op5_token_counts(spark, "/root/testdata/sf0.001").collect()
    want = {(r["source"], r["lang"]): (r["n"], r["t"]) for r in docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.size(F.expr("filter(split(text, '[ \\\\t-\\\\r]+'), x -> x <> '')")).cast("long")).alias("t")).collect()}
    words = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rows if r["tokenizer"] == "words-1"}
    assert words == want
    assert {(r["source"], r["lang"]): r["n_docs"] for r in rows if r["tokenizer"] == "byte-bpe-50k"} == {k: n for k, (n, _) in want.items()}


# ---- 6 ------------------------------------------------------------------------------------------------------------


def test_bpe_of_the_tables(spark, docs, odd):
    enc = reference_encoding()
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for df in (docs, odd):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        rows = byte_bpe.digests(df, path, public_tokenizers.PATTERN).collect()
        assert len(rows) == len(texts)
        for r in rows:
            ids = enc.encode_ordinary(texts[r["doc_id"]])
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_random():
    codec, enc = byte_bpe.loaded(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), reference_encoding()
    rng = random.Random(6)
    pools = ["abcdefghij  \n", "éßñü数据データ한국어עברית", " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85   　x", "0123456789٣४½", "'stremdvl ", "!?.,;:#$%&*()_+-=<>", "\U0001f600‍️́ɐ〇▁"]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60)))
        ids = codec.encode(text).tolist()
        assert ids == enc.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_columns(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = byte_bpe.encoded(odd.withColumn("IDS", F.lit("clash")), path, public_tokenizers.PATTERN)
    assert out.columns == [*odd.columns, "ids"]
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in byte_bpe.decoded(out, path, public_tokenizers.PATTERN).collect()}
    assert back == {r[0]: r[1] or "" for r in ODD}
    assert byte_bpe.encoded(empty(spark), path, public_tokenizers.PATTERN).count() == 0


# ---- 7 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, odd, encoding):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    both = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100).union(odd.select("doc_id", "text"))
    path = common.scratch_path(spark, "test-files")
    token_files.write(both, path, public_tokenizers.path("word_bpe_49k.json"), encoding=encoding, files=5)
    got = sorted(tuple(r) for r in token_files.checksums(spark, path).collect())
    start, want = 0, []
    for i, t in sorted((r["doc_id"], r["text"] or "") for r in both.collect()):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    scan = token_files.read(spark, path, ("doc_id", "n_tokens"))._jdf.queryExecution().toString()
    assert "ids" not in scan.split("ReadSchema")[-1]
    token_files.write(both.limit(0), path, public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.checksums(spark, path).count() == 0


# ---- 8 ------------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    grades = labels.selectExpr("doc_id", "CASE WHEN toxic = 0 THEN 0 WHEN quality = 1 THEN 1 ELSE 2 END AS grade")
    fit, held = grades.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    model = toxicity.trained(docs, fit)
    assert list(model.cuts) == sorted(model.cuts) and len(model.cuts) == 2
    hit = [r["toxic_"] == bool(r["toxic_label"]) for r in toxicity.graded(docs, model).withColumnRenamed("toxic", "toxic_").join(held.withColumnRenamed("toxic", "toxic_label"), "doc_id").collect()]
    assert len(hit) > 50 and sum(hit) / len(hit) > 0.9


def test_toxicity_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id long, grade int")
    rows = toxicity.graded(odd, toxicity.trained(odd, none)).collect()
    assert len(rows) == len(ODD) and not any(r["toxic"] for r in rows)
    one = spark.createDataFrame([(4, 0), (6, 2), (9, None), (None, 1), (4, 0)], "doc_id long, grade int")
    assert toxicity.graded(odd, toxicity.trained(odd, one)).count() == len(ODD)
    assert toxicity.graded(odd.limit(0), toxicity.trained(odd, one)).count() == 0


def plain_likelihood(w, gap, rows, y, share, l2):
    """The penalised log-likelihood of a cumulative-link model, text by text and threshold by threshold."""
    import math

    cuts = [gap[0]]
    for g in gap[1:]:
        cuts.append(cuts[-1] + math.exp(g))
    total = -0.5 * l2 * sum(x * x for x in w)
    for feats, grade, weight in zip(rows, y, share):
        s = sum(w[f] for f in feats)
        above = [1.0] + [1 / (1 + math.exp(c - s)) for c in cuts] + [0.0]
        total += weight * math.log(above[grade] - above[grade + 1])
    return total


def test_ordinal_slopes():
    """Derivatives against differences of a plain loop, for two to five grades."""
    rng = np.random.default_rng(13)
    for top in (1, 2, 4):
        rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(40)]
        y = np.r_[np.arange(top + 1), rng.integers(0, top + 1, 39 - top)]
        w, gap, share = rng.normal(size=6), rng.normal(size=top), rng.random(40)
        got = np.concatenate(toxicity.slopes(w, gap, np.concatenate(rows), np.repeat(np.arange(40), [len(r) for r in rows]), y, share, 0.1))
        for i in range(6 + top):
            step = np.eye(6 + top)[i] * 1e-5
            ends = [plain_likelihood((w + s[:6]).tolist(), (gap + s[6:]).tolist(), rows, y, share, 0.1) for s in (step, -step)]
            assert abs(got[i] - (ends[0] - ends[1]) / 2e-5) < 1e-4


def test_ordinal_grades(spark):
    """Severity, grade and probabilities by a plain loop; any number of grades; clashing columns."""
    docs = spark.createDataFrame([(g * 10 + i, f"word{'abcdefghijklmnopqrst'[g]}x " * 3 + f"filler {'qrstuvwxyz'[i]}q") for g in range(20) for i in range(6)], "doc_id long, text string").withColumn("severity", F.lit("clash"))
    grades = docs.selectExpr("doc_id", "cast(doc_id div 10 as int) AS grade")
    model = toxicity.trained(docs, grades)
    assert len(model.cuts) == 19
    known = dict(zip(model.vocab.tolist(), model.weights.tolist()))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.graded(docs, model).collect():
        s = sum(known.get(h, 0.0) for h in toxicity.words_of(texts[r["doc_id"]]).tolist())
        above = [1.0] + [1 / (1 + np.exp(-max(-60, min(60, s - c)))) for c in model.cuts] + [0.0]
        each = [a - b for a, b in zip(above, above[1:])]
        assert np.isclose(r["severity"], sum(above[1:])) and each[r["grade"]] >= max(each) - 1e-12 and r["toxic"] == (above[1] >= 0.5)


# ---- 9 ------------------------------------------------------------------------------------------------------------


def test_base_spans(docs):
    rng = random.Random(7)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "=", " = ", ":", '"', "'", " ", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "abc", "X" * 12, "é\U0001f600", "ſecret", "toKen", "\n", ".", "-", "deadbeefdeadbeefdead"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    for t in texts + [r["text"] for r in docs.collect()]:
        assert secrets.base_spans(t) == brute_spans(t), repr(t)


def brute_viterbi(field, run):
    import itertools

    best = None
    for tags in itertools.product(range(3), repeat=len(run)):
        s, last = 0.0, 0
        for f, t in zip(run, tags):
            s += field.emit[t, f].sum() + field.move[last, t]
            last = t
        s += field.move[last, 0]
        if best is None or s > best[0]:
            best = (s, tags)
    return best[0], list(best[1])


def test_field(spark):
    rng = np.random.default_rng(8)
    for _ in range(50):
        field = secrets.Field(rng.normal(size=(3, secrets.DIMS)), rng.normal(size=(3, 3)))
        run = [np.unique(rng.integers(0, secrets.DIMS, 6)) for _ in range(rng.integers(1, 6))]
        assert field.viterbi(run) == brute_viterbi(field, run)[1]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sample = [w for r in docs.orderBy("doc_id").collect() for w in secrets.windows(r["text"])]
    field = secrets.fitted(sample[::2])
    tags = [(a, b) for run, tags in sample[1::2] for a, b in zip(field.viterbi(run), tags)]
    assert len(tags) > 20 and sum(a == b for a, b in tags) / len(tags) > 0.9


def test_scan(spark, docs, odd):
    both = docs.select("doc_id", "text").union(odd.selectExpr("doc_id + 100000", "text")).withColumn("spans", F.lit("clash"))
    texts = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    rows = secrets.scanned(both).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_spans(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
        named = ",".join(f"{secrets.KINDS[k]}:{i}:{j}" for i, k, j in base)
        assert r["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("crf")] == [s for s in named.split(",") if s]
    out = secrets.redacted(both)
    assert out.columns == both.columns
    for r in out.collect():
        assert not any(texts[r["doc_id"]][i:j] in (r["text"] or "") for i, k, j in brute_spans(texts[r["doc_id"]]))
    assert secrets.scanned(both.limit(0)).count() == 0


def test_all_tokens_may_be_secrets():
    """Letters alone, short words and groups parted by spaces: any token can begin or go on a secret."""
    emit, move = np.zeros((3, secrets.DIMS)), np.zeros((3, 3))
    move[secrets.OUTSIDE, secrets.INSIDE] = -1e3
    emit[1:, secrets._ids(["bias"])] = -4
    for before in ("passphrase", "code"):
        emit[secrets.BEGIN, secrets._ids([f"before2 {before}"])] += 9
    emit[secrets.INSIDE, secrets._ids(["before3 code"])] += 9
    scores = secrets.Scores(secrets.Field(emit, move))
    for text, want in (("a passphrase is qWfTzKplMnRsVbXy", ["qWfTzKplMnRsVbXy"]), ("the passphrase is zq .", ["zq"]), ("my code is ab cd \nok", ["ab cd"]), ("nothing here", [])):
        assert [text[i:j] for i, _, j in secrets.added_spans(text, scores, [])] == want


def test_whole_texts_are_decoded(docs):
    """Runs between sure outside tokens give the same tags as Viterbi over the whole text, with the features of training."""
    rng = np.random.default_rng(9)
    emit = rng.normal(size=(3, secrets.DIMS))
    emit[1:, secrets._ids(["bias"])] -= 8
    scores = secrets.Scores(secrets.Field(emit, rng.normal(size=(3, 3))))
    worth = lambda e, tags: e[np.arange(len(e)), tags].sum() + scores.field.move[np.r_[0, tags], np.r_[tags, 0]].sum()
    runs = 0
    for r in docs.where("text IS NOT NULL AND n_chars BETWEEN 20 AND 4000").orderBy("doc_id").limit(40).collect():
        e, starts, ends = scores.of(r["text"])
        assert [r["text"][i:j] for i, j in zip(starts, ends)] == [p.lstrip() for p in secrets.pieces(r["text"])]
        assert np.allclose(e, [emit[:, f].sum(1) for run, _ in secrets.windows(r["text"]) for f in run])
        tags = np.zeros(len(e), int)
        for first, own in scores.field.decoded(e):
            tags[first : first + len(own)] = own
            runs += 1
        assert np.isclose(worth(e, tags), worth(e, np.array(scores.field.best(e))), rtol=0, atol=1e-6)  # repeated words tie
    assert runs > 40


def test_sample_of_windows(spark, monkeypatch):
    """The windows of the sample do not depend on partitions or the order of rows."""
    monkeypatch.setattr(secrets, "SAMPLE_WINDOWS", 40)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["word", "12345678", "token=Abcd1234Efgh", "9999", "x"]) for _ in range(60))) for i in range(60)]
    one = secrets.trained(spark.createDataFrame(rows, "doc_id long, text string").repartition(1))
    two = secrets.trained(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7))
    assert np.array_equal(one.emit, two.emit) and np.array_equal(one.move, two.move) and one.emit.any()


def test_field_adds_spans(spark):
    """Secrets that no base pattern matches are found in held-out prose, most of them whole, and clean texts stay clean; the layout of files does not matter."""
    import string

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    field = secrets.trained(docs.where("doc_id % 2 = 0"))
    scores = secrets.Scores(field)
    clean = [r["text"] for r in docs.where("doc_id % 2 = 1 AND text IS NOT NULL").orderBy("doc_id").collect()]
    assert sum(len(secrets.added_spans(t, scores, secrets.base_spans(t))) for t in clean) <= 1
    rng = random.Random(11)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    both, any_ = string.ascii_letters, string.ascii_letters + string.digits
    made = {
        "letters after a cue": lambda: ("the passphrase is ", word(both, 16)),
        "letters alone": lambda: ("", word(both, 24)),
        "letters and digits": lambda: ("", word(any_, 28)),
        "base64": lambda: ("", word(any_ + "+/", 44)),
        "capitals": lambda: ("", word(string.ascii_uppercase + string.digits, 26)),
        "a short one": lambda: ("pwd: ", word(any_, 11)),
    }
    prose = [t.split() for t in clean if len(t.split()) > 40]
    found, extra = {}, 0
    for name, make in made.items():
        hits = 0
        for _ in range(60):
            w = rng.choice(prose)
            at = rng.randrange(len(w))
            head, value = make()
            before = " ".join([*w[max(0, at - 20) : at], head])
            text = f"{before}{value} {' '.join(w[at : at + 20])}"
            base = secrets.base_spans(text)
            spans = secrets.added_spans(text, scores, base)
            hits += any(i <= len(before) and j >= len(before) + len(value) for i, _, j in spans) or any(i < len(before) + len(value) and len(before) < j for i, _, j in base)
            extra += sum(j <= len(before) or i >= len(before) + len(value) for i, _, j in spans)
        found[name] = hits / 60
    assert min(found.values()) >= 0.55 and sum(found.values()) / len(found) >= 0.8, found
    assert extra <= 3
    one = {r["doc_id"]: r["spans"] for r in secrets.scanned(docs.repartition(1), field).collect()}
    assert {r["doc_id"]: r["spans"] for r in secrets.scanned(docs.repartition(9, "text"), field).collect()} == one


def test_long_texts_in_steps(monkeypatch):
    """A text looked at in steps has the scores of the text as a whole, and words count beyond any length."""
    rng = np.random.default_rng(12)
    emit = rng.normal(size=(3, secrets.DIMS))
    field = secrets.Field(emit, rng.normal(size=(3, 3)))
    words = ["Ab9" * 40 + "x", "token", "=", "zz top", "a" * 300, "A" * 300 + "9", "\u00e9t\u00e9", "1.2.3"]
    text = "  ".join(words[i] for i in rng.integers(0, len(words), 400)) + " \n"
    whole = secrets.Scores(field).of(text)
    monkeypatch.setattr(secrets, "STEP", 50)
    monkeypatch.setattr(secrets, "REMEMBERED", 5)
    for a, b in zip(whole, secrets.Scores(field).of(text)):
        assert np.allclose(a, b, rtol=0, atol=1e-9)
    assert np.allclose(whole[0], [emit[:, f].sum(1) for run, _ in secrets.windows(text) for f in run])
    assert secrets.traits("a" * 70 + "9") != secrets.traits("a" * 71) and secrets.traits("ab" * 40) != secrets.traits("ab" * 400)


def test_examples():
    """Made secrets lie where they are said to, decoys are outside, hidden windows keep their tags and lose their cues."""
    near = secrets.pieces('my token = "AKIAabcdefgh1234" here now')
    for key in range(400):
        parts, tags, real = secrets.planted(near, 2, 5, key)
        assert len(tags) == len(parts) - (len(near) - 5) and (secrets.BEGIN in tags) == real and tags.count(secrets.BEGIN) == int(real)
    out = secrets.hidden(near, 1)
    assert len(out) == len(near) and "token" not in "".join(out) and "AKIA" not in "".join(out)
    kinds = [k for key in range(60) for k, *_ in secrets.examples(False, [0] * 5, 2, near, key)]
    assert {secrets.AS_IS, secrets.SECRET, secrets.DECOY} == set(kinds) and kinds.count(secrets.AS_IS) == 60


# ---- 10 -----------------------------------------------------------------------------------------------------------


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + o for starts in at.values() if len(starts) > 1 for i in starts for o in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, odd):
    rng = random.Random(9)
    rows = [(1000 + i, "".join(rng.choice(["a", "b", " ", " ", "\n", "#", "é ", "\x0b", " ", "abc def ghi jkl mno pqr stu vwx yz "]) for _ in range(rng.randrange(200)))) for i in range(60)]
    rows += [(r[0], r[1]) for r in ODD] + [(2000, "a b c d e f g h"), (2001, "a " * 9), (2002, "a " * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: tuple(r[m] for m in quality.MEASURES) for r in quality.measured(df).collect()}
    assert got == {i: brute_measures(t) for i, t in rows}


def test_hosts(spark):
    plain = " ".join(f"word{i}" for i in range(40))
    junk = plain + "\n" + plain[:150] + "\nx y\nx y"
    rows = [(i, "good", plain) for i in range(30)] + [(100 + i, "bad", junk) for i in range(30)] + [(200, "bad", plain), (201, "good", junk), (202, None, plain), (203, "good", "few words"), (204, "bad", None)]
    out = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["kept"] for i in [*range(30), 200, 202])  # clean documents stay, whatever their host
    assert out[203]["base_failed"] and out[204]["base_failed"]
    assert not any(out[100 + i]["kept"] for i in range(30)) and out[201]["kept"] == (not out[201]["base_failed"])
    assert quality.judged(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_word_memory():
    """Texts by way of remembered words, against the library on the whole text."""
    own = token_files.Words(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(10)
    pools = ["abcdefghij  \n", "ABCéßñüÀÖ×÷ªµº²³¼", " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85 ", "0123456789", "'stremdvlSTM ", "!?.,;:#$%&*()_+-=<>", "\x00\x01\x7f\x80\xad", "数א\U0001f600İΣς́"]
    for i in range(3000):
        text = "".join(rng.choice(rng.choice(pools[: 7 + i % 2])) for _ in range(rng.randrange(60)))
        want = own.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), np.uint32).tolist() == want, repr(text)


def test_worker_memory(docs):
    """Workers make their results in slices of a batch, and keep nothing of an operator that no longer runs."""
    rows = docs.select("doc_id", "text").orderBy("doc_id").toArrow().combine_chunks()
    batch = pa.concat_tables([rows] * (1 + (8 << 20) // rows.nbytes)).combine_chunks().to_batches()[0]
    shared = SimpleNamespace(value=secrets.Field(np.zeros((3, secrets.DIMS)), np.zeros((3, 3))))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for run in (secrets._redact(shared, 1, "[SECRET]"), secrets._scan(shared), byte_bpe._encode(path, public_tokenizers.PATTERN, 1)):
        out = list(run(iter([batch])))
        assert len(out) > 2 and max(b.num_rows for b in out) < batch.num_rows // 2
        assert pa.Table.from_batches(out).column(0).to_pylist() == batch.column(0).to_pylist()
    held = weakref.ref(byte_bpe.loaded(path, public_tokenizers.PATTERN))
    list(common.frugal(byte_bpe._encode(path, public_tokenizers.PATTERN, 1))(iter([batch.slice(0, 1)])))
    assert held() is not None
    list(common.frugal(secrets._redact(shared, 1, "[SECRET]"))(iter([batch.slice(0, 1)])))
    gc.collect()
    assert held() is None


def test_token_file_memory():
    """Check sums are made in slices of a batch, and the tokenizer goes when another operator's task has run."""
    lists = [list(range(i % 50)) for i in range(50_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50_000), pa.int64())] * 3 + [pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "start", "n_tokens", "ids"])
    out = list(token_files._crc(iter([batch.slice(7)])))
    assert len(out) > 2
    assert pa.Table.from_batches(out).column(3).to_pylist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in lists[7:]]
    held = weakref.ref(token_files.tokenizer(public_tokenizers.path("word_bpe_49k.json")))
    list(common.frugal(lambda batches: batches)(iter([])))
    gc.collect()
    assert held() is None
