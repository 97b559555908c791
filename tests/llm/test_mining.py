"""Source divergence, main text of pages and hard negatives against plain versions."""

import html
import math
import os
import random
import re
from collections import Counter, defaultdict

import pytest

from panelloom.llm import divergence, mainhtml, negatives, queries

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Source divergence.


def plain_divergence(docs, least, unit=10**9, prior=5, top=50):
    counts, held, groups, langs = defaultdict(Counter), Counter(), set(), defaultdict(set)
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        words = TERM.findall(text.translate(UPPER))
        counts[lang, source].update(words)
        counts[lang,].update(words)
        held.update((lang, w) for w in set(words))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        terms = sorted({w for (at, w), n in held.items() if at == lang and n >= least}, key=str.encode)

        def shares(key):
            total = sum(counts[key][t] for t in terms)
            return [1 + unit * (counts[key][t] + prior) // (total + prior * len(terms)) for t in terms]

        of = {s: shares((lang, s)) for s in sources}
        whole = shares((lang,))
        for s in sources:
            pairs = sorted(((-sum(abs(p - q) for p, q in zip(of[s], of[o])), o.encode()) for o in sources - {s}))
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            more = sorted((q - p, t.encode()) for t, p, q in zip(terms, of[s], whole) if counts[lang, s][t] and p > q)
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(more[:top], 1)]
    return sorted(out, key=repr)


def divergence_docs():
    deal = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "ÉTÉ", "naïve", "Ωμέγα"]
    docs = []
    for i in range(300):
        lang = ("en", "de", None, "")[i % 4]
        source = None if i % 11 == 0 else f"s{i % 7}" if i % 3 else "hot"
        n = deal.choice((0, 1, 5, 30))
        docs.append((" ".join(deal.choice(words[: 20 + 6 * (i % 7)]) for _ in range(n)) + "42,x_Y-" * (i % 2), lang, source))
    docs += [(None, "en", "empty"), ("", "en", "empty"), ("alone", "xx", "a"), ("also alone", "xx", "b"), (None, None, None)]
    docs += [docs[1]] * 5 + [("\U0001f600 word joined WORD " * 20_000, "en", "s1")]
    return docs


EXTRA = "term string, n bigint, docs int, share string, block int, rank int, item string, total int, zero int"


@pytest.mark.parametrize("block", [1 << 14, 16])
def test_divergence_equals_plain(spark, block):
    docs = divergence_docs()
    df = spark.createDataFrame([(*d, "a", 1, 2, "b", 3, 4, "c", 5, 6) for d in docs], f"text string, lang string, source string, {EXTRA}")
    out = divergence.divergence(df.repartition(3), divergence.DivergenceConfig(docs=8, block=block))
    assert rows_of(out) == plain_divergence(docs, 8)


def test_divergence_flushes_and_ties(spark, monkeypatch):
    docs = divergence_docs()
    rows = list(divergence.count_terms(iter(spark.createDataFrame([(b or "", c or "", a or "") for a, b, c in docs], "lang string, source string, text string").toArrow().to_batches())))
    monkeypatch.setattr(divergence, "HELD", 10)
    small = list(divergence.count_terms(iter(spark.createDataFrame([(b or "", c or "", a or "") for a, b, c in docs], "lang string, source string, text string").toArrow().to_batches())))
    assert sum(map(len, small)) > sum(map(len, rows))

    def added(batches):
        total = Counter()
        for batch in batches:
            for r in batch.to_pylist():
                total[r["lang"], r["source"], r["term"], "n"] += r["n"]
                total[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return total

    assert added(small) == added(rows)


def test_divergence_of_large_counts_is_exact(spark):
    n, total = 7 * 10**12 + 3, 9 * 10**15 + 1
    config = divergence.DivergenceConfig()
    got = spark.sql(f"SELECT {divergence._share(f'{n}L', f'{total}L', '1000L', config)} AS p").first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5000)


def test_divergence_without_terms_and_rows(spark):
    schema = "text string, lang string, source string"
    out = divergence.divergence(spark.createDataFrame([("rare words", "en", "a"), (None, "en", "b"), ("x", "de", "c")], schema))
    assert rows_of(out) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.divergence(spark.createDataFrame([], schema)).collect() == []


@needs_tables
def test_divergence_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text", "lang", "source").collect()]
    assert rows_of(queries.op11_source_divergence(spark, SF_DIR)) == plain_divergence(docs, 30)


# Main text.

ARTICLE = [
    "A title of the page",
    "The first paragraph is a long one & has many words, so that its ratio of text to tags is high.",
    "Short one.",
    "Another paragraph with a link inside and enough text around it to count as content of the page, surely.",
    "Bits and pieces",
    "The last paragraph closes the article with a few more words than the others had.",
]
BODY = (
    f"<h1>{ARTICLE[0]}</h1><p>{ARTICLE[1].replace('&', '&amp;')}</p><p>{ARTICLE[2]}<p>Another  paragraph\n with a "
    f"<a href='/x'>link inside</a> and enough text around it<br>to count as content of the page, surely.<ul><li>{ARTICLE[4]}</ul>"
    f"<!-- hidden --><p><b>{ARTICLE[5]}</p>"
)
MENU = "<nav><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></nav>"
AROUND = (
    "<header><h2>Site name</h2></header><div class='cookie-notice'><p>We use cookies on this site to make it work as it "
    "should, and you agree to that by reading on.</p></div><aside><p>A sidebar with a rather long paragraph of text that is "
    "not the article.</p></aside><form><label>Mail</label><input name=q><button>Send</button></form>"
)
AFTER = (
    "<section id='comments'><article><p>I read this article with great joy and I would like to add many words of my own to it."
    "</p></article></section><footer>&copy; 2020 a site</footer><script>var t = '<p>no</p>';</script><style>p{}</style>"
)


@pytest.mark.parametrize(
    "page",
    [
        f"<!DOCTYPE html><html><head><title>T</title></head><body>{MENU}{AROUND}<article>{BODY}</article>{AFTER}</body></html>",
        f"<html><body>{MENU}{AROUND}<main>{BODY}</main>{AFTER}",
        f"<body class='has-sidebar'>{MENU}{AROUND}<div class='c1'><div class='c2'>{BODY}</div></div>{AFTER}",
        f"<body>{MENU}<div class='x'><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>About us</a></ul></div><div class='y'>{BODY}</div>{AFTER}",
        f"{MENU}{BODY}{AFTER}",
        f"<div class='ad'>Buy it now, it is the best thing ever sold on the web.</div><article>{BODY}<div class='share-links'><a href=1>Mail</a></div></article>",
        f"<div id='site-header'><p>The name of a site and what it is about, in rather many words for a header.</p></div><div class='entry-content'>{BODY}</div>{AFTER}",
        f"<div class='logo'>Site</div><main><div class='header'>{BODY[: BODY.index('<p>')]}</div>{BODY[BODY.index('<p>') :]}</main><div class='discussion'><p>One more thing that a reader wants to say at some length.</p></div>",
        f"<article><header>{BODY[: BODY.index('<p>')]}</header>{BODY[BODY.index('<p>') :]}<footer>About the author</footer></article>",
    ],
)
def test_main_text_of_layouts(page):
    assert mainhtml.extract(page) == "\n\n".join(ARTICLE)


def test_main_text_of_odd_pages():
    assert mainhtml.extract("") == mainhtml.extract("<nav>menu</nav><script>x</script>") == ""
    assert mainhtml.extract("only text, &eacute;&#233;&amp") == "only text, éé&"
    assert mainhtml.extract("<p>a<![odd[ x ]]>b</p></div></p>") in ("ab", "a\n\nb")
    assert mainhtml.extract("<article><p>Word</p></article><div>A longer text that no mark tells from the article's own text.</div>") == "Word"
    assert mainhtml.extract("<p>same text here</p>" * 3) == "\n\n".join(["same text here"] * 3)
    deep = "<div>" * 50_000 + "x" + "<b>" * 50_000 + "</i>" * 50_000
    assert mainhtml.extract(deep) == "x"
    long = "<article>" + "<p><b>word<br><p>more words of it" * 30_000 + "</article>"
    assert mainhtml.extract(long).split("\n\n") == ["word", "more words of it"] * 30_000


def test_main_text_frames(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, "u", f"<article>{BODY}</article>", "a", "b"), (None, None, None, None, None), (2, "v", "", "c", "d"), (2, "v", "", "c", "d")]
    out = mainhtml.main_text(spark.createDataFrame(rows, schema))
    text = "\n\n".join(ARTICLE)
    assert rows_of(out) == sorted([(1, "u", text, len(text)), (None, None, "", 0), (2, "v", "", 0), (2, "v", "", 0)], key=repr)
    assert mainhtml.main_text(spark.createDataFrame([], schema)).collect() == []


@needs_tables
def test_main_text_of_the_table(spark):
    """On the driver's pages: the blocks of the article element, cut out with patterns."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    want = []
    for r in pages:
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"(?s)<article>(.*?)</article>", r.html)[1])
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        text = "\n\n".join(b for b in blocks if b)
        want.append((r.page_id, r.url, text, len(text)))
    assert rows_of(queries.op12_html_extraction(spark, SF_DIR)) == sorted(want, key=repr)


# Hard negatives.


def plain_negatives(rows, every=100, scale=256):
    """rows (id, label, vector); an anchor is told by its place, so repeated ids stay apart."""
    whole = []
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole.append((vec_id, label, [math.floor(scale * x) for x in vector]))
    out = []
    for i, (a, label, v) in enumerate(whole):
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), b, other == label) for j, (b, other, w) in enumerate(whole) if j != i]
        for p, b, _ in sorted(x for x in scored if x[2])[:5]:
            fit = sorted((s, n) for s, n, same in scored if not same and 80 * -p <= 100 * -s <= 100 * -p)
            out += [(a, b, k, n, -p, -s) for k, (s, n) in enumerate(fit[:5], 1)]
    return sorted(out, key=repr)


def vector_rows(n=700, width=6):
    deal = random.Random(11)
    centres = [[deal.gauss(0, 0.4) for _ in range(width)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = centres[i % 5] if i % 3 else centres[0]
        rows.append((i, deal.choice((0, 0, 1, 2)), [x + deal.gauss(0, 0.1) for x in c]))
    hot = [0.5] * width
    rows += [(i, i % 3, hot) for i in range(n, n + 200)]  # one vector many times
    rows += [(n, 0, hot), (n, 0, hot), (100, 1, rows[7][2])]  # repeated ids, an anchor too
    rows += [(None, 1, hot), (2000, None, hot), (2100, 1, None), (2200, 1, [None] * width), (2300, 1, [math.nan] * width), (2400, 0, [math.inf] * width)]
    rows += [(2500, 1, []), (2600, 2, [0.0] * width), (2700, 2, [0.3, 0.2]), (2800, 9, hot), (-300, 0, [-x for x in hot])]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block": 64, "chunk": 3, "depth": 1}])
def test_hard_negatives_equal_plain(spark, sizes):
    rows = vector_rows()
    schema = "vec_id bigint, label int, embedding array<float>, score int, row int, slot string, anchor int"
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], schema).repartition(4)
    exact = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    assert rows_of(negatives.hard_negatives(df, negatives.NegativeConfig(**sizes))) == plain_negatives(exact)


def test_threshold_stops_before_the_end():
    import numpy as np

    deal = np.random.default_rng(3)
    lists = negatives.Lists(deal.integers(-50, 50, (5000, 3)))
    anchor, top, read = np.array([40, -30, 0]), negatives.TopK(5), 0
    for new, scores, bound in lists.accessed(anchor, 8):
        top.add(new, scores)
        read += len(new)
        if top.closed(bound):
            break
    want = lists.vectors @ anchor
    first = negatives.best(np.arange(5000), want, 5)
    assert read < 2500 and top.ids.tolist() == first.tolist() and top.scores.tolist() == want[first].tolist()


def test_hard_negatives_without_rows(spark):
    schema = "vec_id bigint, label int, embedding array<float>"
    assert negatives.hard_negatives(spark.createDataFrame([], schema)).collect() == []
    one = [(100, 1, [1.0]), (101, 2, [1.0])]  # no positive
    assert negatives.hard_negatives(spark.createDataFrame(one, schema)).collect() == []


@needs_tables
def test_hard_negatives_of_the_table(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert rows_of(queries.op13_hard_negatives(spark, SF_DIR)) == plain_negatives(rows)
