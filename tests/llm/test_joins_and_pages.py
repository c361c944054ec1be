"""Point-in-time join, HTML extraction and importance resampling against brute force, on small tables with nulls, empties, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import pyarrow as pa
import pytest

from tools.compare import rows_of

from duskloom.llm import html_extract, point_in_time, queries, resample

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t long, score double, event long, `value` string, __at long"
PAGES = "page_id long, url string, html string, text string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, n, 5, 0.5, 1, "v", 3) for i, t, lang, src, n in rows], DOCS)


def groups(doc_id):
    h = hashlib.sha256(str(doc_id).encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def brute_feature(docs, label):
    """doc_id, t, version_id, age, status, n_chars, lang of one label, by looking at every version."""
    if label is None:
        return (None, None, None, None, "none", None, None)
    t = groups(label)[3] % 50000
    sources = [s for i, _, s, _ in docs if i == label and s is not None]
    best = None
    for i, lang, source, n in docs:
        if i is None or source is None or not sources or source != max(sources):
            continue
        a, b, c, _ = groups(i)
        event = a % 50000
        arrival, expiry = event - 60 + b % 600, event + c % 900
        if event <= t and arrival <= t < expiry:
            key = (event, arrival, i, n is not None, n or 0, lang is not None, lang or "")
            if best is None or key > best[0]:
                best = (key, (n, lang))
    if best is None:
        return (label, t, None, None, "none", None, None)
    age = t - best[0][0]
    return (label, t, best[0][2], age, *(("stale", None, None) if age > 120 else ("fresh", *best[1])))


@pytest.fixture(scope="module")
def many_versions():
    rng = random.Random(3)
    rows = [(i, rng.choice(["en", None]), "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice([None, i % 97])) for i in range(30_000)]
    return [*rows, *rows[:50], (None, "en", "hot", 3), (7, "zz", "hot", 99), (7, "zz", "zz", 99)]


@pytest.mark.parametrize("sizes", [{}, {"width": 170, "part_rows": 40, "cell_rows": 90}])
def test_versions_at_any_cut(spark, many_versions, sizes):
    docs = documents(spark, [(i, None, lang, s, n) for i, lang, s, n in many_versions])
    asked = [i for i, *_ in many_versions if i is not None and i % 100 == 0]
    asks = spark.createDataFrame([(s, groups(i)[3] % 50000) for i, _, s, _ in many_versions if i in set(asked)] + [("hot", None), ("nowhere", 5)], "source string, t long")
    got = {(r.source, r.t): (r.event, r.arrival, r.id) for r in point_in_time.versions_at(asks, point_in_time.document_versions(docs), **sizes).collect()}
    versions = {}
    for i, _, s, _ in many_versions:
        if i is not None and s is not None:
            a, b, c, _ = groups(i)
            versions.setdefault(s, []).append((a % 50000, a % 50000 - 60 + b % 600, i, a % 50000 + c % 900))
    want = {}
    for s, t in {(r.source, r.t) for r in asks.collect()}:
        usable = [v[:3] for v in versions.get(s, []) if t is not None and v[0] <= t and v[1] <= t < v[3]]
        if usable:
            want[s, t] = max(usable)
    assert got == want and len(want) > 50


def test_feature_join(spark, many_versions):
    rows = many_versions[:1500] + many_versions[-3:]
    docs = documents(spark, [(i, "x", lang, s, n) for i, lang, s, n in rows])
    labels = [*range(0, 1500, 3), 3, 3, 3, 7, None, None, 10**9]
    frame = spark.createDataFrame([(i, 1, 0, "s", 4) for i in labels], "doc_id long, quality int, toxic int, source string, t long").repartition(3)
    got = sorted((tuple(r) for r in point_in_time.feature_join(docs, frame).collect()), key=repr)
    assert got == sorted((brute_feature(rows, i) for i in labels), key=repr)
    assert {"none", "stale", "fresh"} == {r[4] for r in got}
    with duckdb.connect() as db:
        db.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows[:1500]], pa.int64()), "lang": [r[1] for r in rows[:1500]], "source": [r[2] for r in rows[:1500]], "n_chars": pa.array([r[3] for r in rows[:1500]], pa.int64())}))
        db.register("labels", pa.table({"doc_id": pa.array(labels, pa.int64())}))
        want = db.execute(point_in_time.ORACLE).df()
    first = point_in_time.feature_join(documents(spark, [(i, "x", lang, s, n) for i, lang, s, n in rows[:1500]]), frame).toPandas()
    assert rows_of(first) == rows_of(want)


def test_feature_join_of_empty_tables(spark):
    labels = spark.createDataFrame([(1,), (1,)], "doc_id long")
    assert [r.status for r in point_in_time.feature_join(documents(spark, []), labels).collect()] == ["none", "none"]
    assert point_in_time.feature_join(documents(spark, [(1, "x", "en", "a", 1)]), labels.limit(0)).count() == 0


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>Title &amp; co</title><style>p{{margin:0}}</style>{head}</head><body class='has-sidebar'>{body}</body></html>"


LONG = "A sentence that has quite some words in it, so that nobody takes it for a menu. " * 3
#: html and the text it must give.
CASES = [
    (None, ""), ("", ""), ("   \n ", ""), ("no markup at all", "no markup at all"), (page(""), ""), (page("<nav><a href=/>Home</a></nav><footer>&copy; me</footer>"), ""),
    (page("<article><h1>Head</h1><p>One.<p>Two\n  lines &amp; &eacute;&#233;&nbsp;x</p></article>"), "Head\nOne.\nTwo lines & éé x"),
    (page("<header><a href=/>Site</a></header><main><header><h1>Real</h1></header><p>Ti.</p><aside>side</aside><div class='ad'>Buy</div><p>End <b>bold</b>ly</p></main><section class='comments'><h2>Comments</h2><p>first!</p></section>"), "Real\nTi.\nEnd boldly"),
    (page("<article><p><b>Never closed.<br><p>Next.</article><footer>Imprint</footer>"), "Never closed.\nNext."),
    (page("<article><p>a</p><form><input value=x><p>mail me</p></form><script>var t='</p><p>no</p>';</script><style>x</style><!-- <p>hidden</p> --><p>b &lt;i&gt; &amp;amp;</p><div id='comments'><article class='comment'><p>me too</p></article></div></article>"), "a\nb <i> &amp;"),
    (page(f"<div id='menu'><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class='cookie-notice'>We use cookies. {LONG}</div><div class='post-content'><h2>Heading</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div><div id=footer>{LONG}</div>"), f"Heading\n{LONG.strip()}\nShort.\n{LONG.strip()}"),
    (page(f"<ul><li><a href=1>One thing</a></li><li><a href=2>Another thing</a></li><li><a href=3>More</a></li><li><a href=4>Else</a></li></ul><p>{LONG}</p><p>{LONG}</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul>"), f"{LONG.strip()}\n{LONG.strip()}"),
    ("<article><p>cut off in the mid", "cut off in the mid"), ("<article><p>cut <a href='x", "cut"), ("<article>1 < 2 and 3 > 2</article><footer>x</footer>", "1 < 2 and 3 > 2"),
    ("<article><table><tr><td>a</td><td>b</td></tr></table><pre>c\n d</pre><ul><li>e</li></ul></article>", "a\nb\nc d\ne"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    (page("<article class='with-comments'><h1>&quot;Q&quot; &am</h1><p>x&ampy</p></article>"), '"Q" &am\nx&y'),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_pages_by_hand(number):
    html, want = CASES[number]
    assert html_extract.main_text(html) == want


class Plain(HTMLParser):
    """The blocks of the article element of a well-formed page, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.cut, self.blocks, self.own = 0, 0, [], []

    def flush(self):
        text = " ".join("".join(self.own).split())
        self.blocks += [text] * bool(text)
        self.own = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("nav", "form", "aside", "footer", "script", "style") or dict(attrs).get("class") == "ad":
            self.cut += 1
        if tag in ("p", "h1", "li", "div", "article", "nav", "form", "aside", "footer"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "li", "div", "article", "nav", "form", "aside", "footer"):
            self.flush()
        if tag in ("nav", "form", "aside", "footer", "script", "style", "div"):
            self.cut -= 1
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth and not self.cut:
            self.own.append(data)


def test_random_pages_by_a_parser():
    rng = random.Random(8)
    word = lambda: rng.choice(["wort", "&amp;", "x<b>y</b>", "é", "&#x41;", "a &lt; b", "\n", "<i>z</i>"])
    text = lambda: " ".join(word() for _ in range(rng.randrange(1, 30)))
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(9)):
            kind = rng.randrange(6)
            parts.append([f"<p>{text()}</p>", f"<h1>{text()}</h1>", f"<nav><li>{text()}</li></nav>", f"<div class=\"ad\">{text()}</div>", f"<form><p>{text()}</p></form>", f"<script>if (a</b>) '{'x' * rng.randrange(9)}'</script>"][kind])
        html = f"<html><body><nav>{text()}</nav><article>{''.join(parts)}</article><footer>{text()}</footer></body></html>"
        plain = Plain()
        plain.feed(html)
        plain.close()
        assert html_extract.main_text(html) == "\n".join(plain.blocks), html


def test_extract_pages(spark):
    rows = [(i, f"http://h/{i}", html, "clash", 5) for i, (html, _) in enumerate(CASES)] + [(3, None, CASES[3][0], "clash", 5), (None, "u", "<article>" + "<p>wort" * 40_000, "clash", 5)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, PAGES)).collect()
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    want = [want for _, want in CASES] + [CASES[3][1], "\n".join(["wort"] * 40_000)]
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(i, u, w, len(w)) for (i, u, *_), w in zip(rows, want, strict=True)]
    assert html_extract.extract_pages(spark.createDataFrame([], PAGES)).count() == 0


def brute_buckets(text, n, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


def brute_resample(docs, target, n, buckets, percent, least):
    own = [(i, *brute_buckets(text, n, buckets)) for i, text in docs]
    t = Counter(b for text in target for b in brute_buckets(text, n, buckets)[0])
    s = Counter(b for _, found, _ in own for b in found)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, found, words in own:
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        rank.setdefault(r, []).append(k)
    return sorted(((*r[:4], rank[r].pop() if rank.get(r) else None) for r in rows), key=repr)


@pytest.mark.parametrize("n, buckets, percent", [(1, 50, 10), (2, 64, 35), (4, 97, 100), (1, 50, 0)])
def test_resample(spark, n, buckets, percent):
    rng = random.Random(n)
    vocabulary = ["Wort", "das", "été", "12", "x1", "-", "ÄÖ", "the", "of"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "...", "the " * 5000]
    docs = [*enumerate(texts), (None, texts[0] + " the" * 20), (5, texts[5]), (5, texts[5])]
    target = ["the of the", "x1 das", None, ""]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 5, 0.5, 1, "v", 3) for i, t in docs], DOCS).repartition(5)
    got = resample.importance_resample(frame, spark.createDataFrame([(1, t) for t in target], "item_id long, text string"), n, buckets, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(docs, target, n, buckets, percent, 20)


def test_resample_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.importance_resample(none, some).count() == 0
    assert resample.importance_resample(some, none, least_words=1, percent=100).first()["rank"] == 1


def test_queries_are_registered():
    assert {"op11_feature_join", "op12_html_extract", "op13_importance_resample"} <= set(queries.QUERIES) & set(queries.ORACLE_SQL)
