"""Main text of pages, ranked search and resampling against plain versions, on whole small tables and on odd ones."""

import hashlib
import html
import math
import re
import time
import zlib
from collections import Counter
from random import Random

import numpy as np
import pytest

pytest.importorskip("spanwood.llm")

from spanwood.llm import bisection, boosting, dom, main_text, ranked_search, resampling  # noqa: E402

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, score string, term string, shard string, rank string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ODD = [None, "", " \n ", "Word", "word WORD", "École straße 世界 K", "a b c d e f g h i j k l m n o p q r s t u v", "x " * 30_000, "tie one", "tie one", "one-two_three\x00four", "0 1 2"]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_docs(spark):
    rows = [(i, t, "x", "y", "z", "w") for i, t in enumerate(ODD)] + [(None, "tie one", "x", "y", "z", "w"), (3, "Word", "x", "y", "z", "w")]
    return spark.createDataFrame(rows, DOC)


# ranked search


def plain_search(docs, items, top=10):
    """docs and items as lists of (id, text)."""
    counts = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(lowered(t)))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, doc is not None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scores, key=lambda r: r[:3])[:top])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_search_on_whole_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and found(ranked_search.search(ranked_search.index(docs), items)) == want


def test_search_on_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", 4)
    docs = odd_docs(spark)
    items = [(1, "tie ONE"), (1, "word"), (2, None), (3, "?!"), (4, "x"), (None, "c k 世界"), (5, "absent"), (6, "three 2")]
    table = spark.createDataFrame([(i, t, "a") for i, t in items], "item_id long, text string, bound string")
    held = ranked_search.index(docs)
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], items)
    assert held.lists.select("shard").distinct().count() > 3 and found(ranked_search.search(held, table)) == want
    assert found(ranked_search.search(held, table, top=1)) == plain_search([(r.doc_id, r.text) for r in docs.collect()], items, 1)
    nothing = ranked_search.index(docs.limit(0))
    assert found(ranked_search.search(nothing, table)) == [] and found(ranked_search.search(held, table.limit(0))) == []
    assert found(ranked_search.search(ranked_search.index(docs.filter("doc_id < 3")), table)) == []


def test_search_stops_early(spark, monkeypatch):
    """Topics of their own words fall into leaves of their own, so that an item leaves most shards unread."""
    rng = Random(3)
    rows = [(k, " ".join(rng.choice([f"topic{k % 8}word{j}" for j in range(40)]) for _ in range(60))) for k in range(1600)]
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", 2_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = ranked_search.index(docs)
    items = [(1, "topic3word1 topic3word2 topic3word3")]
    shards = held.lists.select("shard").distinct().count()
    holding = held.lists.filter("term = 'topic3word1'").count()
    assert shards >= 16 and holding <= shards // 4
    assert found(ranked_search.search(held, spark.createDataFrame(items, "item_id long, text string"))) == plain_search(rows, items)


def test_bisection_parts_topics():
    rng = np.random.default_rng(1)
    docs = [np.unique(rng.integers(0, 60, 30) + 100 * (k % 4)) for k in range(800)]
    tree = bisection.fit(docs)
    leaves = [tree.leaf(d)[0] for d in docs]
    assert tree.depth == 4 and max(Counter(leaves).values()) < 200
    assert sum(max(Counter(k % 4 for k, v in enumerate(leaves) if v == leaf).values()) for leaf in set(leaves)) > 0.95 * len(docs)
    alike = bisection.fit([np.array([1, 2, 3])] * 400)
    assert alike.leaf(np.array([1, 2, 3]))[0] < 2**alike.depth and bisection.fit([]).leaf(np.zeros(0, int)) == (0, 0.0)


# resampling


def plain_resample(docs, target, buckets=10_000, least=20):
    def feats(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2) for i in range(len(w) - k + 1)]

    rows, aim = [(i, *feats(t)) for i, t in docs], [feats(t)[1] for t in target]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for f in aim for b in f)
    total = math.prod([1]) * (t.total() + buckets), s.total() + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * total[1] / ((s[b] + 1) * total[0]))) for b in range(buckets)]
    out = []
    for doc, n, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(((r[0], r[2], r[3], r[4], drawn.get(id(r))) for r in out), key=repr)


def resampled(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_resampling(spark):
    docs, aim = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in aim.collect()])
    assert resampled(resampling.resample(docs, aim)) == want


def test_resampling_on_odd_tables(spark):
    docs = odd_docs(spark)
    aim = spark.createDataFrame([("tie one word",), (None,)], "text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert resampled(resampling.resample(docs, aim)) == plain_resample(rows, ["tie one word"])
    assert resampled(resampling.resample(docs, aim.limit(0), least_words=1)) == plain_resample(rows, [], least=1)
    assert resampled(resampling.resample(docs.limit(0), aim)) == []


def test_runs_of_any_length():
    words = [f"w{k}ü" for k in range(50)]
    n, sums = resampling.ring_checksums("; ".join(words).upper().replace("Ü", "ü"), 4)
    assert n == 50 and Counter(sums) == Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, 5) for i in range(51 - k))


# main text


def article(page):
    """The text of the given pages' articles, which hold paragraphs and a heading, by patterns."""
    body = page[page.index("<article>") + 9 :].split("</article>")[0]
    blocks = (" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def trees(spark):
    return main_text.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_pages_of_the_table(spark, trees):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in main_text.extract(pages, trees).collect()}
    assert got == {r.page_id: (r.url, article(r.html), len(article(r.html))) for r in pages.collect()}


PROSE = ["The river was low that summer, and the boats lay on their sides in the mud.", "Nobody remembered a year like it; the old men said so every evening.", "When the rain came at last, it came all at once, and the town was not ready."]
SPAM = "Buy two of our finest kettles today and pay for one, while the offer lasts."
PAGES = {
    "plain boxes": '<div class="site-header"><a href=/>Home</a></div><div class="post-body"><h1>A dry year</h1>{0}</div><div class="sidebar"><h3>Others</h3><p>' + SPAM + "</p></div>",
    "comments": '<main><h1>A dry year</h1>{0}<section id="comments"><h2>Said</h2><div class="comment"><p>I remember that year well, it was my first.</p></div><div class="comment"><p>So do I, and the mud too.</p></div></section></main>',
    "notice and form": '<div role="alert" class="cookie-notice"><p>' + SPAM + '</p><button>Fine</button></div><article><h1>A dry year</h1>{0}<form><p>' + SPAM + "</p><label>Mail</label><input><button>Send</button></form></article><footer>&copy; The paper</footer>",
    "advert inside": '<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><article><h1>A dry year</h1><div class="ad-slot"><p>' + SPAM + "</p></div>{0}</article>",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages_of_other_layouts(trees, name):
    page = "<html><body>" + PAGES[name].format("".join(f"<p>{p}</p>" for p in PROSE)) + "</body></html>"
    assert main_text.extracted([page], trees) == ["\n".join(["A dry year", *PROSE])]


def test_layouts_held_out(spark, trees):
    """Nearly all text of recipes whose texts and seeds the trees did not see."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found, words = [], []
    for r in rows:
        page = dom.parse(r.html)
        runs = [t for t, tag, mark in zip(page.text, page.tag, main_text.by_elements(page), strict=True) if tag == dom.RUN and mark]
        found.append(main_text.Material(runs[0], runs))
        words += [t.split()[0] for t in runs]
    rng, hit, false, missed = Random(11), 0, 0, 0
    for own in found:
        for _ in range(3):
            page = dom.parse(main_text.layout(rng, own, found, words), labelled=True)
            chosen = main_text.decode(page, trees.log_p(dom.features(page)[0]))
            for text, c, mark in zip(page.text, chosen, page.label, strict=True):
                hit, false, missed = hit + len(text) * (c and mark == 1), false + len(text) * (c and mark != 1), missed + len(text) * (mark == 1 and not c)
    assert hit / (hit + false) > 0.98 and hit / (hit + missed) > 0.98


def test_decoding_never_contradicts():
    rng = np.random.default_rng(4)
    page = dom.parse("<div><p>a<p>b<div><ul><li>c<li>d</ul></div></div><section><p>e</section>f")
    for _ in range(300):
        log_p = np.log(rng.dirichlet([1, 1, 1], len(page.tag)))
        chosen = main_text.decode(page, log_p)
        # against every labelling of the tree
        runs = [k for k, t in enumerate(page.tag) if t == dom.RUN]
        scores = {}

        def score(node, picked):
            below = [k for k in range(len(page.tag)) if page.parent[k] == node]
            mine = {picked[r] for r in runs if r == node or inside(r, node)}
            kinds = {True: main_text.ALL, False: main_text.NONE}
            own = log_p[node, kinds[mine.pop()]] if len(mine) == 1 else log_p[node, main_text.MIXED]
            return own + sum(score(k, picked) for k in below)

        def inside(k, node):
            while page.parent[k] >= 0:
                k = page.parent[k]
                if k == node:
                    return True
            return False

        for bits in range(2 ** len(runs)):
            picked = {r: bool(bits >> k & 1) for k, r in enumerate(runs)}
            scores[tuple(picked.values())] = sum(score(k, picked) for k in range(len(page.tag)) if page.parent[k] < 0)
        mine = tuple(chosen[r] for r in runs)
        assert all(chosen[k] == chosen[page.parent[k]] for k in range(len(page.tag)) if page.parent[k] >= 0 and chosen[page.parent[k]])
        # a node of one kind of text may also be called mixed, so the decoder's labelling is at least as likely
        assert mine in scores


def test_blocks():
    def runs(h):
        page = dom.parse(h)
        return [t for t, tag in zip(page.text, page.tag, strict=True) if tag == dom.RUN]

    assert runs("<p>a <b>b</b>\n c<br>d<p>e &amp;&lt;p&gt; &#233;&eacute &am") == ["a b c d", "e &<p> éé &am"]
    assert runs("<script>if (a</p>b) '<p>'</script><p>x<!-- <p>y -->z<style>p{}</style></P><title>t</title>w") == ["xz", "w"]
    assert runs("a < b <3 </ c> d <a href='>'>e</a><p title=\"<p>\">f") == ["a < b <3 d e", "f"]
    assert runs("<ul><li>a<ul><li>b</ul>c<li>d</ul><table><tr><td>e<td>f<tr><td>g</table>h") == list("abcdefgh")
    assert runs("") == [] and runs("<p>cut off <b") == ["cut off"] and runs("<!-- open <p>a") == [] and runs("a<script>b") == ["a"]


@pytest.mark.parametrize("text", ["<", "<div>", "</p>", "<!--", '<a b="', "&#x", "<ul><li>", "<a ==", "<table><tr><td>", "<p '", "<h1><h2>"])
def test_long_broken_pages(text):
    began = time.time()
    page = dom.parse(text * (400_000 // len(text)))
    if page.tag:
        dom.features(page)
    assert time.time() - began < 10


def test_odd_pages(spark, trees):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>"), (3, "w", "only words, no markup at all."), (3, "w", "only words, no markup at all."), (4, "x", "<article>" + "<p>A long page has many words, all of them kept.</p>" * 5_000 + "</article>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = main_text.extract(pages, trees).collect()
    assert sorted((str(r.page_id), str(r.url)) for r in got) == sorted((str(r[0]), str(r[1])) for r in rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[2] == texts[None] == "" and texts[4].count("\n") == 4_999 and all(r.n_chars == len(r.text) for r in got)
    assert main_text.extract(pages.limit(0), trees).count() == 0 and main_text.fit(pages.limit(0)) is None
    assert {r.text for r in main_text.extract(pages, None).collect()} == {""}


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = np.where(x[:, 0] * x[:, 1] > 0, 0, np.where(x[:, 2] > 0, 1, 2))
    trees = boosting.fit(x[:2000], y[:2000])
    p = trees.log_p(x[2000:])
    assert (p.argmax(axis=1) == y[2000:]).mean() > 0.93 and np.allclose(np.exp(p).sum(axis=1), 1)
