"""The main text of web pages: boosted trees over the nodes of the page's tree, decoded so that no node contradicts another.

A node is all text of the article, none of it, or mixed. The trees give each node's probabilities from its subtree's
density, attribute tokens, depth and siblings. Decoding takes the likeliest labelling in which all below a node of the first
two kinds is of that kind, in one pass from the leaves up and one back down.

No page is labelled. The trees learn from a bounded sample of the pages: as they are, where elements such as article, nav
and footer tell what they hold, and in recipes that set their texts into other layouts, in which what is article is known
and most of these elements are plain ones with telling, misleading or no attributes.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from random import Random
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import blank
from .dom import RUN, TAGS, TOKENS, Page, features, parse

#: Pages that the trees are fitted on at most, the longest of these in characters (so at most 10 MB reach the driver), layouts
#: made of each, and rows that the trees take at most.
SAMPLE, LONGEST, LAYOUTS, ROWS = 200, 50_000, 4, 24_000
#: Nodes that a task scores at once.
NODES = 20_000
ALL, NONE, MIXED = 0, 1, 2
#: No node is surer than this, so that one node can't outvote all below it.
SURE = 0.01

# labels from the elements of a page

_MAIN = {TAGS.index("article"), TAGS.index("main")}
_APART = {TAGS.index(t) for t in ("nav", "header", "footer", "aside", "form", "control")}
_APART_TOKENS = sum(1 << k for k, t in enumerate(TOKENS) if t in ("advert", "menu", "comment", "notice", "share", "related", "side", "form", "hidden"))


def by_elements(page: Page) -> list[int] | None:
    """1 for runs inside article or main and in none of its parts that are set apart, 0 for other runs; None without such a section."""
    if not _MAIN & set(page.tag):
        return None
    state: list[int] = []
    for up, tag, tokens in zip(page.parent, page.tag, page.tokens, strict=True):
        inside = state[up] if up >= 0 else 0
        state.append(2 if inside == 2 or tag in _APART or (inside == 1 and tokens & _APART_TOKENS) else 1 if tag in _MAIN else inside)
    return [int(s == 1) for s in state]


def node_labels(page: Page, end: np.ndarray, of_run: list[int]) -> np.ndarray:
    """ALL, NONE or MIXED for each node by its runs' labels; -1 for nodes without text."""
    run = np.array(page.tag) == RUN
    total = np.concatenate([[0], np.cumsum(run)])
    good = np.concatenate([[0], np.cumsum(run & (np.array(of_run) == 1))])
    n, k = total[end] - total[:-1], good[end] - good[:-1]
    return np.where(n == 0, -1, np.where(k == n, ALL, np.where(k == 0, NONE, MIXED)))


# recipes


class Material(NamedTuple):
    title: str
    prose: list[str]


def _pick(rng: Random, tokens: str) -> str:
    return rng.choice(TOKENS[tokens])


def _attr(rng: Random, tokens: str | None) -> str:
    """An attribute of a telling token, alone or among others."""
    if tokens is None:
        return rng.choice(["", "", f' class="{_noise(rng)}"'])
    word = _pick(rng, tokens)
    shape = rng.choice(["{}", "{}-{}", "{1} {0}", "{1}-{0}", "{1}_{0}_{1}", "js-{0} {1}"])
    return f' {rng.choice(["class", "class", "class", "id"])}="{shape.format(word, _noise(rng))}"'


def _noise(rng: Random) -> str:
    return "".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randint(2, 3))) + "x"


def layout(rng: Random, own: Material, others: list[Material], words: list[str]) -> str:
    """A page whose article is `own`, as HTML with data-y attributes; the rest is made of other pages' texts."""

    def prose(least: int = 1, most: int = 3) -> list[str]:
        found = rng.choice(others).prose
        text = rng.choice(found) if found else ""
        return [" ".join(text.split()[: rng.randint(6, 40)]) for _ in range(rng.randint(least, most))]

    def phrase(least: int = 1, most: int = 3) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(least, most)))

    def links(least: int, most: int) -> str:
        item = rng.choice(["<li><a href=/x>{}</a></li>", "<li><a href=/x>{}</a>", "<a href=/x>{}</a> ", "<div><a href=/x>{}</a></div>", "<p><a href=/x>{}</a></p>"])
        body = "".join(item.format(phrase(1, 4)) for _ in range(rng.randint(least, most)))
        return f"<ul>{body}</ul>" if "<li>" in item else body

    def box(tag: str | None, tokens: str, body: str, mark: int = 0) -> str:
        """A part: its own element (with or without attribute), or a plain one that an attribute tells of."""
        if tag and rng.random() < 0.4:
            return f"<{tag}{_attr(rng, rng.choice([None, tokens]))} data-y={mark}>{body}</{tag}>"
        name = rng.choice(["div", "div", "section"])
        return f"<{name}{_attr(rng, tokens)} data-y={mark}>{body}</{name}>"

    def paragraphs(found: list[str]) -> str:
        return "".join(f"<p>{escape(p)}</p>" for p in found)

    def notice() -> str:
        return box(None, "notice", paragraphs(prose(1, 2)) + rng.choice(["", f"<button>{phrase()}</button>", f"<a href=/x>{phrase()}</a>"]))

    def advert() -> str:
        text = escape(prose(1, 1)[0])
        return box(None, "advert", rng.choice([text, f"<p>{text}</p>", f"<a href=/x>{text}</a>", f"<h4>{phrase()}</h4><p>{text}</p>"]))

    def form() -> str:
        fields = "".join(f"<label>{phrase()}</label><input name=q>" for _ in range(rng.randint(1, 3)))
        return box("form", "form", rng.choice(["", f"<p>{escape(prose(1, 1)[0])}</p>"]) + fields + f"<button>{phrase()}</button>")

    def side() -> str:
        parts = [f"<h3>{phrase()}</h3>" + rng.choice([links(3, 8), paragraphs(prose())]) for _ in range(rng.randint(1, 3))]
        return box("aside", "side", "".join(rng.choice(["{}", "<div>{}</div>"]).format(p) for p in parts))

    def comments() -> str:
        item = rng.choice(["<li><b>{0}</b> <p>{1}</p></li>", "<div><p>{1}</p></div>", '<article class="comment"><h4>{0}</h4><p>{1}</p></article>', "<div><span>{0}</span><p>{1}</p><a href=/x>{0}</a></div>"])
        return box(None, "comment", f"<h2>{phrase()}</h2>" + "".join(item.format(phrase(), escape(p)) for p in prose(2, 6)))

    def related() -> str:
        return box(None, "related", f"<h3>{phrase()}</h3>" + rng.choice([links(3, 6), "".join(f"<div><h4><a href=/x>{phrase(3, 7)}</a></h4><p>{escape(p)}</p></div>" for p in prose(2, 4))]))

    def share() -> str:
        return box(None, "share", links(2, 5))

    body = []
    for text in own.prose:
        kind = rng.random()
        text = escape(text)
        if kind < 0.06:
            cut = text.split()
            text = " ".join(cut[: len(cut) // 2]) + f" <a href=/x>{' '.join(cut[len(cut) // 2 : len(cut) // 2 + 3])}</a> " + " ".join(cut[len(cut) // 2 + 3 :])
        if kind < 0.62:
            body.append(f"<p>{text}</p>")
        elif kind < 0.72:
            body.append(f"<p><b>{text}<br>")
        elif kind < 0.78:
            body.append(f"<h2>{' '.join(text.split()[:6])}</h2><p>{text}</p>")
        elif kind < 0.84:
            body.append(f"<blockquote>{text}</blockquote>")
        elif kind < 0.9:
            body.append("<ul>" + "".join(f"<li>{s}</li>" for s in text.split(". ")) + "</ul>")
        elif kind < 0.94:
            body.append("<table><tr>" + "".join(f"<td>{w}</td>" for w in text.split()[:8]) + "</tr></table>")
        else:
            body.append(f"<div>{text}</div>")
    inside = [f for f in (advert, share, form, related, notice) if rng.random() < 0.2]
    for part in inside:
        body.insert(rng.randint(0, len(body)), part())
    head = f"<h1>{escape(own.title)}</h1>" if rng.random() < 0.85 else ""
    tag = rng.choice(["article", "main", "div", "div", "div", "section"])
    tokens = rng.choice(["main", "main", None]) if tag in ("div", "section") else rng.choice([None, None, "main"])
    said = comments() if rng.random() < 0.5 else ""
    within = rng.random() < 0.5
    article = f"<{tag}{_attr(rng, tokens)} data-y=1>{head}{''.join(body)}{said if within else ''}</{tag}>"
    if rng.random() < 0.3:
        article = f"<div{_attr(rng, rng.choice(['main', None, 'side']))}>{article}{share() if rng.random() < 0.3 else ''}</div>"
    top = [box("header", "head", rng.choice([f"<h1>{phrase()}</h1>", f"<a href=/>{phrase()}</a>", f"<p>{phrase(2, 8)}</p>"]) + rng.choice(["", links(3, 6)]))] if rng.random() < 0.6 else []
    top += [box("nav", "menu", links(3, 9))] if rng.random() < 0.8 else []
    top += [p() for p in (notice, advert, form) if rng.random() < 0.3]
    bottom = ["" if within else said]
    bottom += [p() for p in (related, side, advert, notice, form) if rng.random() < 0.3]
    bottom += [box("footer", "foot", rng.choice([f"&copy; {phrase()} &middot; ", ""]) + rng.choice([f"<p>{escape(prose(1, 1)[0])}</p>", links(2, 6), escape(prose(1, 1)[0])]))] if rng.random() < 0.8 else []
    middle = [article]
    if rng.random() < 0.3:
        middle.insert(rng.randint(0, 1), side())
    page = "".join(top) + "".join(middle) + "".join(bottom)
    if rng.random() < 0.4:
        page = f'<div class="{rng.choice(["wrapper", "container", "layout", "has-sidebar", "with-header", "site-content", "page"])}">{page}</div>'
    page = f"<html><head><title>{phrase()}</title></head><body data-y=0>{page}</body></html>"
    return page[: len(page) - rng.randint(0, 40)] if rng.random() < 0.15 else page


def training_rows(htmls: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of nodes of these pages as they are and in LAYOUTS recipes each; at most ROWS, spread over all."""
    rng = Random(seed)
    xs, ys, found, words = [], [], [], []
    for html in htmls:
        page = parse(html)
        marks = by_elements(page)
        if marks is not None:
            x, end = features(page)
            xs.append(x)
            ys.append(node_labels(page, end, marks))
        runs = [(t, m) for t, tag, m, n in zip(page.text, page.tag, marks or [-1] * len(page.tag), page.links, strict=True) if tag == RUN and (m == 1 or (marks is None and not n))]
        texts = [t for t, _ in runs]
        words += [w for t, tag in zip(page.text, page.tag, strict=True) if tag == RUN for w in t.split()[:3]]
        prose = [t for t in texts if len(t.split()) >= 5] or texts
        if prose:
            found.append(Material(" ".join(texts[0].split()[:10]), prose[:30]))
    for own in found:
        for _ in range(LAYOUTS):
            page = parse(layout(rng, own, found, words), labelled=True)
            x, end = features(page)
            xs.append(x)
            ys.append(node_labels(page, end, page.label))
    x, y = (np.concatenate(v) if v else np.zeros(shape) for v, shape in ((xs, (0, 0)), (ys, 0)))
    rows = np.flatnonzero(y >= 0)
    if len(rows) > ROWS:
        rows = np.sort(np.random.default_rng(seed).choice(rows, ROWS, replace=False))
    return x[rows], y[rows].astype(np.int64)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> boosting.Trees | None:
    """Trees from some SAMPLE of the pages by a hash of their id, none longer than LONGEST; None if these hold no text."""
    able = pages.filter(F.length(html_col).between(1, LONGEST)).select(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)).alias("h"), F.col(html_col).alias("html"))
    share = min(1.0, 2 * SAMPLE / max(1, able.count()))
    htmls = [r.html for r in able.filter(F.col("h") < F.lit(share * 1_000_000)).orderBy("h", F.xxhash64("html")).limit(SAMPLE).collect()]
    x, y = training_rows(htmls)
    return boosting.fit(x, y) if len(np.unique(y)) > 1 else None


# decoding


def decode(page: Page, log_p: np.ndarray) -> list[bool]:
    """For each node whether its text is main text, by the likeliest labelling of the tree without contradiction."""
    n = len(page.tag)
    every, none = log_p[:, ALL].tolist(), log_p[:, NONE].tolist()
    parts = log_p[:, MIXED].tolist()  # MIXED, with the best labelling of what is below
    held = [False] * n
    best = [0.0] * n
    up = page.parent
    for i in range(n - 1, -1, -1):
        leaf = page.tag[i] == RUN
        if leaf:
            held[i] = True
        elif not held[i]:  # no text below
            continue
        best[i] = max(every[i], none[i]) if leaf else max(every[i], none[i], parts[i])
        p = up[i]
        if p >= 0:
            held[p] = True
            every[p] += every[i]
            none[p] += none[i]
            parts[p] += best[i]
    out = [MIXED] * n
    for i in range(n):
        above = out[up[i]] if up[i] >= 0 else MIXED
        if above != MIXED:
            out[i] = above
        elif page.tag[i] == RUN or not held[i]:
            out[i] = ALL if every[i] >= none[i] else NONE
        else:
            out[i] = (ALL, NONE, MIXED)[int(np.argmax((every[i], none[i], parts[i])))]
    return [o == ALL for o in out]


def extracted(htmls: list[str], trees: boosting.Trees) -> list[str]:
    """The main text of each page; nodes of all pages are scored together."""
    pages = [parse(h) for h in htmls]
    made = [features(p)[0] for p in pages if p.tag]
    log_p = np.log(np.clip(np.exp(trees.log_p(np.concatenate(made))), SURE, 1 - SURE)) if made else np.zeros((0, 3))
    out, at = [], 0
    for page in pages:
        n = len(page.tag)
        chosen = decode(page, log_p[at : at + n]) if n else []
        out.append("\n".join(t for t, tag, c in zip(page.text, page.tag, chosen, strict=True) if tag == RUN and c))
        at += n
    return out


def extract(pages: DataFrame, trees: boosting.Trees | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return page_id, url, text, n_chars of every page, from the whole html.

    Blocks of the article come in page order, one a line, white space in each as one space, character references decoded;
    a line break counts as white space. Null and empty pages, and pages without markup that none of the trees takes for an
    article, have the empty text; n_chars is its code points. Pages are judged one by one, repeated rows alike; null ids and
    urls are carried, other columns are not read. Without trees (an empty table, or no text in the sample) all texts are
    empty. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size, upto = 0, at
                while upto < batch.num_rows and size < NODES * 50:  # some 50 characters a node
                    size += len(batch.column(2)[upto].as_py())
                    upto += 1
                htmls = batch.column(2).slice(at, upto - at).to_pylist()
                texts = extracted(htmls, trees) if trees else [""] * len(htmls)
                ids, urls = batch.column(0).slice(at, upto - at), batch.column(1).slice(at, upto - at)
                yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                at = upto

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), blank(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
