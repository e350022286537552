"""A lenient tree of a page's block elements, and features of its nodes. One pass over the text, linear on broken markup."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import numpy as np

# attributes are read as the standard's tokenizer reads them: a quote matters behind "=" only, an open one runs to the end
_ATTRIBUTES = r"""((?:[^>=]++|=[ \t\n\f\r]*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+)"""
_MARKUP = re.compile(r"<(?:!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^ \t\n\f\r/>]*+)" + _ATTRIBUTES + r"(?:>|\Z))")
_ATTRIBUTE = re.compile(r"""([^ \t\n\f\r/=>"']++)[ \t\n\f\r]*+(?:=[ \t\n\f\r]*+("[^"]*+"?|'[^']*+'?|[^ \t\n\f\r>]*+))?""")
_TOKEN = re.compile("[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is never text of the page, up to their end tag or the end.
RAW = frozenset("script style template iframe noembed noframes textarea title xmp svg math object".split())
#: Elements that stand inside a line of text; all others part blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr progress q rp rt ruby s samp small span strike strong sub sup time tt u var img picture source wbr video audio track map area embed canvas".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: What an element's start tag ends if it is open, as far as the last of the elements in the second list.
_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "option": ("option", ("select",)), "tr": ("tr", ("table",)), "td": ("td", ("table", "tr")), "th": ("th", ("table", "tr"))}
_ALSO = {"dt": "dd", "dd": "dt", "td": "th", "th": "td"}
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

# fixed values: words of class, id, role and itemprop by what they tell
TOKENS = {
    "advert": "ad ads adv advert adverts advertisement adslot adsense dfp sponsor sponsored promo promotion promoted commercial".split(),
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs tabs pagination pager toc".split(),
    "comment": "comment comments commentlist disqus reply replies respond response responses discussion thread".split(),
    "notice": "cookie cookies consent gdpr notice notices alert notification popup modal dialog overlay paywall disclaimer warning banner".split(),
    "share": "share sharing social follow".split(),
    "related": "related recommended recommendations popular trending teaser teasers latest recent outbrain taboola".split(),
    "side": "sidebar side aside rail widget widgets complementary".split(),
    "head": "header masthead topbar logo brand tagline".split(),
    "foot": "footer foot copyright colophon legal imprint contentinfo bottom".split(),
    "form": "form search newsletter subscribe subscription signup login register".split(),
    "main": "article content main post entry story articlebody prose text body".split(),
    "hidden": "hidden invisible".split(),
}
CLASSES = {word: k for k, words in enumerate(TOKENS.values()) for word in words}
TAGS = ["article", "main", "section", "div", "p", "heading", "list", "li", "nav", "header", "footer", "aside", "form", "control", "table", "figure", "quote", "pre", "body", "#run"]
_TAG_OF = (
    {t: k for k, t in enumerate(TAGS)}
    | {h: TAGS.index("heading") for h in _HEADINGS}
    | {t: TAGS.index("list") for t in ("ul", "ol", "dl", "menu")}
    | {t: TAGS.index("li") for t in ("dt", "dd")}
    | {t: TAGS.index("control") for t in ("button", "select", "option", "input", "fieldset", "legend", "noscript")}
    | {t: TAGS.index("table") for t in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption")}
    | {"figcaption": TAGS.index("figure"), "blockquote": TAGS.index("quote"), "html": TAGS.index("body")}
)
RUN, OTHER = TAGS.index("#run"), len(TAGS)


class Page(NamedTuple):
    """Nodes in page order: block elements and, as leaves, runs of text between block boundaries."""

    parent: list[int]
    tag: list[int]
    tokens: list[int]
    text: list[str]
    link: list[int]
    links: list[int]
    controls: list[int]
    label: list[int]


def parse(html: str, labelled: bool = False) -> Page:
    """The page's blocks. With `labelled`, an attribute data-y (0 or 1) labels what it holds, by the nearest one; else -1."""
    page = Page([], [], [], [], [], [], [], [])
    stack: list[tuple[str, int]] = []
    opened: dict[str, list[int]] = {}
    run: list[str] = []
    links = [0, 0, 0]  # characters in links of this run, links, open links
    labels = [-1]

    def node(tag: int, tokens: int, text: str, link: int, n: int, controls: int) -> int:
        for values, v in zip(page, (stack[-1][1] if stack else -1, tag, tokens, text, link, n, controls, labels[-1]), strict=True):
            values.append(v)
        return len(page.tag) - 1

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            node(RUN, 0, text, min(links[0], len(text)), links[1], 0)
        run.clear()
        links[0] = links[1] = 0

    def push(tag: str, attributes: str) -> None:
        tokens, hidden = 0, False
        mark = None
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id", "role", "itemprop"):
                for word in _TOKEN.findall(value):
                    k = CLASSES.get(word.lower())
                    if k is not None:
                        tokens |= 1 << k
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                hidden = True
            elif labelled and name == "data-y":
                mark = int(value)
        if hidden:
            tokens |= 1 << CLASSES["hidden"]
        labels.append(labels[-1] if mark is None else mark)
        at = node(_TAG_OF.get(tag, OTHER), tokens, "", 0, 0, 0)
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, at))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()[0]].pop()
            labels.pop()

    def last(tag: str) -> int:
        found = opened.get(tag)
        return found[-1] if found else -1

    def close(tag: str, *until: str) -> None:
        at = last(tag)
        if at >= 0 and all(last(u) < at for u in until):
            pop_to(at)

    def say(text: str) -> None:
        if last("head") >= 0:
            if not text.strip():
                return
            close("head")
        run.append(text)
        if links[2] > 0:
            links[0] += len(text)

    at, end = 0, len(html)
    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            begin = end
        if begin > at:
            say(unescape(html[at:begin]) if "&" in html[at:begin] else html[at:begin])
        if begin == end:
            break
        m = _MARKUP.match(html, begin)
        if not m:
            # a "</" that no name follows is a comment up to ">", any other sign is text
            if html.startswith("</", begin) and begin + 2 < end:
                stop = html.find(">", begin)
                at = end if stop < 0 else stop + 1
            else:
                say("<")
                at = begin + 1
            continue
        at = m.end()
        if not m[2] or html[at - 1] != ">":
            continue  # a comment, or a tag that the end cuts off
        tag, ending = m[2].lower(), bool(m[1])
        if tag == "br":
            run.append(" ")
        elif tag in RAW:
            if not ending and not (tag in ("svg", "math") and m[3].endswith("/")):
                stop = re.compile(f"</{tag}(?=[ \t\n\f\r/>])[^>]*+(?:>|\\Z)", re.I).search(html, at)
                at = stop.end() if stop else end
        elif tag in INLINE:
            if tag == "a":
                links[2] = 0 if ending else 1
                links[1] += not ending
        elif ending:
            flush()
            if tag in _HEADINGS:
                found = max(last(h) for h in _HEADINGS)
                if found >= 0:
                    pop_to(found)
            elif tag in _ENDS:
                close(tag, *_ENDS[tag][1])
            elif tag not in ("body", "html"):
                close(tag, *(() if tag in ("table", "article", "main", "body") else ("td", "th") if tag == "p" else ("table",)))
        else:
            if last("head") >= 0 and tag not in _IN_HEAD:
                close("head")
            flush()
            close("p", "table", "button")
            if tag in _ENDS:
                name, until = _ENDS[tag]
                close(name, *until)
                if tag in _ALSO:
                    close(_ALSO[tag], *until)
            elif tag in _HEADINGS and stack and stack[-1][0] in _HEADINGS:
                pop_to(len(stack) - 1)
            if tag == "input":
                if stack:
                    page.controls[stack[-1][1]] += 1
            elif tag not in VOID and not (tag in ("html", "body") and last(tag) >= 0):
                push(tag, m[3])
    flush()
    return page


FEATURES = (
    ["chars", "share", "link_share", "links", "chars_a_node", "depth", "height", "before", "behind", "runs", "mean_run", "longest_run", "stops", "ended", "in_p", "headings", "in_li", "controls", "signs"]
    + ["place", "siblings", "same_tag", "of_parent", "last_chars", "last_link_share", "next_chars", "next_link_share", "parent_chars", "parent_link_share", "parent_runs"]
    + [f"tag_{t}" for t in TAGS]
    + [f"own_{t}" for t in TOKENS]
    + [f"above_{t}" for t in TOKENS]
    + [f"below_{t}" for t in TOKENS]
    + [f"above_{t}" for t in ("content", "edge", "aside", "form")]
)
_ABOVE_TAGS = [("article", "main"), ("nav", "header", "footer"), ("aside",), ("form", "control")]
_STOPS, _ENDERS, _SIGNS = re.compile("[.,;:!?。、，！？؟।]"), tuple(".!?:;\"'»”’)…。！？؟।"), re.compile("[©®™|»›·•→]")


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(nodes x FEATURES float32, the end of each node's subtree)."""
    n = len(page.tag)
    parent, tag = np.array(page.parent), np.array(page.tag)
    depth, end = np.zeros(n, np.int64), np.arange(1, n + 1)
    up = page.parent
    d, e = depth.tolist(), end.tolist()
    above = list(page.tokens)
    kinds = [sum(1 << k for k, tags in enumerate(_ABOVE_TAGS) if t < len(TAGS) and TAGS[t] in tags) for t in page.tag]
    for i in range(n):
        if up[i] >= 0:
            d[i] = d[up[i]] + 1
            above[i] |= above[up[i]]
            kinds[i] |= kinds[up[i]]
    for i in range(n - 1, 0, -1):
        if up[i] >= 0 and e[i] > e[up[i]]:
            e[up[i]] = e[i]
    depth, end = np.array(d), np.array(e)
    chars = np.array([len(t) for t in page.text], float)
    run = tag == RUN
    whole = max(1.0, chars.sum())

    def below(v: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(v, dtype=float)])
        return total[end] - total[:-1]

    text = below(chars)
    some = np.maximum(text, 1)
    link, links, runs = below(np.array(page.link, float)), below(np.array(page.links, float)), below(run)
    link_share = link / some
    stops = below(np.array([len(_STOPS.findall(t)) if t else 0 for t in page.text], float))
    ended = below(np.array([t.endswith(_ENDERS) if t else False for t in page.text], float))
    signs = below(np.array([len(_SIGNS.findall(t)) if t else 0 for t in page.text], float))
    up_tag = np.where(parent >= 0, tag[parent], OTHER)
    in_p, in_li = below(chars * (up_tag == TAGS.index("p"))), below(chars * (up_tag == TAGS.index("li")))
    headings, controls = below(tag == TAGS.index("heading")), below(np.array(page.controls, float) + (tag == TAGS.index("control")))
    cum = np.cumsum(chars) - chars
    longest = chars.copy()
    tall = np.zeros(n)
    under = list(page.tokens)
    for i in range(n - 1, 0, -1):
        p = up[i]
        if p >= 0:
            under[p] |= under[i]
            if longest[i] > longest[p]:
                longest[p] = longest[i]
            if tall[i] + 1 > tall[p]:
                tall[p] = tall[i] + 1
    # siblings in page order
    order = np.lexsort((np.arange(n), parent))
    fam = parent[order]
    first = np.concatenate([[True], fam[1:] != fam[:-1]]) if n else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    size = np.bincount(group) if n else np.zeros(0, int)
    start = np.flatnonzero(first)
    place, siblings, same = np.zeros(n), np.zeros(n), np.zeros(n)
    if n:
        place[order] = (np.arange(n) - start[group]) / np.maximum(size[group] - 1, 1)
        siblings[order] = size[group]
        pair = group * (OTHER + 1) + tag[order]
        _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        same[order] = count[back]
    before, behind = np.full(n, -1), np.full(n, -1)
    if n > 1:
        inner = fam[1:] == fam[:-1]
        before[order[1:][inner]] = order[:-1][inner]
        behind[order[:-1][inner]] = order[1:][inner]

    def of(v: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, v[at], -1.0)

    log = np.log1p(text)
    cols = [log, text / whole, link_share, np.log1p(links), np.log1p(text / (end - np.arange(n))), depth, tall, cum / whole, (whole - cum - text) / whole, np.log1p(runs), np.log1p(text / np.maximum(runs, 1)), np.log1p(longest), stops / some, ended / np.maximum(runs, 1), in_p / some, np.log1p(headings), in_li / some, np.log1p(controls), signs / some]
    cols += [place, np.log1p(siblings), np.log1p(same), np.where(parent >= 0, text / np.maximum(of(text, parent), 1), 1), of(log, before), of(link_share, before), of(log, behind), of(link_share, behind), of(log, parent), of(link_share, parent), of(np.log1p(runs), parent)]
    cols += [tag == k for k in range(len(TAGS))]
    for bits in (np.array(page.tokens, np.int64), np.array(above, np.int64), np.array(under, np.int64)):
        cols += [bits >> k & 1 for k in range(len(TOKENS))]
    cols += [np.array(kinds, np.int64) >> k & 1 for k in range(len(_ABOVE_TAGS))]
    return np.stack(cols, axis=1).astype(np.float32), end
