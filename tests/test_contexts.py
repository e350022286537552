"""Pieces of texts and assembled contexts against plain versions over whole tables."""

import random
import time

import pytest

from spanwood.functions import pieces as P
from spanwood.operators import assembly as A
from spanwood.operators.service import TEMPLATES
from spanwood.plans import retrieval

SF = "/root/testdata/sf0.001"


def plain_pieces(text, signature, budget):
    """The same rule, looking at every place of each window."""
    if not text or budget <= 0:
        return []
    data = text.encode()
    room = budget - 30 if budget > 30 else budget // 2
    most = max(1, int(room * 2.0))
    if len(data) <= most and int(len(data) / 2.5) <= int(budget * 0.85):
        return [(0, text, True)]
    radius = max(200, most // 10)
    starts = {0}
    out, start = [], 0

    def is_start(i):
        return i >= len(data) or data[i] & 0xC0 != 0x80

    while len(data) - start > most:
        limit, best = start + most, None
        for place in range(max(out[-1][1] if out else 0, limit - radius) + 1, limit + 1):
            if data[place - 1] == 10:
                line = data[data.rfind(b"\n", 0, place - 1) + 1 : place - 1]
                bare = line.strip()
                rank = 3 if not bare else 2 if bare in (b"}", b"});", b"},", b");") else 0 if bare in (b"{", b"} else {", b"} else if") else 0 if line[:1] in (b" ", b"\t") else 1
                score = rank - 0.5 * (limit - place) / radius
                if rank and (best is None or score > best[0]):
                    best = (score, place)
        end = best[1] if best else next((i for i in range(limit, start, -1) if is_start(i)), None) or next(i for i in range(limit, len(data) + 1) if is_start(i))
        out.append((start, end))
        back = end - min(int(budget * 0.15 * 2.5), most // 2)
        after = next((i for i in range(back, start, -1) if is_start(i)), None) if back > start else None
        start = after or end
        assert start not in starts
        starts.add(start)
    out.append((start, len(data)))
    return [(k, (f"// [{signature} — chunk {k + 1}/{len(out)}]\n" if signature else "") + data[a:b].decode(), False) for k, (a, b) in enumerate(out)]


@pytest.mark.parametrize("budget", [1, 20, 31, 100, 400])
def test_pieces(spark, budget):
    rng = random.Random(budget)
    lines = ["", "x = 1", "    y = 2", "}", "});", "{", "} else {", "größe überall 世界", "a" * 90]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 120))) for _ in range(30)] + ["é" * 700, "a", "", "a" * 333, "\n" * 500, "🎉" * 200]
    for text in texts + ([r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] if budget >= 100 else []):
        for signature in ("", "func f"):
            assert P.pieces(text, signature, budget) == plain_pieces(text, signature, budget)
    assert P.pieces(None, "", 10) == P.pieces("a", "", 0) == []


def test_pieces_hold_all(spark):
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        data = (r.text or "").encode()
        spans = P.spans(data, 100)
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(b - a <= 140 for a, b in spans)
        assert all(a < c <= b < d for (a, b), (c, d) in zip(spans, spans[1:], strict=False))


def test_long_text():
    began = time.time()
    assert len(P.pieces("word and word\n" * 300_000, "s", 100)) > 30_000 and len(P.pieces("é" * 3_000_000, "s", 100)) > 30_000
    assert time.time() - began < 30


def test_query(spark):
    got = retrieval.fn08_structured_pieces(spark, SF).groupBy("id").count().collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.id: r["count"] for r in got} == {i: len(plain_pieces(t, "x", 400)) for i, t in texts.items() if t}


def plain_context(hits, name, budget, pass_on):
    """Sections of one query's hits, one after the other."""
    t = TEMPLATES[name]

    def kind_of(h):
        if h.depth == 0 and h.source in ("semantic_desc", "semantic_code", "keyword"):
            return "targets"
        if "graph" in h.source and ("called_by" in h.source or (h.kind == "function" and h.depth > 0)):
            return "callers"
        if "graph" in h.source and "calls" in h.source:
            return "callees"
        if h.kind in ("type", "interface", "struct", "class", "enum"):
            return "types"
        return "dataflow" if "dataflow" in h.source else "imports" if "import" in h.source or "contains" in h.source else "general"

    by = {}
    for h in sorted(hits, key=lambda h: h.rank):
        by.setdefault(kind_of(h), []).append(h)
    made = []
    for k, (title, most, priority) in enumerate(t.sections):
        wants = next((c for c, titles in A.SECTIONS.items() if title in titles), "general")
        seen, lines = set(), []
        for h in by.get(wants) or by.get("general") or []:
            if (h.file, h.line) not in seen:
                seen.add((h.file, h.line))
                lines.append(f"// {h.file}:{h.line} {h.name} ({h.kind})")
                if h.content:
                    own = h.content.split("\n")
                    lines += own[:most] + (["// ... (truncated)"] if len(own) > most else [])
                lines.append("")
        if seen:
            made.append([-priority, k, title, "\n".join(lines), priority])
    made.sort(key=lambda m: m[:2])
    total, left, spare, out = sum(m[4] for m in made), budget, 0, []
    for _, _, title, content, priority in made:
        if left <= 0:
            break
        share = min(budget * priority // total + (spare if pass_on else 0), left)
        if len(content.encode()) // 4 > share:
            content = content.encode()[: share * 4].decode(errors="ignore") + "\n// ... (budget trimmed)"
        tokens = len(content.encode()) // 4
        left, spare = left - tokens, max(share - tokens, 0)
        out.append((title, content, tokens, priority))
    return out


@pytest.mark.parametrize(("name", "budget", "pass_on"), [("understand_function", 4000, False), ("change_impact", 700, True), ("debug_trace", 90, False), ("explore_module", 5000, True), ("general", 50, True)])
def test_contexts(spark, name, budget, pass_on):
    hits = retrieval._hits(spark, SF)
    by = {}
    for h in hits.collect():
        by.setdefault(h.query, []).append(h)
    got = {}
    for r in A.assembled(hits, name, budget, pass_on).orderBy("query", "place").collect():
        got.setdefault(r.query, []).append((r.title, r.content, r.tokens, r.priority))
    want = {q: plain_context(hs, name, budget, pass_on) for q, hs in by.items()}
    assert got == {q: w for q, w in want.items() if w} and len(got) > 3


def test_no_budget_and_no_hits(spark):
    hits = retrieval._hits(spark, SF)
    rows = A.assembled(hits, "general", 0).collect()
    assert rows and all("budget trimmed" not in r.content for r in rows)
    assert A.assembled(hits.limit(0), "general").count() == 0
