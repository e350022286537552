"""Processes against a queue, over whole tables."""

import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from spanwood import views as V
from spanwood.operators import entries as E
from spanwood.plans import graph as G

SF = "/root/testdata/sf0.001"


def plain(nodes, edges, communities=None, max_depth=10, branching=4, least=3, most=75):
    functions = {n.id: n for n in nodes if n.kind in ("function", "method")}
    calls = sorted({(e.source_id, e.target_id) for e in edges if e.kind == "calls"})
    scored = []
    for n in functions.values():
        out, into = sum(s == n.id for s, _ in calls), sum(t == n.id for _, t in calls)
        if out:
            ext = re.search(r"\.[^./]*$", n.file)
            own = E.BY_EXTENSION.get(ext[0].lower() if ext else "", [])
            score = out / (into + 1) + n.exported + 2 * any(re.search(p, n.name) for p in E.ANY) + 1.5 * any(re.search(p, n.name) for p in own) - 5 * bool(re.search(E.TESTS, n.file))
            if score > 0:
                scored.append((-round(score, 8), n.id))
    found = []
    for score, entry in sorted(scored):
        trace, queue = [entry], deque([(entry, 0)])
        while queue:
            node, depth = queue.popleft()
            if depth < max_depth:
                new = [t for s, t in calls if s == node and t in functions and t not in trace][:branching]
                trace += new
                queue += [(t, depth + 1) for t in new]
        if len(trace) >= least and len(found) < most:
            name = functions[entry].name
            label = " → ".join(functions[i].name for i in trace[:3]) + (f" (+{len(trace) - 3})" if len(trace) > 3 else "")
            kind = "unknown" if communities is None else "cross_community" if len({communities[i] for i in trace}) > 1 else "intra_community"
            found.append((f"proc_{re.sub('[^a-zA-Z0-9_]', '_', name)[:30]}_{entry}", label, kind, len(trace), entry, trace[-1], -score, trace))
    return sorted(found)


def rows(df):
    return sorted((r.process, r.label, r.type, r.steps, r.entry, r.terminal, r.score, list(r.trace)) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"most": 5, "least_steps": 4, "branching": 1, "max_depth": 3}])
def test_processes(spark, options):
    nodes, edges = G._code_nodes(spark, SF), V.edges(spark, SF)
    of = nodes.select("id", (F.col("id") % 7).alias("community"))
    want = plain(nodes.collect(), edges.collect(), None if options else {r.id: r.community for r in of.collect()}, **{k.replace("least_steps", "least"): v for k, v in options.items()})
    assert want and rows(E.processes(nodes, edges, None if options else of, **options)) == want


def test_crossing_branches(spark):
    """Two nodes of a level share callees: the first in turn takes them, which leaves room for others of the second."""
    nodes = spark.createDataFrame([(i, f"f{i}", "function", "a.go", False) for i in range(1, 12)] + [(12, "t", "class", "a.go", False)], "id long, name string, kind string, file string, exported boolean")
    calls = [(1, 2), (1, 3), *[(2, t) for t in (4, 5, 6, 7, 8)], *[(3, t) for t in (4, 5, 6, 7, 8, 9, 10, 11)], (1, 12), (9, 1)]
    edges = spark.createDataFrame([(s, t, "calls") for s, t in calls], "source_id long, target_id long, kind string")
    got = {r.entry: list(r.trace) for r in E.processes(nodes, edges).collect()}
    assert got[1] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11] and got[9][:3] == [9, 1, 2]
    assert E.processes(nodes, edges.limit(0)).count() == 0


def test_names(spark):
    cases = [("handle_x", "a.py", True, True), ("once", "a.py", False, False), ("doGet", "A.java", False, True), ("doGet", "a.py", False, False), ("main", "a.zig", True, False), ("OnClick", "a.cs", True, True), ("index", "a.rb", False, True), ("onClick", "a.tsx", True, True)]
    df = spark.createDataFrame(cases, "name string, file string, u boolean, l boolean")
    assert df.filter((E.universal(df.name) != df.u) | (E.of_language(df.name, df.file) != df.l)).count() == 0
