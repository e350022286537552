"""The call sequence against a recursive walk."""

import pytest

from spanwood import views as V
from spanwood.operators.sequence import call_sequence

SF = "/root/testdata/sf0.001"


def plain(nodes, edges, entry, max_depth=10, most=1000, keep=lambda n: True):
    by = {n.id: n for n in nodes}
    calls = sorted({(e.source_id, e.target_id) for e in edges if e.kind == "calls" and e.target_id in by})
    out, seen, cut = [], set(), [False]

    def walk(node, depth):
        if depth >= max_depth or node in seen:
            cut[0] |= depth >= max_depth
            return
        seen.add(node)
        for s, t in calls:
            if s == node and keep(by[t]):
                out.append((depth + 1, by[node].file, by[t].file, by[t].name, by[t].line))
                walk(t, depth + 1)

    walk(entry, 0)
    return [(k + 1, *row, cut[0] or len(out) > most) for k, row in enumerate(out[:most])]


@pytest.fixture(scope="module")
def graph(spark):
    nodes, edges = V.nodes(spark, SF).cache(), V.edges(spark, SF).cache()
    return nodes, edges, nodes.collect(), edges.collect()


@pytest.mark.parametrize("options", [{}, {"max_depth": 1}, {"max_depth": 3}, {"most": 4}])
def test_order(graph, options):
    nodes, edges, n, e = graph
    starts = sorted({x.source_id for x in e if x.kind == "calls"}, key=lambda i: -len(plain(n, e, i)))[:3]
    for entry in starts:
        want = plain(n, e, entry, **options)
        assert want and [tuple(r) for r in call_sequence(nodes, edges, entry, **options).orderBy("step").collect()] == want


def test_filters_cycles_and_gaps(spark):
    nodes = spark.createDataFrame([(i, f"f{i}", "function" if i != 5 else "class", f"{'a' if i % 2 else 'b'}/x{i}{'_test' if i == 4 else ''}.go", i) for i in range(1, 8)], "id long, name string, kind string, file string, line int")
    edges = spark.createDataFrame([(s, t, "calls") for s, t in [(1, 2), (2, 1), (2, 3), (1, 3), (3, 4), (4, 6), (3, 5), (5, 7), (1, 99), (1, 2)]], "source_id long, target_id long, kind string")
    n, e = nodes.collect(), edges.collect()
    rows = lambda **o: [tuple(r) for r in call_sequence(nodes, edges, 1, **o).orderBy("step").collect()]
    assert rows() == plain(n, e, 1) and [r[4] for r in rows()] == ["f2", "f1", "f3", "f4", "f6", "f5", "f7", "f3"]
    assert rows(no_tests=True) == plain(n, e, 1, keep=lambda x: "_test." not in x.file)
    assert rows(kind="function") == plain(n, e, 1, keep=lambda x: x.kind == "function")
    assert rows(files=["b/"]) == plain(n, e, 1, keep=lambda x: "b/" in x.file)
    assert call_sequence(nodes, edges, 77).count() == call_sequence(nodes, edges, 7).count() == 0
