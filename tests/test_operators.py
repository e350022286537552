"""Small cases with known answers: graphs, roles, text functions, search, journals, sources."""

from collections import deque
from itertools import product

import pytest
from pyspark.sql import functions as F

from spanwood.functions import text as X
from spanwood.operators import search as R
from spanwood.operators import structure as S
from spanwood.operators.betweenness import betweenness
from spanwood.operators import traverse as T
from spanwood.sources import files as I
from spanwood.streaming import streams


def graph(spark, n, pairs, kind="calls"):
    nodes = spark.createDataFrame([(i,) for i in range(1, n + 1)], "id long")
    return nodes, spark.createDataFrame([(a, b, kind) for a, b in pairs], "source_id long, target_id long, kind string")


CASES = [(3, [(1, 2), (2, 3)]), (2, [(1, 2), (2, 1)]), (4, [(1, 2), (3, 4)]), (1, []), (6, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)])]


@pytest.mark.parametrize("n, pairs", CASES)
def test_components_levels_and_ranks(spark, n, pairs):
    nodes, edges = graph(spark, n, pairs)
    reach = {i: {i} for i in range(1, n + 1)}
    for _ in range(n):
        for a, b in pairs:
            for x in reach:
                if a in reach[x]:
                    reach[x].add(b)
    strong = {i: min(j for j in reach if j in reach[i] and i in reach[j]) for i in reach}
    assert dict(map(tuple, S.strong_components(nodes, edges).collect())) == strong
    dag = all(strong[i] == i for i in strong)
    assert S.is_dag(nodes, edges).first()[0] == dag
    ranks = [r["rank"] for r in S.pagerank(nodes, edges, rounds=10).collect()]
    assert len(ranks) == n and abs(sum(ranks) - 1) < 1e-9
    weak = {i: i for i in reach}
    for _ in range(n):
        for a, b in pairs:
            weak[a] = weak[b] = min(weak[a], weak[b])
    assert dict(map(tuple, S.weak_components(nodes, edges).collect())) == weak


def test_empty_graph(spark):
    nodes, edges = graph(spark, 0, [])
    assert S.strong_components(nodes, edges).count() == 0
    assert S.pagerank(nodes, edges, rounds=2).count() == 0
    assert S.is_dag(nodes, edges).first()[0]


def test_betweenness_against_brute_force(spark):
    n, pairs = 6, [(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (5, 6), (6, 1)]
    nodes, edges = graph(spark, n, pairs)
    out = {i: [b for a, b in pairs if a == i] for i in range(1, n + 1)}

    def counts(s):
        dist, num, q = {s: 0}, {s: 1}, deque([s])
        while q:
            u = q.popleft()
            for v in out[u]:
                if v not in dist:
                    dist[v], num[v] = dist[u] + 1, 0
                    q.append(v)
                if dist[v] == dist[u] + 1:
                    num[v] += num[u]
        return dist, num

    all_ = {s: counts(s) for s in out}
    want = dict.fromkeys(out, 0.0)
    for s, t, v in product(out, out, out):
        if len({s, t, v}) == 3 and t in all_[s][0] and v in all_[s][0] and t in all_[v][0] and all_[s][0][v] + all_[v][0][t] == all_[s][0][t]:
            want[v] += all_[s][1][v] * all_[v][1][t] / all_[s][1][t]
    got = dict(map(tuple, betweenness(nodes, edges).collect()))
    assert all(abs(got[v] - want[v] / 20) < 1e-12 for v in out)


def test_paths_and_cycles_back_to_the_root(spark):
    _, edges = graph(spark, 4, [(1, 2), (2, 3), (3, 1), (1, 3)])
    assert sorted(r["path"] for r in T.call_chains(edges, 1, 3, 4).collect()) == [[1, 2, 3], [1, 3]]
    assert T.call_chains(edges, 1, 1, 4).count() == 0
    assert [r["id"] for r in T.shortest_path(edges, 2, 1).orderBy("step").collect()] == [2, 3, 1]
    assert {r["id"] for r in T.dependencies(edges, 1, 3).collect()} == {1, 2, 3}


@pytest.mark.parametrize(
    "i, o, exported, role",
    [(0, 0, False, "dead"), (0, 3, False, "dead"), (10, 10, True, "entry"), (5, 5, False, "core"), (2, 6, False, "adapter"), (3, 3, False, "utility"), (5, 0, False, "leaf"), (10, 2, False, "leaf"), (0, 0, True, "utility"), (1, 1, False, "utility")],
)
def test_roles(spark, i, o, exported, role):
    assert spark.range(1).select(S.role(F.lit(i), F.lit(o), F.lit(exported))).first()[0] == role


@pytest.mark.parametrize("i, exported, risk", [(10, False, "critical"), (1, True, "high"), (5, False, "high"), (2, False, "medium"), (0, False, "low")])
def test_risk(spark, i, exported, risk):
    assert spark.range(1).select(S.risk(F.lit(i), F.lit(exported))).first()[0] == risk


@pytest.mark.parametrize("query, want", [("", ""), ("  ", ""), ("=.()", ""), ('name = "Foo"', '"name" "foo"'), ("find_call_chain", '"find_call_chain"'), ("AND OR NOT", '"and" "or" "not"'), ("请搜索 user.Login()", '"请搜索" "user" "login"'), ('say "hello"', '"say" "hello"')])
def test_quoted_query(spark, query, want):
    assert spark.range(1).select(X.quoted_query(F.lit(query))).first()[0] == want


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(X.tokens_of_bytes(F.lit(t))) for t in ("", "hello", "func main()")] == [0, 2, 4]
    assert one(X.cyclomatic(F.lit("return 1"), F.lit("go"))) == 1 and one(X.cyclomatic(F.lit("if a && b {"), F.lit("go"))) == 3
    assert one(X.nesting(F.lit("{ { } { { } } }"), F.lit("go"))) == 3
    assert one(X.code_lines(F.lit("a\n\n// b\n/* c\nd */\ne"))) == 2
    assert one(X.folded(F.lit("a/./b/../c"))) == "a/c" and one(X.folded(F.lit("../x"))) == "../x"
    text = "\n".join("line %d of a long text" % i for i in range(100))
    parts = one(X.chunks(F.lit(text), 100))
    assert len(parts) >= 2 and "\n".join(parts) == text
    assert one(X.chunks(F.lit(""), 100)) is None
    assert one(X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0


def test_fusion_adds_ranks(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "id long, score double")
    got = {r["id"]: (round(r["score"], 8), r["source"]) for r in R.fuse({"x": a, "y": a}).collect()}
    assert got[1] == (round(2 / 61, 8), "x+y")


def test_journal(spark):
    def read(*lines):
        rows = spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "pos int, value string")
        return {r["path"]: r["change"] for r in streams.read_journal(rows).collect()}

    assert read(f"{streams.HEADER} 12", "a", "# x", "", "DELETED b", "a", "DELETED ") == {"a": "changed", "b": "deleted", "DELETED": "changed"}
    assert read("wrong 12", "a") == {} and read(f"{streams.HEADER} 0", "a") == {}


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def f(x):\n    return g(x)\n\nclass C:\n    pass\n")
    (tmp_path / "src/a_test.go").write_text("func T() {\n}\n")
    (tmp_path / "readme.txt").write_text("no")
    files = I.source_files(spark, str(tmp_path), ["*_test.go"])
    assert [r["language"] for r in files.collect()] == ["python"]
    assert sorted((r["line"], r["kind"], r["name"]) for r in I.definitions(files).collect()) == [(1, "function", "f"), (4, "class", "C")]
    assert [(r["line"], r["name"]) for r in I.calls(files).collect()] == [(2, "g")]
    log = spark.createDataFrame([("abc\n100\nx.py\ny.py",), ("def\nbad\nx.py",)], "value string")
    assert sorted(r["file"] for r in I.commit_log(log).collect()) == ["x.py", "y.py"]
    path = I.save_snapshot(spark.range(3), str(tmp_path / "snaps"), "one")
    assert path.endswith("version=one") and I.load_snapshot(spark, str(tmp_path / "snaps"), "one").count() == 3
