"""Steps whose cost must grow no faster than their input."""

import time

from pyspark.sql import functions as F

from spanwood.sources import files as I


def test_definitions_of_one_long_file(spark):
    """A file of many definitions takes one pass, and so do the calls in them."""
    n = 12_000
    lines = F.expr("concat('class C', id, ':\\n    def m', id, '(self):\\n        return f', id, '(x)\\n\\ndef f', id, '(a):\\n    return g(a)')")
    texts = spark.range(n).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", lines.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    files = texts.select(F.lit("src/a.py").alias("path"), F.lit("python").alias("language"), "text")
    t = time.time()
    rows = I.definitions(files)
    assert rows.count() == 3 * n
    assert rows.filter("kind = 'function' and name like 'm%' and parent = replace(name, 'm', 'C') and end_line = line + 2").count() == n
    edges = I.code_edges(files)
    assert edges.filter("kind = 'calls' and source = replace(target, ':f', ':m')").count() == n
    assert time.time() - t < 60


def test_calls_on_lines_of_definitions(spark):
    """A call on a definition's own line belongs to what holds that definition; parents look past other definitions."""
    text = "class A {\n  public class B extends K(f(1)) {\n    int g(x) {\n      h(y);\n    }\n}\npublic class D {\n}"
    files = spark.createDataFrame([("a.java", "java", text), ("b.py", "python", "class A:\n    x = 1\ndef f():\n    def g():\n        A()\n    g()\nA()")], "path string, language string, text string")
    got = sorted((r["file"], r["line"], r["end_line"], r["name"], r["parent"]) for r in I.definitions(files).collect())
    assert got == [("a.java", 1, 6, "A", None), ("a.java", 2, 6, "B", "A"), ("a.java", 7, 8, "D", None), ("b.py", 1, 2, "A", None), ("b.py", 3, 7, "f", None), ("b.py", 4, 7, "g", "A")]
    calls = sorted((r["source"], r["target"]) for r in I.code_edges(files).filter("kind = 'calls'").collect())
    # by all pairs of calls and definitions around them, the last to start
    places = [(r["file"], r["line"], r["name"]) for r in I.calls(files).collect()]
    ids = {(f, n): f"{f}:{n}" for f, _, _, n, _ in got}
    want = set()
    for f, line, name in places:
        around = [d for d in got if d[0] == f and d[1] < line <= d[2]]
        target = ids.get((f, name)) or min((i for (_, n), i in ids.items() if n == name), default=None)
        if around and target:
            want.add((ids[f, max(around, key=lambda d: d[1])[3]], target))
    assert calls == sorted(want)


def test_tasks_grow_with_rows(spark, monkeypatch):
    """Rows of commits and syntax trees are dealt over more tasks than the session's, where there are many."""
    from spanwood import views as V
    from spanwood.operators import steps

    monkeypatch.setattr(steps, "TASK_ROWS", 500)
    sf = "/root/testdata/sf0.001"
    want = -(-V.table(spark, sf, "lineitem").count() // 500)
    assert want > 4
    from spanwood.operators import mining

    pairs = mining.cochange(V.commits(spark, sf), least=1)._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(file_a" in line and "REPARTITION_BY_NUM" in line for line in pairs.split("\n"))
    assert V.commits(spark, sf).rdd.getNumPartitions() == V.ast(spark, sf).rdd.getNumPartitions() == want


def test_parsed_files_leave_in_pieces(monkeypatch):
    """A batch of files does not wait for its last one."""
    import pyarrow as pa

    from spanwood.sources import extract as E

    monkeypatch.setattr(E, "PIECE", 100)
    text = "def f():\n    return g()\n" * 3
    batch = pa.RecordBatch.from_arrays([pa.array([f"a{k}.py" for k in range(9)]), pa.array(["python"] * 9), pa.array([text] * 8 + [None])], ["path", "language", "text"])
    made = list(E._parsed(iter([batch])))
    assert len(made) == 5 and sum(b.num_rows for b in made) == 9


def test_hashed_embedding_hashes_words_once(spark):
    """Long texts: each of the 16 counts used to hash and split all words again."""
    from spanwood.operators import search as R

    df = spark.range(1).select(F.lit("").alias("none"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda k: F.concat(F.lit("w"), k)), " ").alias("text"))
    t = time.time()
    row = df.select(R.hashed_embedding(F.col("text")).alias("v"), R.hashed_embedding(F.col("none")).alias("z")).first()
    assert abs(sum(row["v"]) - 1) < 1e-9 and row["z"] == [0.0] * 16
    assert time.time() - t < 30


def test_rounds_of_components_and_communities_broadcast_nothing(spark, monkeypatch):
    """Tables of a round stay off the driver, however small Spark takes them to be."""
    from spanwood.operators import steps
    from spanwood.operators import structure as S

    plans, cut = [], steps.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    for module in (steps, S):
        monkeypatch.setattr(module, "cut", seen)
    nodes = spark.range(8)
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 6)], "source_id long, target_id long")
    assert {r["component"]: r["size"] for r in S.cycles(nodes, edges).collect()} == {0: 3, 3: 2}
    assert len({r["community"] for r in S.louvain(nodes, edges, levels=1, rounds=2).collect()}) < 8
    # plans that read no earlier round join the caller's own tables
    rounds = [p for p in plans if "/rounds/" in p]
    assert len(rounds) > 10 and not [p for p in rounds if "Broadcast" in p]


def _chains(spark, chains, length):
    """Disjoint chains of nodes, and a node of its own."""
    nodes = spark.range(chains * length + 1)
    return nodes, spark.range(chains * length).filter(f"id % {length} < {length - 1}").selectExpr("id AS source_id", "id + 1 AS target_id", "'calls' AS kind")


def test_all_pairs_take_no_round_of_jobs_for_each_level(spark):
    """Distances and betweenness took jobs for every level; components are walked in tasks."""
    from spanwood.operators import traverse as T
    from spanwood.operators.betweenness import betweenness

    nodes, edges = _chains(spark, 3, 300)
    t = time.time()
    assert dict(map(tuple, T.path_counts(nodes, edges).collect())) == {k: 3 * (300 - k) for k in range(1, 300)}
    got = {r["id"]: r["betweenness"] for r in betweenness(nodes, edges).collect()}
    assert all(abs(got[i] * 900 * 899 - (i % 300) * (299 - i % 300)) < 1e-6 for i in range(900)) and got[900] == 0
    assert time.time() - t < 100


def test_lots_and_rounds_agree(spark, monkeypatch):
    """The same pairs and ranks whether components share lots, have one each or go by rounds; blocks of few sources."""
    import random

    from spanwood.operators import lots as L
    from spanwood.operators import traverse as T
    from spanwood.operators.betweenness import betweenness

    rng = random.Random(4)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(100 + rng.randrange(9), 100 + rng.randrange(9)) for _ in range(14)] + [(200, 201), (201, 200), (300, 5), (301, 301)]
    edges = spark.createDataFrame([(a, b, "c") for a, b in pairs], "source_id long, target_id long, kind string")
    nodes = spark.createDataFrame([(i,) for i in [*range(30), *range(100, 109), 200, 201, 301]], "id long")
    found = []
    for large, small, block in ((1_000_000, 20_000, 1024), (1_000_000, 5, 3), (20, 5, 3)):
        for name, value in (("LOT_EDGES", large), ("SMALL", small), ("BLOCK", block)):
            monkeypatch.setattr(L, name, value)
        found.append((sorted(map(tuple, T.path_counts(nodes, edges).collect())), sorted((r["id"], round(r["betweenness"], 12)) for r in betweenness(nodes, edges).collect())))
    assert found[0] == found[1] == found[2] and len(found[0][0]) > 3


def test_queries_share_one_pass_over_texts(spark):
    """Each query used to split all texts twice."""
    from spanwood.operators import search as R

    passes = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(1, "the cat was the first"), (2, "was and with"), (3, None), (4, "The with and, and was")], "id long, text string").mapInArrow(read, "id long, text string")
    queries = ["was the", "and with", "", "The was"]
    together = [list(map(tuple, hits.collect())) for hits in R.bm25_of_each(docs, queries, 2)]
    assert passes.value == 4
    assert together[2] == [] and together[0] == together[3] and {i for i, _ in together[0]} == {1, 4} and {i for i, _ in together[1]} == {2, 4}
    assert together == [list(map(tuple, R.bm25(docs, q, 2).collect())) for q in queries]
    assert passes.value == 4 + 3 * 4


def test_ranks_move_in_blocks(spark, monkeypatch):
    """A round used to shuffle all ways; now it hands on a number for each node and block that it leads to."""
    import random

    from spanwood.operators import ranks as K

    monkeypatch.setattr(K, "NODES", 7)
    rows, cut = [], K.cut

    def seen(df):
        out = cut(df)
        if out.columns == ["to", "at", "values"]:
            rows.append(out.filter("to >= 0 and values is not null").selectExpr("coalesce(sum(size(values)), 0)").first()[0])
        return out

    monkeypatch.setattr(K, "cut", seen)
    rng, n = random.Random(3), 30
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(40)] + [(3, 4)] * 500 + [(5, 77), (78, 5)]
    nodes, edges = spark.createDataFrame([(i * 1000 - 5000,) for i in range(n)] + [(None,)], "id long"), spark.createDataFrame([(a * 1000 - 5000, b * 1000 - 5000) for a, b in pairs], "source_id long, target_id long")
    got = {r["id"]: r["rank"] for r in K.pagerank(nodes, edges, rounds=8).collect()}
    want, ways = [1 / n] * n, [(a, b) for a, b in pairs if a < n and b < n]
    outs = [sum(a == i for a, _ in ways) for i in range(n)]
    for _ in range(8):
        loose = sum(r for r, o in zip(want, outs) if not o)
        new = [0.15 / n + 0.85 * loose / n] * n
        for a, b in ways:
            new[b] += 0.85 * want[a] / outs[a]
        want = new
    assert len(got) == n and all(abs(got[i * 1000 - 5000] - want[i]) < 1e-12 for i in range(n))
    assert max(rows) <= 41


def test_a_lot_goes_once_to_each_part(spark, monkeypatch):
    """A component's arrays used to go out once for each block of its sources; and bitmaps of any width give the same pairs."""
    import numpy as np
    import pyarrow as pa

    from spanwood.operators import lots as L
    from spanwood.operators import traverse as T

    nodes, edges = _chains(spark, 2, 200)
    monkeypatch.setattr(L, "BLOCK", 8)
    packed, _ = L.lots(edges.selectExpr("source_id AS src", "target_id AS dst", "1.0D AS w", "true AS known"))
    rows = L.each_block(packed, ["dst"], lambda blocks, dst: pa.table([[sum(map(np.size, blocks))]], ["n"]), "n long").collect()
    assert sum(r["n"] for r in rows) == 2 * 199 and len(rows) <= 2
    # as many parts as the work asks for, and walks of few sources where a component has many nodes
    monkeypatch.setattr(L, "LEAST_WORK", 1)
    monkeypatch.setattr(L, "BLOCK", 100)
    monkeypatch.setattr(L, "WORDS", 1)
    assert dict(map(tuple, T.path_counts(nodes, edges).collect())) == {k: 2 * (200 - k) for k in range(1, 200)}


def test_sources_of_a_block_lead_to_the_same_hub():
    """Sources in order of their ids met a node at many distances, which made a row of bits for each."""
    import numpy as np

    from spanwood.operators import lots as L

    rng = np.random.default_rng(2)
    n = 4000
    src, dst = rng.integers(0, n, (2, 5600))
    order = L._near(src, dst, n)
    assert sorted(order) == list(range(n))
    by_src = np.argsort(src, kind="stable")
    want = np.zeros(n, int)
    for name, sources in (("ids", np.arange(n)), ("near", order)):
        blocks = [sources[k : k + 128] for k in range(0, n, 128)]
        got = dict(zip(*(c.to_pylist() for c in L.pairs_by_distance(blocks, src[by_src], dst[by_src]).columns)))
        want = want if name == "near" else got
        assert got == want
    fronts = lambda sources: sum(sum(1 for _ in L._levels(sources[k : k + 128], L._starts(src, n), dst[by_src])) for k in range(0, n, 128))
    assert fronts(order) < fronts(np.arange(n))


def test_dependencies_of_what_a_block_reaches():
    """Each source used to take arrays of a whole component, and to walk all trees that hang from what it reaches."""
    import random

    import numpy as np

    from spanwood.operators import lots as L

    rng, n = random.Random(8), 90
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(110)} | {(0, 90), (90, 91), (91, 92), (90, 93)})
    pairs = [(a, b) for a, b in pairs if a != b]
    src, dst, w = (np.array(v) for v in ([a for a, _ in pairs], [b for _, b in pairs], [1.0 + (a + b) % 2 for a, b in pairs]))
    want = np.zeros(94)
    for s in range(94):
        order, depth, paths, dep = [s], {s: 0}, {s: 1.0}, np.zeros(94)
        for v in order:
            for a, b, k in zip(src, dst, w):
                if a == v:
                    if b not in depth:
                        depth[b], paths[b] = depth[v] + 1, 0.0
                        order.append(b)
                    if depth[b] == depth[v] + 1:
                        paths[b] += paths[v] * k
        for v in reversed(order):
            for a, b, k in zip(src, dst, w):
                if a == v and depth[b] == depth[v] + 1:
                    dep[v] += paths[v] * k / paths[b] * (1 + dep[b])
        want += np.where(np.arange(94) == s, 0, dep)
    sources = np.unique(src)
    found = L.dependencies([sources[:40], sources[40:]], np.arange(94), src, dst, w)
    got = np.zeros(94)
    got[found["node"].to_numpy()] = found["dep"].to_numpy()
    assert np.allclose(got, want, rtol=1e-12)
    # walks of few steps in a component of many nodes
    t, many = time.time(), np.arange(4096)
    found = L.dependencies([many[:2048], many[2048:]], np.arange(1_000_000), np.repeat(many, 2), np.repeat(many, 2) * 100 + 500_000 + np.tile([0, 1], 4096), np.ones(8192))
    assert found.num_rows == 0 and time.time() - t < 10
