"""The maintained graph equals one built at once, however its changes are split, repeated or broken off."""

import random

import pytest

from spanwood.streaming import graph_state as G

NAMES = ["a", "b", "c", "d"]
DIRS = ["x", "x/y", "z"]


def content(file, g):
    """Symbols and references of a file at a generation."""
    rng = random.Random(f"{file}{g}")
    base = FILES.index(file) * 10
    return [(file, base + k, rng.choice(NAMES), rng.random() < 0.5) for k in range(rng.randint(0, 4))], [(file, base + rng.randint(0, 3), rng.choice(NAMES), "calls") for _ in range(rng.randint(0, 5))]


FILES = [f"{d}/f{k}.go" for d in DIRS for k in range(5)]


def parser(spark):
    def parse(files):
        found = [content(r.file, r.tie) for r in files.collect()]
        return spark.createDataFrame([s for f in found for s in f[0]], G.SYMBOLS), spark.createDataFrame([r for f in found for r in f[1]], G.REFERENCES)

    return parse


def plain(state):
    """Edges of {file: generation} by loops."""
    symbols = [s for f, g in state.items() for s in content(f, g)[0]]
    folder = lambda f: f.rpartition("/")[0]
    out = set()
    for f, g in state.items():
        for _, source, name, kind in content(f, g)[1]:
            same = [s for s in symbols if s[2] == name]
            tiers = [[s[1] for s in same if s[0] == f], [s[1] for s in same if folder(s[0]) == folder(f)], [s[1] for s in same if s[3]]]
            pick = next((min(t) for t in tiers if t), None)
            if pick is not None:
                out.add((f, source, pick, kind))
    return out


def frame(spark, rows):
    from datetime import datetime, timedelta

    return spark.createDataFrame([(f, datetime(2020, 1, 1) + timedelta(seconds=t), t, p) for f, t, p in rows], G.FILES)


def edges(graph):
    return {tuple(r) for r in graph.edges().select("file", "source_id", "target_id", "kind").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [(f, 0, True) for f in FILES if rng.random() < 0.8] + [(rng.choice(FILES), t, rng.random() < 0.75) for t in range(1, 25)]
    state = {}
    for f, t, there in events:
        state[f] = t if there else None
    want = plain({f: t for f, t in state.items() if t is not None})
    graph = G.GraphState(spark, str(tmp_path / "g"), parser(spark))
    first = [e for e in events if e[1] == 0]
    rest = [e for e in events if e[1]]
    rng.shuffle(rest)  # batches come late and out of order
    cuts = sorted(rng.sample(range(1, len(rest)), 3))
    batches = [first, *[rest[a:b] for a, b in zip([0, *cuts], [*cuts, len(rest)], strict=True)]]
    pushed = {}
    for k, batch in enumerate(batches):
        version = graph.apply(frame(spark, [*batch, (None, 99, True)] if k == 1 else batch))
        if version is not None:
            for r in graph.delta(version).collect():
                pushed[tuple(r)[1:]] = pushed.get(tuple(r)[1:], 0) + (1 if r.change == "added" else -1)
        if k == 2:
            assert graph.apply(frame(spark, batch)) is None  # again
    assert edges(graph) == want
    assert {e for e, n in pushed.items() if n} == {(s, t, k) for _, s, t, k in want} and set(pushed.values()) <= {0, 1}
    # all at once, and rebuilt in place
    whole = G.GraphState(spark, str(tmp_path / "w"), parser(spark))
    whole.apply(frame(spark, events))
    assert edges(whole) == want
    graph.apply(frame(spark, []), full=True)
    assert edges(graph) == want and len(graph.versions()) == 1


def test_broken_batch(spark, tmp_path):
    graph = G.GraphState(spark, str(tmp_path / "g"), parser(spark))
    graph.apply(frame(spark, [(f, 1, True) for f in FILES]))
    fails = G.GraphState(spark, graph.path, lambda files: 1 / 0)
    change = frame(spark, [(FILES[0], 5, True), (FILES[3], 6, False)])
    with pytest.raises(ZeroDivisionError):
        fails.apply(change)
    assert (tmp_path / "g" / "in_progress").exists() and edges(graph) == plain({f: 1 for f in FILES})
    version = graph.apply(change)
    assert not (tmp_path / "g" / "in_progress").exists() and graph.versions() == [version]  # built anew, on its own
    assert edges(graph) == plain({f: 5 if f == FILES[0] else 1 for f in FILES if f != FILES[3]})


def test_writes_only_what_a_change_moves(spark, tmp_path):
    def parse(files):
        at = {r.file: r.tie for r in files.collect()}
        rows = [("p/a.go", 1, "one", True), ("q/b.go", 2, "two", True), ("q/c.go", 3, "three" if at.get("q/c.go", 0) < 2 else "two", True), ("r/d.go", 4, "four", True)]
        refs = [("p/a.go", 1, "two", "calls"), ("q/b.go", 2, "one", "calls"), ("r/d.go", 4, "three", "calls")]
        return spark.createDataFrame([r for r in rows if r[0] in at], G.SYMBOLS), spark.createDataFrame([r for r in refs if r[0] in at], G.REFERENCES)

    graph = G.GraphState(spark, str(tmp_path / "g"), parse)
    graph.apply(frame(spark, [(f, 1, True) for f in ("p/a.go", "q/b.go", "q/c.go", "r/d.go")]))
    version = graph.apply(frame(spark, [("q/c.go", 2, True)]))
    # three is gone, which d refers to; two has another candidate of a larger id, which changes nothing for a
    wrote = {r.file for r in spark.read.parquet(f"{graph.path}/v{version:06}/wrote").collect()}
    assert wrote == {"q/c.go", "r/d.go"}
    assert edges(graph) == {("p/a.go", 1, 2, "calls"), ("q/b.go", 2, 1, "calls")}


def test_empty(spark, tmp_path):
    graph = G.GraphState(spark, str(tmp_path / "g"), parser(spark))
    graph.apply(frame(spark, []))
    assert edges(graph) == set()
