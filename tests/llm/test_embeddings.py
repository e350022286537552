"""Graphs that lost links, double input, repeated and null ids of the embedding near-dedup."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("spanwood.llm")
from spanwood.llm import embeddings, hnsw  # noqa: E402


def _pairs(n=400, seed=3):
    """n unit vectors far from each other, and for each a neighbour at cosine 0.95."""
    rng = np.random.default_rng(seed)
    unit = rng.normal(size=(n, 48))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    away = rng.normal(size=unit.shape)
    away -= np.einsum("ij,ij->i", away, unit)[:, None] * unit
    away /= np.linalg.norm(away, axis=1)[:, None]
    return np.vstack([unit, 0.95 * unit + np.sqrt(1 - 0.95**2) * away]).astype(np.float32)


def test_a_graph_that_lost_nodes_still_gives_all_links():
    raw = _pairs()
    graph = hnsw.Graph(raw, 0.9)
    nodes = np.flatnonzero(graph.bundle == np.arange(len(raw)))
    lost = nodes[nodes != graph.entry][:40]
    for layer in graph.links:
        layer[np.isin(layer, lost)] = -1
        layer[lost] = -1
    assert graph.audit(embeddings.RECALL) >= embeddings.RECALL and set(lost) <= set(graph.stray)
    unit = raw.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    got = graph.linked(raw, np.ones(len(raw), np.int64), np.arange(len(raw)))
    assert [int(n.sum()) for _, n in got] == (unit @ unit.T >= 0.9).sum(axis=1).tolist()


def test_a_search_too_narrow_widens_its_beam():
    raw = _pairs(1500)
    graph = hnsw.Graph(raw, 0.9)
    graph.links[0][:, 2:] = -1  # a thin graph
    graph.beam = 1
    assert graph.audit(embeddings.RECALL) >= embeddings.RECALL and graph.beam > 1


def test_stored_graphs_answer_alike():
    raw = _pairs(100)
    graph = hnsw.Graph(raw, 0.9)
    graph.audit(embeddings.RECALL)
    ones, own = np.ones(len(raw), np.int64), np.arange(len(raw))
    again = hnsw.Graph.load(graph.dump())
    for (a, n), (b, m) in zip(graph.linked(raw, ones, own), again.linked(raw, ones, own), strict=True):
        assert a.tolist() == b.tolist() and n.tolist() == m.tolist()


def test_doubles_repeats_and_null_ids(spark):
    far = [1e200, 1e199]
    data = [(1, far), (1, far), (None, [2e200, 2e199]), (5, [1.0, -1.0]), (None, None), (7, [0.0, -0.0]), (8, [3.0, 0.3])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"cls": F.lit("x"), "h": F.lit(1), "v": F.lit(2)})
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embeddings.near_duplicates(df).collect()))
    assert got == [(0, 0, 0, True), (0, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (5, 0, 5, True), (7, 0, 7, True), (8, 3, 1, False)]
