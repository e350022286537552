"""Line diffs against a dynamic program, on whole tables and on long texts."""

import random
import time

import pytest

from spanwood.functions import diff as D
from spanwood.operators import service as P


def longest(a, b):
    """The most lines that can stay, by a dynamic program."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("letters", [1, 2, 4, 9])
def test_shortest_scripts(letters):
    rng = random.Random(letters)
    for _ in range(800):
        a, b = ([rng.choice("abcdefghi"[:letters]) for _ in range(rng.randint(0, 16))] for _ in range(2))
        kept = D.matches(a, b)
        assert len(kept) == longest(a, b), (a, b)
        assert all(a[i] == b[j] for i, j in kept) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(kept, kept[1:], strict=False))


def test_shown():
    assert D.line_diff("a\nb\nc", "a\nx\nc\nd") == (2, 2, 1, "-b\n+x\n+d")
    assert D.line_diff("", "") == (1, 0, 0, "") and D.line_diff("a", "") == (0, 1, 1, "-a\n+")


def test_long_texts():
    rng = random.Random(2)
    a = [str(rng.randint(0, 1000)) for _ in range(200_000)]
    b = [f"new {k}" if rng.random() < 0.0003 else x for k, x in enumerate(a) if rng.random() > 0.0003]
    began = time.time()
    kept = D.matches(a, b)
    assert time.time() - began < 20 and len(kept) >= sum(not x.startswith("new") for x in b)


def test_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    from spanwood.plans import QUERIES

    got = {r.doc_id: r for r in QUERIES["fn26_document_diff"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {i for i in docs if i + 1 in docs}
    for i, r in got.items():
        a, b = docs[i].split("\n"), docs[i + 1].split("\n")
        assert r.equal == longest(a, b) and (r.insert, r.delete) == (len(b) - r.equal, len(a) - r.equal)


def test_nulls(spark):
    rows = spark.createDataFrame([(1, None, "a\nb"), (2, "a", None), (3, None, None)], "id int, x string, y string")
    got = {r.id: tuple(r.d) for r in rows.select("id", P.line_diff(rows.x, rows.y).alias("d")).collect()}
    assert got == {1: (0, 2, 1, "-\n+a\n+b"), 2: (0, 1, 1, "-a\n+"), 3: (1, 0, 0, "")}
