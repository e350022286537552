"""Pipeline stages on odd tables, and plain versions of line templates, best fit and content-defined cuts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("spanwood.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from spanwood.llm import chunking, lines, minhash, packing  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "at 10:45 the server took 12 ms to answer the client in the second room of the house"
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, LINE), (5, LINE), (5, LINE), (6, LINE.replace("12", "99")), (None, LINE), (None, None), (7, "word " * 30_000), (8, "db_pwd = 'zX81pQ77mmLw02'"), (9, "é 世界 🎉")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in ROWS], SCHEMA)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd, name):
    stage = dict(pipeline.STAGES)[name]
    wide = odd.withColumns({c: F.lit("x") for c in ("key", "pos", "id", "cls", "score", "n_lines", "rank", "length")})
    plain, clash = stage(spark, odd, SF), stage(spark, wide, SF)
    free = [c for c in plain.columns if c not in ("sequence_id", "offset")]
    rows = sorted(map(repr, plain.select(free).collect()))
    assert sorted(map(repr, clash.select(free).collect())) == rows and stage(spark, odd.limit(0), SF).count() == 0
    ids = [r["doc_id"] for r in plain.select("doc_id").collect()]
    if name == "toxicity":
        assert plain.columns == odd.columns and len(ids) == len(ROWS)
    elif name == "line_dedup":  # null ids are one document before all others, so theirs is the line that stays
        assert sorted(i for i in ids if i) == [1, 2, 3, 6, 7, 8, 9] and ids.count(None) == 2  # two lines that differ make no template
    elif name == "minhash":
        assert sorted(i for i in ids if i) == [1, 2, 3, 4, 6, 7, 8, 9] and ids.count(None) == 1
    elif name == "secrets":
        assert len(ids) == len(ROWS) and plain.filter("text LIKE '%zX81%'").count() == 0
    else:
        assert len({r["doc_id"] for r in plain.collect()}) == 10 and plain.agg(F.sum("length")).first()[0] >= len(ROWS)


def _plain_keys(line):
    t = ["0" if any("0" <= c <= "9" for c in x) else x for x in line.split(" ") if x]
    n = len(t)
    if n < 8:
        literals = sum(x != "0" for x in t)
        return {(-1, tuple(t))} if literals < n and literals >= 2 and 2 * literals >= n else set()
    width, out = n * 3 // 10, set()
    for k in range(math.ceil((n - 1) / width)):
        left = t[: 1 + k * width] + t[1 + (k + 1) * width :]
        literals = sum(x != "0" for x in left)
        if literals >= 2 and 2 * literals >= n:
            out.add((k, n, tuple(left)))
    return out


def _plain_dedup(docs):
    """What dedup_lines leaves of [(id, text)]."""
    first, made = {}, {}
    for doc, text in docs:
        for line in text.split("\n"):
            own = tuple(line.split())
            first[own] = min(doc, first.get(own, doc))
    for doc, text in docs:
        for line in text.split("\n"):
            for key in _plain_keys(line):
                made.setdefault(key, {})[tuple(line.split())] = first[tuple(line.split())]
    least = {key: min(of.values()) for key, of in made.items() if len(of) >= 3 and len(set(of.values())) > 1}
    keep = lambda doc, line: not line.strip() or (first[tuple(line.split())] == doc and all(least.get(k, doc) == doc for k in _plain_keys(line)))
    return {doc: "\n".join(line for line in text.split("\n") if keep(doc, line)) for doc, text in docs}


def test_line_templates_against_plain_ones(spark):
    docs = [
        (1, "User alice logged in here\nshort\nthe a b c d e f g h i j k l"), (2, "User bob logged in here\nshort\nthe a b c X Y f g h i j k l"), (3, "User alice logged out there\nshort one\nthe a b c X Y f g h P Q k l"),
        (4, "id a3f9 was seen\n\n  "), (5, "id bc12 was seen\n\n  "), (6, "Nothing else"), (7, "id 77 was seen"), (8, "the a b c Z W f g h i j k l\nid 78 was  seen"), (9, "id 77 was seen"),
    ]
    want = _plain_dedup(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()} == want
    assert want[5] == "\n  " and "alice" in want[3] and "bob" in want[2] and want[8] == "" and want[7] == want[9] == "" and "\n" not in want[2]
    assert sorted(r["doc_id"] for r in lines.dedup_lines(df, emptied=False).collect()) == [1, 2, 3, 4, 6]


def test_lines_that_must_stay(spark):
    """Numbers make no template, nor do sentences that happen to differ in a word."""
    docs = [(1, "12 34\n1999\nThe cat sat down"), (2, "7 99\n2024\nThe cat sat up"), (3, "The cat sat still\n5 6"), (4, "8 9\n1 2 3 4 5 6 7 8 9 10"), (5, "3 1 4 1 5 9 2 6 5 3\n2 7 1 8 2 8 1 8 2 8"), (6, "On Monday the old man walked home along the river"), (7, "On Friday the old man walked home along the river")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()} == dict(docs)


def test_planted_lines_go_and_prose_stays(spark):
    """Boilerplate with variable fields among prose of its own: nearly all that recurs goes, no line of prose does."""
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    stamp = ["Posted on {d} at {t} by {w} in the general section of this board", "Page {d} of {t}", "Copyright {d} by the owners of this site and all who wrote for it", "You are reading article number {d} of our long series about the {w} of the week"]
    docs, planted = [], {}
    for k in range(300):
        own = [prose(int(rng.integers(3, 40))) for _ in range(5)]
        marks = [s.format(d=int(rng.integers(10, 10**6)), t=int(rng.integers(10, 10**6)), w=vocabulary[int(rng.integers(0, 3000))]) for s in stamp]
        planted[k] = marks
        docs.append((k, "\n".join([marks[0], *own[:3], *marks[1:], *own[3:]])))
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    left = [line for k, text in got.items() if k for line in text.split("\n")]
    marks = {m for k, ms in planted.items() if k for m in ms}
    unique = [line for k, text in docs if k for line in text.split("\n") if line not in marks]
    assert sum(line in marks for line in left) <= 0.01 * len(marks) and sum(line not in marks for line in left) == len(unique)


def test_columns_of_any_name(spark):
    """Columns that are called what an operator calls its own come back as they were."""
    names = ["__hash", "__turn", "__own", "__id", "__kept", "__doc", "__drop", "__n_lines", "__n_dropped", "__HASH2"]
    rows = [(1, LINE), (2, LINE.replace("12", "13")), (3, "a b c d e f g h"), (4, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    wide = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for run in (lambda d: lines.dedup_lines(d, emptied=False), lambda d: minhash.keep_one(d, threshold=(80, 100))):
        got = run(wide)
        assert got.columns == wide.columns and sorted(map(tuple, got.select("doc_id", "text").collect()), key=repr) == sorted(map(tuple, run(plain).collect()), key=repr)
        assert all(r[c] == f"{c}{r['doc_id']}" for r in got.collect() for c in names)


@pytest.mark.parametrize("seed", range(5))
def test_plan_packs_like_best_fit_item_by_item(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice([3, 10, 11, 24, 25, 40, 50, 64, 77, 99, 100], 400).tolist()
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            best = min(fits)
            bins[bins.index(best)] = best - n
        else:
            bins.append(100 - n)
    counts = {n: lengths.count(n) for n in set(lengths)}
    rows, used = packing.plan(counts, 100)
    assert used <= math.ceil(len(bins) * 1.02) and sum(hi - lo for _, lo, hi, *_ in rows) == 400


def _plain_cuts(data):
    """Byte by byte: from the least size on, a strict border up to the aim, else a loose one up to the greatest size."""
    gear, out, at = [int(x) for x in chunking._GEAR], [], 0

    def hash_at(i):
        return sum(gear[data[j]] << (2 * (i - j)) for j in range(max(0, i - chunking.WINDOW + 1), i + 1)) & 0xFFFFFFFF

    while at < len(data):
        end = len(data)
        for stop in range(at + chunking.LEAST, min(at + chunking.MOST, len(data)) + 1):
            bits = chunking.BITS_BEFORE if stop <= at + chunking.AIM else chunking.BITS_AFTER
            if hash_at(stop - 1) >> (32 - bits) == 0 or stop == at + chunking.MOST:
                end = stop
                break
        out.append(end)
        at = end
    return out


def test_cuts_byte_by_byte():
    rng = np.random.default_rng(9)
    for n in (0, 1, 11, 12, 13, 40, 300, 3000):
        for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), bytes(n), (b"the quick brown fox " * 200)[:n]):
            assert chunking.cuts(data) == _plain_cuts(data), (n, data[:20])
