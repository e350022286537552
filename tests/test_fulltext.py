"""The full-text index against scans, through changes, and its stems against the published examples."""

import math
import random
import shutil
from pathlib import Path

import pytest

from spanwood.functions import stem as S
from spanwood.operators import fulltext as FT

WORDS = ["run", "running", "runs", "Café", "cafe", "old", "new", "the", "of", "über", "x1", "relational", "y"]


def scan(docs, asked, tokens, limit=None):
    """BM25 over {id: text} by counting every phrase in every text."""
    texts = {i: tokens(t or "") for i, t in docs.items()}
    n, avg = len(texts), sum(map(len, texts.values())) / max(1, len(texts))
    counts = [{i: sum(w[k : k + len(p)] == p for k in range(len(w))) for i, w in texts.items()} for p in asked]
    df = [sum(c > 0 for c in one.values()) for one in counts]
    out = []
    for i, w in texts.items():
        if asked and all(one[i] for one in counts):
            out.append((i, round(sum(max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6) * one[i] * 2.2 / (one[i] + 1.2 * (0.25 + 0.75 * len(w) / avg)) for one, d in zip(counts, df, strict=True)), 8)))
    return sorted(out, key=lambda r: (-r[1], r[0]))[:limit]


def rows(df):
    return sorted(((r.id, r.score) for r in df.collect()), key=lambda r: (-r[1], r[0]))


def same(found, want):
    return [i for i, _ in found] == [i for i, _ in want] and [s for _, s in found] == pytest.approx([s for _, s in want], abs=2e-8)


def test_index_through_changes(spark, tmp_path, monkeypatch):
    tokens = S.stems
    monkeypatch.setattr(FT, "RANGE", 8)
    monkeypatch.setattr(FT, "FIRST", 2)
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 14)))
    docs = {i: text() for i in rng.sample(range(-40, 400), 150)} | {7: None, 8: ""}
    index = FT.Index(spark, str(tmp_path / "index"), tokens)

    def put(changed, removed=()):
        extra = [(None, "the of")] if changed else []
        return index.upsert(spark.createDataFrame([*changed.items(), *extra], "id long, text string"), spark.createDataFrame([(i,) for i in removed], "id long"))

    def check(held, *queries):
        for query in queries:
            want = scan(docs, held.phrases(query), tokens)
            assert same(rows(held.search(query)), want), query
            assert same(rows(held.search(query, 5)), want[:5]), query

    put(docs)
    check(index, "the", '"of the"', "running café", "", "!?", "absent the")
    for _ in range(2):
        changed = {i: text() for i in [*rng.sample(sorted(docs), 25), 1000 + rng.randint(0, 50)]}
        removed = rng.sample(sorted(set(docs) - set(changed)), 15)
        docs = {i: t for i, t in (docs | changed).items() if i not in removed}
        put(changed, removed)
        put(changed, removed)  # the same change again
    check(index, 'the "old new" of', '"the the"', '"of absent"')
    # a version that did not come to its end counts for nothing and is written over
    last = tmp_path / "index" / f"v{max(index.versions()) + 1:06}"
    shutil.copytree(tmp_path / "index" / "v000000", last)
    shutil.rmtree(last / "gone")
    put({5: "the old new of the"})
    docs[5] = "the old new of the"
    check(index, '"old new"')
    check(index.compact(str(tmp_path / "small")), 'the "old new"')
    # of rows of one id one counts
    index.upsert(spark.createDataFrame([(6, "the"), (6, "the")], "id long, text string"))
    docs[6] = "the"
    check(index, "the")


def test_empty_index(spark, tmp_path):
    index = FT.Index(spark, str(tmp_path / "none"))
    assert index.versions() == [] and index.search("word").collect() == []
    index.upsert(spark.createDataFrame([], "id long, text string"))
    assert index.versions() == [0] and index.search("word", 3).collect() == []


def test_reads_only_lists_of_the_words(spark, tmp_path):
    """The filter on terms reaches the files, which are sorted by term."""
    index = FT.Index(spark, str(tmp_path / "index"), S.plain)
    index.upsert(spark.range(3000).selectExpr("id", "concat('w', id, ' w', id % 50, ' the') text"))
    plan = index._postings(["the"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(term" in plan or "EqualTo(term" in plan
    terms = [r.term for r in spark.read.parquet(str(next(Path(tmp_path / "index" / "v000000" / "postings").glob("*.parquet")))).select("term").collect()]
    assert terms == sorted(terms) and index.search("the w7").count() == 60


#: The examples of the paper, step by step.
STEMS = """caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat
troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit
rational:ration valenci:valenc hesitanci:hesit digitizer:digit conformabli:conform radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam
predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl
triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer
airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog
communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll
generalizations:gener oscillators:oscil as:as y:y"""


def test_stems():
    for pair in STEMS.split():
        word, want = pair.split(":")
        assert S.stem(word) == want, word
    assert S.stems("Les Élèves—RUNNING über_all x1 数据 123") == ["le", "elev", "run", "uber", "all", "x1", "数据", "123"]


def _changed(spark, path):
    index = FT.Index(spark, path, S.plain)
    index.upsert(spark.range(3000).selectExpr("id - 700 AS id", "concat('old of the ', id % 7, ' of the') text"))
    index.upsert(spark.range(500).selectExpr("id * 3 AS id", "'the new of' text"), spark.range(-700, -600))
    return index, {i: f"old of the {(i + 700) % 7} of the" for i in range(-600, 2300)} | {i * 3: "the new of" for i in range(500)}


def test_searches_make_no_row_of_a_position(spark, tmp_path, monkeypatch):
    """Phrases over several versions used to be rows of all positions of their words, shuffled by document."""
    index, docs = _changed(spark, str(tmp_path / "index"))
    plans, cut = [], FT.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(FT, "cut", seen)
    assert same(rows(index.search('"of the" old')), scan(docs, [["of", "the"], ["old"]], S.plain))
    assert plans and not [p for p in plans if "explode" in p]


def test_lists_are_written_once(spark, tmp_path, monkeypatch):
    """Changes and compaction used to write all lists a first time, to count them; compaction to shuffle them twice, entry by entry."""

    def never(df):
        raise AssertionError("lists written twice")

    monkeypatch.setattr(FT, "cut", never)
    index, docs = _changed(spark, str(tmp_path / "index"))
    small = index.compact(str(tmp_path / "small"))
    monkeypatch.undo()
    assert small.versions() == [0] and same(rows(small.search('"of the" 3')), scan(docs, [["of", "the"], ["3"]], S.plain))
    lists = small._postings().filter("most is not null")
    assert lists.groupBy("term", "range").count().filter("count > 1").isEmpty()
    assert lists.filter("term = 'of'").selectExpr("sum(n) n", "max(most) most", "min(shortest) shortest").first() == (2900, 2, 3)
