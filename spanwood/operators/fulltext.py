"""A persisted full-text index with positions: phrases, AND, BM25, upserts and deletes, top-k by upper bounds.

An index is a folder of versions. Each holds the posting lists of the documents that came with it and the ids that it
replaced or removed, so a change costs its own size and no list is rewritten; `compact` folds versions into one. A term's
list is cut where ids leave a range of RANGE, so the ranges of all terms align: no list is long, however common its term,
and a range's best score is bounded by what its rows say of their highest counts and shortest documents.

A task writes the lists of its ranges sorted by term, as they leave it, so that a filter on terms reads few pages and no text
is read again. Documents stand in lists by their place in the range; lengths are kept once, in a list of the empty term
without `most`. Searches and compaction bring what they need of a range together in one task.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stem as S
from .steps import cut

Tokens = Callable[[str], list[str]]

#: Ids of one range, and ranges that a first round visits.
RANGE, FIRST = 1024, 16
#: Documents that a task should read, and lists that it hands on at once.
TASK_DOCS, PIECE = 10_000, 5_000


class Index:
    """The index in a folder; `tokens` must be the function that it was built with."""

    def __init__(self, spark: SparkSession, path: str, tokens: Tokens = S.stems):
        self.spark, self.path, self.tokens = spark, path.rstrip("/"), tokens

    # versions

    def versions(self) -> list[int]:
        """Versions that were written to the end, in order. `gone` is written last, so a version without it does not count."""
        fs, path = self._fs()
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = sorted(int(n[1:]) for n in found if n[1:].isdigit() and fs.exists(self._hadoop(f"{self.path}/{n}/gone/_SUCCESS")))
        return done

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        path = self._hadoop(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _read(self, part: str, schema: str) -> DataFrame:
        """(version, ...) of a part in all versions."""
        out = self.spark.createDataFrame([], f"version int, {schema}")
        for v in self.versions():
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/v{v:06}/{part}").withColumn("version", F.lit(v)))
        return out

    # writing

    def upsert(self, docs: DataFrame, removed: DataFrame | None = None) -> int:
        """Add docs(id, text), or replace those of equal ids, and remove the ids of removed(id); the new version's number.

        Null texts are empty ones and stay documents. Of rows of one id the one whose text hashes lowest counts; null ids
        are left out. An id that is in both tables is there afterwards. A version that did not come to its end, for a lost
        driver, say, is written over; running the same change again changes nothing.
        """
        known = self.versions()
        version = known[-1] + 1 if known else 0
        at = f"{self.path}/v{version:06}"
        rows = docs.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).filter("id is not null")
        # a range's documents meet in one task, one range after another; so its lists are whole when they leave it
        rows = rows.withColumn("range", _range()).repartition(self._tasks(rows.count()), "range")
        once = F.row_number().over(Window.partitionBy("range", "id").orderBy(F.xxhash64("text")))
        rows = rows.withColumn("turn", once).filter("turn = 1").sortWithinPartitions("range", "id")
        self._write(rows.select("range", _slot(), "text").mapInArrow(_listed(self.tokens), POSTINGS), at)
        ids = self.spark.createDataFrame([], "id long")
        if version:
            made = self.spark.read.schema(POSTINGS).parquet(f"{at}/postings").filter(DOCS)
            ids = made.select("range", F.explode("slots").alias("slot")).select((F.col("range") * RANGE + F.col("slot")).alias("id"))
            if removed is not None:
                ids = ids.unionByName(removed.select(F.col("id").cast("long").alias("id")).filter("id is not null")).distinct()
        ids.write.mode("overwrite").parquet(f"{at}/gone")
        return version

    def _tasks(self, docs: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-docs // TASK_DOCS))

    def _write(self, lists: DataFrame, at: str) -> None:
        lists.sortWithinPartitions("term", "range").write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/postings")

    def compact(self, path: str) -> Index:
        """The same index as one version in another folder, from the lists alone: a range's lists meet, and no entry is a row."""
        out = Index(self.spark, path, self.tokens)
        at = f"{out.path}/v000000"
        n = self._read("postings", POSTINGS).filter(DOCS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rows = self._postings().unionByName(self._gone(), allowMissingColumns=True)
        packs = rows.mapInArrow(_packed, "range long, pack binary").repartition(self._tasks(n), "range")
        self._write(packs.groupBy("range").applyInArrow(_merged(RANGE), POSTINGS), at)
        self.spark.createDataFrame([], "id long").write.mode("overwrite").parquet(f"{at}/gone")
        return out

    # reading

    def _gone(self) -> DataFrame:
        """(version, range, slots): what each version after the first replaced or removed."""
        ids = self._read("gone", "id long").filter("version > 0").select("version", _range().alias("range"), _slot())
        return ids.groupBy("version", "range").agg(F.collect_list("slot").alias("slots"))

    def _postings(self, terms: list[str] | None = None) -> DataFrame:
        rows = self._read("postings", POSTINGS)
        return rows if terms is None else rows.filter(F.col("term").isin(terms))

    def phrases(self, query: str) -> list[list[str]]:
        """What a query asks for: a phrase in double quotes, and each word outside of them, as this index's tokens."""
        parts = query.split('"')
        asked = [p for k, part in enumerate(parts) for p in ([part] if k % 2 else part.split())]
        found = (self.tokens(p) for p in asked)
        return [list(p) for p in dict.fromkeys(tuple(f) for f in found if f)]

    def search(self, query: str, limit: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score) of the documents that hold all phrases of the query, the `limit` best by Okapi BM25, ties by id.

        A phrase counts as a term: its occurrences, and the documents that hold it. The IDF is floored at 1e-6. Without
        words nothing is found. Only lists of the query's words are read; with a limit, of the other columns than counts
        only those ranges whose bound reaches the limit's score.
        """
        asked = self.phrases(query)
        if not asked:
            return self.spark.createDataFrame([], "id long, score double")
        lists = self._postings(sorted({"", *(w for p in asked for w in p)})).select("version", "term", "range", "most", "slots", "tfs", "places")
        hits = ", ".join(f"most{k} int, t{k} array<int>, df{k} long" for k in range(len(asked)))
        rows = lists.unionByName(self._gone(), allowMissingColumns=True).groupBy("range")
        rows = cut(rows.applyInArrow(_held(asked, RANGE), f"range long, docs long, total long, shortest int, ids array<long>, lens array<int>, {hits}"))
        sums = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["docs", "total", *(f"df{k}" for k in range(len(asked)))])).first()
        n, avg = sums["docs"], sums["total"] / max(sums["docs"], 1) or 1.0

        def score(tfs: str, length: str) -> Column:
            share = []
            for k in range(len(asked)):
                idf, tf = max(math.log((n - sums[f"df{k}"] + 0.5) / (sums[f"df{k}"] + 0.5)), 1e-6), F.col(f"{tfs}{k}")
                share.append(F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col(length) / avg)))
            return reduce(lambda x, y: x + y, share)

        def scored(some: DataFrame) -> DataFrame:
            each = some.select(F.inline(F.arrays_zip("ids", "lens", *(f"t{k}" for k in range(len(asked))))))
            return each.select(F.col("ids").alias("id"), F.round(score("t", "lens"), 8).alias("score"))

        rows = rows.filter(F.size("ids") > 0)
        if limit is None:
            return scored(rows)
        bounds = cut(rows.select("range", score("most", "shortest").alias("bound")))
        first = bounds.orderBy(F.desc("bound"), "range").limit(max(FIRST, -(-4 * limit // RANGE)))
        top = cut(scored(rows.join(first, "range", "left_semi")).orderBy(F.desc("score"), "id").limit(limit))
        least = top.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()
        # rounding may lift a score by half a unit of the last place over its bound
        open_ = bounds.join(first, "range", "left_anti")
        open_ = open_.filter(F.col("bound") >= least["s"] - 1e-8) if least["n"] == limit else open_
        return top.unionByName(scored(rows.join(open_, "range", "left_semi"))).orderBy(F.desc("score"), "id").limit(limit)


#: `most` and `shortest` are the highest count and the shortest document of a list; `places` has all entries' positions, one after another.
POSTINGS = "term string, range long, n long, most int, shortest int, slots array<short>, tfs array<int>, places array<int>"
#: A range's documents: their slots, and as tfs their lengths.
DOCS = "term = '' and most is null"


def _range() -> Column:
    return F.expr(f"(id - pmod(id, {RANGE}L)) div {RANGE}L")


def _slot() -> Column:
    return F.expr(f"cast(pmod(id, {RANGE}L) as short)").alias("slot")


def _listed(tokens: Tokens):
    """Posting lists of rows (range, slot, text) that come by range and slot, and the list of each range's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slots, lens, codes, number = None, array("h"), array("i"), array("i"), _numbers()
        for batch in batches:
            for place, slot, text in zip(*batch.columns, strict=True):
                if (place := place.as_py()) != now:
                    yield from _of_range(now, slots, lens, codes, number)
                    now, slots, lens, codes, number = place, array("h"), array("i"), array("i"), _numbers()
                words = tokens(text.as_py())
                slots.append(slot.as_py())
                lens.append(len(words))
                codes.extend(map(number.__getitem__, words))
        yield from _of_range(now, slots, lens, codes, number)

    return run


def _numbers() -> defaultdict:
    """Numbers words as they come."""
    out = defaultdict()
    out.default_factory = out.__len__
    return out


def _of_range(place: int | None, slots: array, lens: array, codes: array, number: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """POSTINGS of a range's documents, whose words come one document after another."""
    if not slots:
        return
    slots, lens, codes = (np.frombuffer(v, v.typecode) if v else np.empty(0, v.typecode) for v in (slots, lens, codes))
    terms = sorted(number)
    rank = np.empty(len(terms), np.int64)
    rank[[number[t] for t in terms]] = np.arange(len(terms))
    term, doc = rank[codes], np.repeat(np.arange(len(slots)), lens)
    at = np.arange(len(term)) - np.repeat(lens.cumsum() - lens, lens)
    order = np.argsort(term, kind="stable")
    term, doc = term[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(term) else order
    yield from _made(place, slots, lens, terms, term[first], doc[first], np.diff(first, append=len(term)), at[order])


def _made(place: int, slots: np.ndarray, lens: np.ndarray, terms: list[str], term: np.ndarray, doc: np.ndarray, tf: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """POSTINGS of documents (slots, lens) and entries (term, doc, tf), the numbers of both, in that order, with their positions."""
    lists = lambda ends, values, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))

    def rows(words: list[str], n: np.ndarray, most: list, shortest: list, *arrays: pa.Array) -> pa.RecordBatch:
        cols = [pa.array(words, pa.string()), pa.array([place] * len(words), pa.int64()), pa.array(n, pa.int64()), pa.array(most, pa.int32()), pa.array(shortest, pa.int32()), *arrays]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in POSTINGS.split(", ")])

    yield rows([""], [len(slots)], [None], [None], lists([0, len(slots)], slots, pa.int16()), lists([0, len(slots)], lens, pa.int32()), lists([0, 0], [], pa.int32()))
    if not len(term):
        return
    heads = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    most, shortest = np.maximum.reduceat(tf, heads), np.minimum.reduceat(lens[doc], heads)
    heads, ends = np.append(heads, len(term)), np.concatenate([[0], tf.cumsum()])
    for k in range(0, len(most), PIECE):
        part = heads[k : k + PIECE + 1]
        of, some = part - part[0], slice(part[0], part[-1])
        arrays = lists(of, slots[doc[some]], pa.int16()), lists(of, tf[some], pa.int32()), lists(ends[part] - ends[part[0]], at[ends[part[0]] : ends[part[-1]]], pa.int32())
        yield rows([terms[i] for i in term[part[:-1]]], np.diff(part), most[k : k + PIECE], shortest[k : k + PIECE], *arrays)


def _column(table: pa.Table, name: str) -> np.ndarray:
    """All entries of a column of lists."""
    return table[name].combine_chunks().flatten().to_numpy()


def _parts(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """(home, length, lists) of all rows of a range: each slot's version whose document counts, or -1, the document's length, and the posting lists."""
    until, home, length = np.zeros(size, np.int64), np.full(size, -1), np.zeros(size, np.int64)
    gone, docs = table.filter(pc.is_null(table["term"])), table.filter(pc.and_(pc.equal(table["term"], ""), pc.is_null(table["most"])))
    for k, version in enumerate(gone["version"].to_pylist()):
        some = gone["slots"][k].values.to_numpy()
        until[some] = np.maximum(until[some], version)
    for k, version in enumerate(docs["version"].to_pylist()):
        some, lens = docs["slots"][k].values.to_numpy(), docs["tfs"][k].values.to_numpy()
        live = until[some] <= version
        home[some[live]], length[some[live]] = version, lens[live]
    return home, length, table.filter(pc.is_valid(table["most"]))


def _entries(lists: pa.Table, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list's row, slot, tf, where its positions start) of the entries whose document counts."""
    slots, tfs = _column(lists, "slots"), _column(lists, "tfs")
    n = pc.list_value_length(lists["slots"]).to_numpy()
    row, start = np.repeat(np.arange(len(n)), n), tfs.cumsum() - tfs
    live = home[slots] == lists["version"].to_numpy()[row]
    return row[live], slots[live], tfs[live], start[live]


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, n of each."""
    ends = n.cumsum()
    return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, pack): a batch's rows of each range as one compressed table, as rows of short lists would be mostly heads."""
    for batch in batches:
        table, places, packs = pa.Table.from_batches([batch]), pc.unique(batch.column("range")), []
        for place in places:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(table.filter(pc.equal(table["range"], place)))
            packs.append(out.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([places, pa.array(packs, pa.binary())], ["range", "pack"])


def _merged(size: int):
    """POSTINGS of one version from a range's packed rows of all versions."""

    def run(packs: pa.Table) -> pa.Table:
        table = pa.concat_tables([pa.ipc.open_stream(p.as_buffer()).read_all() for p in packs["pack"]])
        home, length, lists = _parts(table, size)
        terms = sorted(set(lists["term"].to_pylist()))
        number = {t: k for k, t in enumerate(terms)}
        row, slot, tf, start = _entries(lists, home)
        term, slots = np.array([number[t] for t in lists["term"].to_pylist()], np.int64)[row], np.flatnonzero(home >= 0)
        order = np.lexsort((slot, term))
        at = _column(lists, "places")[_spread(start[order], tf[order])]
        made = list(_made(table["range"][0].as_py(), slots.astype(np.int16), length[slots], terms, term[order], np.searchsorted(slots, slot[order]), tf[order], at)) if len(slots) else []
        return pa.Table.from_batches(made, _SCHEMA)

    return run


_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<short>": pa.list_(pa.int16()), "array<int>": pa.list_(pa.int32())}[t]) for n, t in (c.split() for c in POSTINGS.split(", "))])


def _held(asked: list[list[str]], size: int):
    """A range's number of documents, their length, and the documents that hold all phrases with each one's counts."""

    def run(table: pa.Table) -> pa.Table:
        home, length, lists = _parts(table, size)
        row, slot, tf, start = _entries(lists, home)
        places, words, counts = _column(lists, "places"), np.array(lists["term"].to_pylist(), object), []
        # a position's number tells its document, too; no phrase reaches over a document's end
        span = int(length.max()) + 2 * max(map(len, asked))
        for phrase in asked:
            if len(phrase) == 1:
                some = (words == phrase[0])[row]
                counts.append(np.bincount(slot[some], tf[some], size).astype(np.int64))
                continue
            starts = None
            for k, word in enumerate(phrase):
                some = (words == word)[row]
                here = np.sort(np.repeat(slot[some].astype(np.int64) * span, tf[some]) + places[_spread(start[some], tf[some])] + len(phrase) - k)
                starts = here if starts is None else np.intersect1d(starts, here, assume_unique=True)
            counts.append(np.bincount(starts // span, minlength=size))
        both = np.flatnonzero(np.logical_and.reduce([c > 0 for c in counts]))
        ints = lambda v: pa.array([v], pa.list_(pa.int32()))
        out = {"range": table["range"][:1], "docs": [int((home >= 0).sum())], "total": [int(length.sum())], "shortest": pa.array([length[both].min() if len(both) else None], pa.int32()), "ids": pa.array([both + table["range"][0].as_py() * size], pa.list_(pa.int64())), "lens": ints(length[both])}
        for k, c in enumerate(counts):
            out |= {f"most{k}": pa.array([c[both].max() if len(both) else None], pa.int32()), f"t{k}": ints(c[both]), f"df{k}": [int((c > 0).sum())]}
        return pa.table(out)

    return run


def tokenised(tokens: Tokens):
    """(id, n_tokens, stems) of rows (id, text): the text's tokens, joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tokens(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int32()), pa.array([" ".join(f) for f in found], pa.string())], ["id", "n_tokens", "stems"])

    return run
