"""Ranked lexical search over a clustered index, exact to the last tie.

Documents are reordered by recursive graph bisection and cut into shards. The index holds a posting list for each shard
and term, with the highest impact in it. A query's bound for a shard is the sum of its terms' highest impacts there; shards
are visited in descending order of bounds, a few more each round, until no shard that is left can reach the tenth score so
far. A shard whose bound equals that score is visited too, as a tie there may have the smaller doc_id; in a shard,
documents have places of its own, which are mapped back to doc_id before ties are broken.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bisection
from .common import blank, discard, materialise
from .shingles import LOWER

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Rows that the splits are fitted on at most, and the term buckets of each that count for them.
SAMPLE, SAMPLE_TERMS = 6_000, 512
#: Postings that a shard should hold, and terms that a task hands on at once.
SHARD_POSTINGS, PIECE = 1 << 20, 1 << 18
#: Shards that an item visits in the first round; each round visits twice as many as the last.
FIRST_VISITS = 4
#: Stands for a null id, before all others.
NULL_ID = -(2**63)


class Index(NamedTuple):
    """lists(shard, term, df, best, at, impact, docs): a row for each shard and term, and for each shard one of term "" with its docs."""

    lists: DataFrame
    n_docs: int


def terms_of(text: str) -> list[str]:
    """Terms of a text in order; A-Z are lower-cased and no other letter."""
    return TERM.findall(text.lower() if text.isascii() else text.translate(LOWER))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            found = np.unique([bisection.bucket(t) for t in set(terms_of(text.as_py()))]).astype(np.int32)
            if len(found) > SAMPLE_TERMS:  # spread over the buckets, whatever the text's order
                found = np.sort(found[np.argsort(found * np.uint32(2654435761) % np.uint32(2**31), kind="stable")[:SAMPLE_TERMS]])
            yield pa.RecordBatch.from_arrays([pa.array([found.tolist()], pa.list_(pa.int32()))], ["terms"])


def splits(docs: DataFrame) -> bisection.Tree:
    """The tree of a sample of docs(doc_id, text): some SAMPLE rows by a hash of their id, never more; at most 12 MB of buckets."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(share * 1_000_000)).select(blank("text").alias("text"))
    found = picked.mapInArrow(_sketch, "terms array<int>").limit(SAMPLE).collect()
    return bisection.fit(sorted((np.array(r.terms, np.int32) for r in found), key=lambda d: d.tobytes()))


def counted(docs: DataFrame, tree: bisection.Tree) -> DataFrame:
    """(doc_id, n, terms, tfs, leaf, place) of each row of docs(doc_id, text); place orders the documents of a leaf."""

    def piece(ids: list, lens: list, terms: list, tfs: list, ends: list, leaves: list, places: list) -> pa.RecordBatch:
        offsets = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((terms, pa.string()), (tfs, pa.int32()))]
        cols = [pa.array(ids, pa.int64()), pa.array(lens, pa.int64()), *lists, pa.array(leaves, pa.int32()), pa.array(places, pa.float64())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "terms", "tfs", "leaf", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            held: tuple[list, ...] = ([], [], [], [], [0], [], [])
            ids, lens, terms, tfs, ends, leaves, places = held
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(terms_of(text.as_py()))
                buckets = np.empty(len(found), np.int64)
                for k, term in enumerate(found):
                    at = known.get(term)
                    if at is None:
                        if len(known) >= 200_000:
                            known.clear()
                        at = known[term] = bisection.bucket(term)
                    buckets[k] = at
                leaf, mean = tree.leaf(buckets)
                ids.append(doc)
                lens.append(sum(found.values()))
                terms.extend(found)
                tfs.extend(found.values())
                ends.append(len(terms))
                leaves.append(leaf)
                places.append(mean)
                if len(terms) >= PIECE:
                    yield piece(*held)
                    held = ([], [], [], [], [0], [], [])
                    ids, lens, terms, tfs, ends, leaves, places = held
            yield piece(*held)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), blank("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<string>, tfs array<int>, leaf int, place double")


LISTS = "shard int, term string, df long, best long, at array<int>, impact array<int>, docs array<long>"


def _inverted(n_docs: int, n_terms: int):
    """A function from a shard's counted documents to its posting lists."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("place", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        n = rows["n"].to_numpy()
        m = 100 - 90 + (90 * n * n_docs) // n_terms
        lists = rows["terms"].combine_chunks()
        ends = np.concatenate([[0], np.diff(lists.offsets.to_numpy()).cumsum()])
        coded = lists.flatten().dictionary_encode()
        at = np.repeat(np.arange(len(n), dtype=np.int32), np.diff(ends))
        tf = rows["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[at])
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        df = np.bincount(codes, minlength=len(coded.dictionary))
        starts = np.concatenate([[0], df.cumsum()])
        best = np.maximum.reduceat(impact[order], starts[:-1])
        offsets = pa.array(np.append(starts, starts[-1]), pa.int32())  # the last row, of term "", has empty lists
        docs = pa.array([None] * len(df) + [rows["doc_id"].to_numpy()], pa.list_(pa.int64()))
        cols = {
            "shard": pa.array(np.full(len(df) + 1, key[0].as_py()), pa.int32()),
            "term": pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([""])]),
            "df": pa.array(np.append(df, 0), pa.int64()),
            "best": pa.array(np.append(best, 0), pa.int64()),
            "at": pa.ListArray.from_arrays(offsets, pa.array(at[order], pa.int32())),
            "impact": pa.ListArray.from_arrays(offsets, pa.array(impact[order], pa.int32())),
            "docs": docs,
        }
        return pa.table(cols)

    return run


def index(docs: DataFrame) -> Index:
    """The index of all rows of docs(doc_id, text), written to the shared folder.

    Rows without a term are in no list. A leaf's documents are dealt over as many shards as its postings ask for, so
    that a leaf of many copies, or of a third of all rows, is no task's alone.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    rows = materialise(counted(docs, splits(docs)).filter("n > 0"))
    leaves = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms")).alias("postings")).collect()  # 64 rows at most
    if not leaves:
        return Index(spark.createDataFrame([], LISTS), 0)
    n_docs, n_terms = sum(r.docs for r in leaves), sum(r.terms for r in leaves)
    first, at = {}, 0
    for r in sorted(leaves, key=lambda r: r.leaf):
        first[r.leaf], at = (at, -(-r.postings // SHARD_POSTINGS)), at - (-r.postings // SHARD_POSTINGS)
    base, slices = ([F.lit(first.get(k, (0, 1))[j]) for k in range(max(first) + 1)] for j in (0, 1))
    # dealt by the row's place in the table, which parts even rows of one id and text
    slice_ = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.array(*slices)[F.col("leaf")])
    dealt = rows.withColumn("shard", (F.array(*base)[F.col("leaf")] + slice_).cast("int"))
    lists = materialise(dealt.select("shard", "doc_id", "n", "terms", "tfs", "place").groupBy("shard").applyInArrow(_inverted(n_docs, n_terms), LISTS))
    discard(rows)
    return Index(lists, n_docs)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = sorted(set(terms_of(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.string())], ["item_id", "term"])


def _scored(top: int):
    """A function from a shard's lists and the weighted terms of the items that visit it to each item's best documents there."""

    def run(key: tuple, lists: pa.Table, wants: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if wants.num_rows and lists.num_rows:
            where = {t: k for k, t in enumerate(lists["term"].to_pylist())}
            at, impact = lists["at"].combine_chunks(), lists["impact"].combine_chunks()
            docs = lists["docs"].combine_chunks()[where[""]].values.to_numpy()
            wants = wants.sort_by([("item_id", "ascending")])
            items, terms, weights = wants["item_id"].to_numpy(), wants["term"].to_pylist(), wants["w"].to_pylist()
            ends = [*np.flatnonzero(np.diff(items)) + 1, len(items)]
            begin = 0
            for end in ends:
                score = np.zeros(len(docs), np.int64)
                for term, w in zip(terms[begin:end], weights[begin:end], strict=True):
                    k = where.get(term)
                    if k is not None:
                        score[at[k].values.to_numpy()] += w * impact[k].values.to_numpy().astype(np.int64)
                hits = np.flatnonzero(score > 0)
                if len(hits) > top:
                    hits = hits[score[hits] >= np.partition(score[hits], -top)[-top]]
                hits = hits[np.lexsort((docs[hits], -score[hits]))[:top]]
                out[0].extend([items[begin]] * len(hits))
                out[1].extend(docs[hits])
                out[2].extend(score[hits])
                begin = end
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("item_id", "doc_id", "score"), out, strict=True)})

    return run


def _best(found: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top)


def search(held: Index, items: DataFrame, top: int = 10) -> DataFrame:
    """Return item_id, rank, doc_id, score: the `top` documents of highest score above 0 of each of items(item_id, text).

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) for N documents with a term; equal scores go by ascending doc_id,
    null ids first. Items without a term, of an empty text or null, have no row; rows of one item_id are one item of all
    their terms; null item ids are one item. Repeated documents each have a row of their own.
    """
    rows = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NULL_ID)).alias("item_id"), blank("text").alias("text"))
    wanted = materialise(rows.mapInArrow(_item_terms, "item_id long, term string").distinct())
    # what any item asks for, of all shards; only these terms are read from now on
    lists = materialise(held.lists.join(wanted.select("term").unionByName(wanted.sparkSession.createDataFrame([("",)], "term string")).distinct(), "term", "left_semi"))
    stats = lists.filter("term <> ''").select("shard", "term", "df", "best")
    weight = F.floor(1000 * F.log(F.lit(2.0 * held.n_docs + 2) / (2 * F.sum("df") + 1).cast("double"))).cast("long")
    weighted = materialise(wanted.join(stats.groupBy("term").agg(weight.alias("w")), "term"))
    bounds = weighted.join(stats, "term").groupBy("item_id", "shard").agg(F.sum(F.col("w") * F.col("best")).alias("bound")).filter("bound > 0")
    turn = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("bound").desc(), "shard"))
    visits = materialise(bounds.withColumn("turn", turn))
    best = materialise(wanted.sparkSession.createDataFrame([], "item_id long, doc_id long, score long, rank int"))
    after, upto = 0, FIRST_VISITS
    while True:
        reached = best.filter(F.col("rank") == top).select("item_id", F.col("score").alias("least"))
        open_ = visits.filter(F.col("turn") > after).join(reached, "item_id", "left").filter("least is null or bound >= least")
        if open_.isEmpty():
            break
        now = open_.filter(F.col("turn") <= upto).select("item_id", "shard")
        asked = now.join(weighted, "item_id").groupBy("shard")
        read = lists.join(now.select("shard").distinct(), "shard", "left_semi").select("shard", "term", "at", "impact", "docs").groupBy("shard")
        found = read.cogroup(asked).applyInArrow(_scored(top), "item_id long, doc_id long, score long")
        before, best = best, materialise(_best(best.drop("rank").unionByName(found), top))
        discard(before)
        after, upto = upto, 3 * upto
    return best.select(F.nullif("item_id", F.lit(NULL_ID)).alias("item_id"), F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "score")
