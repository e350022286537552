"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make every signature coordinate (Li and Li, 2021). The first scatters a shingle to a place on a ring;
the second is a table around that ring, and coordinate k reads it shifted by k places. So the coordinates of a
shingle are one contiguous slice of the table, and a signature is the columnwise minimum of such slices.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank, components, fresh, hot_join, materialise, tidy
from .shingles import Shingler, mix

RING = 1 << 20


class Circulant:
    """Signatures of `bands` x `rows` coordinates, and a key for each band."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        table = np.random.default_rng(seed).permutation(RING).astype(np.int32)
        k = bands * rows
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:k]]), k)
        self.bands, self.rows = bands, rows

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = None
        for at in range(0, len(shingles), 4096):  # bounded memory for very long texts
            place = (mix(shingles[at : at + 4096] ^ np.uint64(0x51ED270B9F4A7C15)) & np.uint64(RING - 1)).astype(np.int64)
            part = self.windows[place].min(axis=0)
            low = part if low is None else np.minimum(low, part)
        return low

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        sig = self.signature(shingles).astype(np.uint64).reshape(self.bands, self.rows)
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, j])
        return h.view(np.int64)


@lru_cache(4)
def _worker(bands: int, rows: int, size: int) -> tuple[Shingler, Circulant]:
    return Shingler(size), Circulant(bands, rows)


#: Sets of shingles that a task hands on at once.
SET_ROWS = 1_000


def _class(shingles: np.ndarray) -> int:
    """A 64-bit name of a shingle set; sets of equal name are taken as equal."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, size: int) -> DataFrame:
    """(id, text_hash, n_shingles, cls, keys) of each document; cls null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, circulant = _worker(bands, rows, size)
        for batch in batches:
            n, cls, keys = [], [], []
            for text in batch.column(2):
                s = shingle(text.as_py())
                n.append(len(s))
                cls.append(_class(s) if len(s) else None)
                keys.append(circulant.keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "text_hash", "n_shingles", "cls", "keys"])
        tidy()

    plain = docs.select(F.col(id_col).cast("long").alias("id"), _text_hash(text_col).alias("text_hash"), blank(text_col).alias("text"))
    return plain.mapInArrow(run, "id long, text_hash long, n_shingles long, cls long, keys array<long>")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(blank(text_col))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(cls, shingles array<long>) of docs(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = _worker(1, 1, size)[0]
        for batch in batches:
            for at in range(0, batch.num_rows, SET_ROWS):
                found = [s for s in (shingle(t.as_py()) for t in batch.column(0).slice(at, SET_ROWS)) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(map(_class, found), pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["cls", "shingles"])
        tidy()

    return docs.select("text").mapInArrow(run, "cls long, shingles array<long>")


def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b: classes) whose full shingle sets are similar enough."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.withColumns({"na": F.size("sa"), "nb": F.size("sb")}).filter(F.least("na", "nb") * threshold[1] >= F.greatest("na", "nb") * threshold[0])
    both = both.withColumn("c", F.pandas_udf(_common, "long")("sa", "sb"))
    return both.filter(F.col("c") * threshold[1] >= (F.col("na") + F.col("nb") - F.col("c")) * threshold[0]).select("a", "b")


def _prefixes(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(key, cls, n, at, most) for the shingles, rarest first, that two similar sets must share one of.

    With t the threshold, sets of sizes n and m that are similar share at least t/(1+t) * (n + m). A set whose first
    shared shingle is its `at`-th (from 0) shares n - at at most, so it can only be similar to sets of at most `most`
    shingles, and only for at up to (1 - t) * n.
    """
    num, den = threshold
    rows = sets.select("cls", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    # shingles of one set alone need no join: they come first and share nothing
    shared = rows.join(counted.filter("df > 1"), "key")
    place = F.row_number().over(Window.partitionBy("cls").orderBy("df", "key")) - 1
    own = Window.partitionBy("cls")
    placed = shared.withColumn("at", place + F.col("n") - F.count(F.lit(1)).over(own))
    placed = placed.withColumn("most", F.floor((F.col("n") - F.col("at")) * (num + den) / num + 1e-6) - F.col("n"))
    return placed.filter(F.col("at") * den <= F.col("n") * (den - num)).select("key", "cls", "n", "at", "most")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (85, 100), bands: int = 32, rows: int = 6, size: int = 5
) -> DataFrame:
    """Link documents whose sets of `size`-word shingles have a Jaccard index of threshold[0]/threshold[1] or more.

    Returns doc_id, n_shingles, component_id (smallest id reachable by links, itself included), kept and text_hash, by
    which rows of one id are told apart. A document of
    null, empty or blank text has no shingles and no links. Rows of one id each get a row of their own and are linked
    only as their texts are; null ids come last and give way to any other id in their component. Other columns are
    not read.

    Documents of equal sets are one class from the start. Band buckets first link each class to the bucket's smallest
    one, so that a bucket gives no more pairs than it has classes. Classes of buckets that this leaves in more than one
    component are filed anew, by prefixes of their sets (rarest shingles first), which no similar pair can miss. There,
    each bucket's centre is the class that its shingle comes first in, the least changed of a group of copies, and all
    others are compared with it. Pairs that are then still apart are compared if the bounds on their sizes and on their
    places in the bucket allow a link. So every candidate pair is verified, excluded by a bound, or connected already. A
    pair that shares no band is no candidate: of 32 bands of 6, one of similarity 0.85 misses all with a chance under 1 in
    3 million.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), blank(text_col).alias("text"))
    sketch = materialise(_sketch(docs, id_col, text_col, bands, rows, size))
    some = sketch.filter("cls is not null")
    owners = some.groupBy("cls").agg(F.min("id").alias("owner"))
    # keys are a function of the class: any row's will do
    filed = some.select("cls", "id", F.explode("keys").alias("key")).groupBy("key", "cls").agg(F.min("id").alias("owner"))
    # null owners (null ids) come last
    rank = F.struct(F.coalesce("owner", F.lit(2**63 - 1)).alias("o"), F.col("cls").alias("c"))
    centre = filed.groupBy("key").agg(F.min(rank)["c"].alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    filed = materialise(hot_join(filed, centre, "key", sketch.count() * bands))
    ids = filed.groupBy("cls").agg(F.min("owner").alias("__id"))
    texts = plain.join(ids.select("__id").distinct(), F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    sets = materialise(_sets(texts, size).join(ids.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("shingles").alias("shingles")))
    pairs = filed.filter("cls <> b").select(F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b")).distinct()
    links = materialise(_verified(pairs, sets, threshold))
    comp = components(links)
    labelled = _labelled(filed.select("key", "cls"), comp)
    split = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    rest = labelled.join(split, "key", "left_semi").select("cls").distinct()
    members = materialise(_prefixes(sets.join(rest, "cls", "left_semi"), threshold))
    for step in (_to_centres, _across):
        pairs = step(_labelled(members, comp), threshold)
        found = materialise(_verified(pairs.distinct(), sets, threshold))
        if not found.isEmpty():
            # roots are classes too: the forest so far stands for the links that made it
            comp = components(found.unionByName(comp.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    grouped = owners.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    first = grouped.groupBy("root").agg(F.min("owner").alias("component_id"))
    named = grouped.join(first, "root").select("cls", "component_id")
    out = sketch.select("id", "text_hash", "n_shingles", "cls").join(named, "cls", "left")
    linked = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", linked.alias("component_id"), F.col("id").eqNullSafe(linked).alias("kept"), "text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that near_duplicates keeps, with all their columns: of each component, the one with the smallest id.

    Documents without words are kept, as they are like no other. Of rows with one id and text, one is kept (the one
    whose other columns hash lowest).
    """
    own, hashed, turn = fresh(docs, "own", "hash", "turn")
    kept = near_duplicates(docs, id_col, text_col, **options).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    keyed = docs.withColumns({own: F.col(id_col).cast("long"), hashed: _text_hash(text_col)})
    mine = keyed.join(kept, keyed[own].eqNullSafe(kept["kept_id"]) & (keyed[hashed] == kept["kept_hash"]), "left_semi")
    first = F.row_number().over(Window.partitionBy(own, hashed).orderBy(F.xxhash64(*docs.columns)))
    return mine.withColumn(turn, first).filter(F.col(turn) == 1).select(*docs.columns)


def _labelled(members: DataFrame, comp: DataFrame) -> DataFrame:
    return members.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _split(labelled: DataFrame) -> DataFrame:
    """Rows of buckets with several components, without sets for which no other of the bucket is small or large enough."""
    ends = labelled.groupBy("key").agg(F.min("n").alias("__least"), F.max("most").alias("__most"), F.min("root").alias("__lo"), F.max("root").alias("__hi"), F.count(F.lit(1)).alias("size"))
    near = labelled.join(ends.filter("__lo <> __hi"), "key").filter("most >= __least AND n <= __most")
    return near.drop("__least", "__most", "__lo", "__hi")


def _to_centres(labelled: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs of each bucket's sets with its centre, the set that the bucket's shingle comes first in."""
    near = _split(labelled)
    pick = near.groupBy("key").agg(F.min(F.struct("at", "cls", "root", "n", "most")).alias("pick"))
    star = near.join(pick, "key").filter("root <> pick.root AND n <= pick.most AND pick.n <= most")
    return star.select(F.least("cls", "pick.cls").alias("a"), F.greatest("cls", "pick.cls").alias("b"))


#: Sizes of sets fall into classes of this ratio.
STEP = 1.02
#: Sets of a part of a bucket.
SALTED = 500


def _across(labelled: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """All pairs across components of a bucket that the bounds allow.

    The larger set of a pair looks for the classes of sizes that it can be similar to, so that sets which are too
    large for their place meet no one of their own size.
    """
    near, low = _split(labelled), threshold[0] / threshold[1]
    of = lambda n: F.floor(F.log(n) / math.log(STEP)).cast("int")
    small = near.select("key", of(F.col("n")).alias("step"), F.col("cls").alias("a"), F.col("n").alias("an"), F.col("most").alias("a_most"), F.col("root").alias("a_root"), F.floor(F.col("size") / SALTED).cast("int").alias("salts"))
    largest = F.least("n", "most")
    # a bucket of many sets is met in parts of SALTED: each smaller set lies in one, each larger one asks them all
    salts = F.floor(F.col("size") / SALTED).cast("int")
    small = small.withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts") + 1).cast("int")).drop("salts")
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), salts)))
    large = near.withColumn("low", F.least(F.col("n") * low, largest)).filter(largest > 0).withColumn("step", F.explode(F.sequence(of(F.greatest(F.ceil("low"), F.lit(1))), of(largest)))).select("key", "step", "salt", F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("most").alias("b_most"), F.col("root").alias("b_root"))
    hit = small.join(large, ["key", "step", "salt"]).filter("an <= bn AND a <> b AND a_root <> b_root AND an <= b_most AND bn <= a_most")
    return hit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
