"""Importance resampling towards a target distribution: hashed word runs, bucket gains, a seeded draw without replacement.

A document is scanned once. While its words go by, a ring keeps the running CRC states of the runs that began at the last
few words; each further word extends every state by a space and the word, and every extension is a feature's checksum. So
a run of any length costs one update a word, and no run is ever put together as text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, materialise, ordered_rank
from .shingles import LOWER

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ring_checksums(text: str, longest: int) -> tuple[int, list[int]]:
    """The number of words, and the unsigned CRC-32 of each run of 1 to `longest` consecutive words joined by a space."""
    out: list[int] = []
    ring: list[int] = []
    n = 0
    for word in WORD.findall(text.lower() if text.isascii() else text.translate(LOWER)):
        own = word.encode("utf-8", "surrogatepass")
        more = b" " + own
        ring = [crc32(own), *[crc32(more, state) for state in ring[: longest - 1]]]
        out += ring
        n += 1
    return n, out


def features(docs: DataFrame, longest: int, buckets: int, text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, buckets array<int>) of each row of docs(doc_id, text): a bucket for each run of words, repeats kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends, flat = [], [0], []
            for text in batch.column(1):
                n, sums = ring_checksums(text.as_py(), longest)
                words.append(n)
                flat.append((np.array(sums, np.uint32) % buckets).astype(np.int32))
                ends.append(ends[-1] + len(sums))
            values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), lists], ["doc_id", "n_words", "buckets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, buckets array<int>")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in rows(buckets). Tasks count on their own; the driver gets one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets, from its counts s and t and their sums S and T."""
    size, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_source + size) / ((s + 1) * (all_target + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            n = np.diff(lists.offsets.to_numpy())
            sums = np.concatenate([[0], gain[lists.flatten().to_numpy(zero_copy_only=False)].cumsum()])
            ends = np.concatenate([[0], n.cumsum()])
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc: Column, seed: int) -> Column:
    """A document's Gumbel noise in thousandths, floored: from the first 8 hex digits of sha256("seed:doc_id")."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("null"))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """Return doc_id, n_features, weight, score, rank of every row of docs(doc_id, text), drawn towards target(text).

    Of the N rows of at least `least_words` words, the floor(percent N / 100) of highest score are drawn, ranked from 1;
    ties go to the smaller doc_id; others have rank null. Null and empty texts have no feature and weight 0. Every row is a
    document: repeated rows score alike and are ranked one after the other; a null id ranks before others of its score and
    draws its noise from the word null. Texts are read whole, however long. An empty target leaves the gains to the source's
    counts; an empty table gives an empty one. Other columns are not read.
    """
    rows = materialise(features(docs, longest, buckets))
    aim = features(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_counts(rows, buckets), bucket_counts(aim, buckets))
    scored = _weights(rows, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    able = F.col("n_words") >= least_words
    drawn = rows.filter(able).count() * percent // 100
    ranked = ordered_rank(scored.select((~able).alias("out"), (-F.col("score")).alias("order"), "doc_id", "n_features", "weight", "score"), ["out", "order", "doc_id"], "place")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
