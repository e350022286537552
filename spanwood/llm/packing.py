"""Best-fit packing planned on a histogram of lengths.

Lengths are at most `capacity`, so their histogram has at most that many rows whatever the number of documents. Best
fit runs over these counts, longest first: a whole run of equal bins takes a whole run of equal lengths at a time. The
plan says, for each length, which ranks go to which bins; pieces then take their slots by their rank within their
length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, gapless_rank, materialise, tidy
from . import word_bpe


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit decreasing over counts: (length, first rank, end rank, first bin, items a bin, offset) rows, and the number of bins.

    Ranks first..end of that length lie in bins first bin, first bin + 1, ... with `items a bin` in each (the last may
    have fewer), the first of them at `offset`. Empty pieces (length 0) are not for this plan.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    room: list[int] = []  # sorted residuals that some bins have
    open_bins: dict[int, list[tuple[int, int]]] = {}  # residual -> runs of bins (first, count)

    def put_back(residual: int, first: int, count: int) -> None:
        if residual and count:
            if residual not in open_bins:
                insort(room, residual)
                open_bins[residual] = []
            open_bins[residual].append((first, count))

    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(room, length)
            if at < len(room):
                residual = room[at]
                first, count = open_bins[residual].pop()
                if not open_bins[residual]:
                    del open_bins[residual], room[at]
                fresh = False
            else:
                residual, first, fresh = capacity, bins, True
                count = -(-left // (capacity // length))
                bins += count
            each = residual // length
            used = min(count, -(-left // each))
            take = min(left, used * each)
            out.append((length, rank, rank + take, first, each, capacity - residual))
            full, rest = take // each, take % each
            put_back(residual - each * length, first, full)
            if rest:
                put_back(residual - rest * length, first + full, 1)
            if not fresh:
                put_back(residual, first + used, count - used)
            rank, left = rank + take, left - take
    return out, bins


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """Token counts and checksums of the pieces of each document; a document is its ids and then id 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_bpe.shared(tokenizer)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode.packed(text.as_py()) + b"\0\0\0\0"
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for col, value in zip(rows, (doc, k, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), blank(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """Pack documents into as few sequences of `capacity` tokens as best fit decreasing finds.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts are empty
    and give one piece of the closing id alone; only documents over `capacity` are cut. Repeated rows, equal or null
    ids each have pieces of their own. Other columns are not read. Only the histogram (at most `capacity` rows) and the
    plan made from it pass the driver; the plan has one row for each length, with its runs in an array.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, id_col, text_col, capacity).withColumn("__row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs: dict[int, list[tuple]] = {}
    for length, *run in plan(histogram, capacity)[0]:
        runs.setdefault(length, []).append(tuple(run))
    planned = spark.createDataFrame(list(runs.items()), "length long, runs array<struct<lo:long,hi:long,bin:long,each:long,offset:long>>")
    ranked = gapless_rank(cut.withColumn("__salt", F.xxhash64("doc_id", "piece", "__row")), ["length"], ["doc_id", "piece", "__row"], "__salt", "rank")
    slots = ranked.join(F.broadcast(planned), "length")  # at most `capacity` rows
    run = F.filter("runs", lambda x: (F.col("rank") >= x["lo"]) & (F.col("rank") < x["hi"]))[0]
    slots = slots.withColumn("run", run).withColumn("in_run", F.col("rank") - F.col("run.lo"))
    return slots.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.bin") + F.expr("in_run div run.each")).alias("sequence_id"),
        (F.col("run.offset") + F.col("in_run") % F.col("run.each") * F.col("length")).alias("offset"),
    )
