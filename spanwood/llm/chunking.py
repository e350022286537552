"""Document fingerprints by content-defined chunking.

A gear hash over the last WINDOW bytes marks places where a text may be cut; normalised cutting asks for more zero bits
before the aimed size than after it, so that sizes gather around the aim. Cuts depend on nearby bytes alone, so an
insertion changes the chunks around it and no others. A fingerprint is the set of a text's chunks, each with its digest
and its length in bytes; likeness of two is the length they share over the length of the smaller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that the gear hash sees, least, aimed and greatest chunk sizes. WINDOW is not above LEAST.
WINDOW, LEAST, AIM, MOST = 8, 12, 28, 256
#: Bits that must be zero before the aim and after it.
BITS_BEFORE, BITS_AFTER = 5, 3
#: Rows of a slice that passes through one task.
SLICE_ROWS = 4_096
_GEAR = np.random.default_rng(2016).integers(0, 1 << 32, 256, dtype=np.uint32)
_STRICT, _LOOSE = np.uint32(((1 << BITS_BEFORE) - 1) << (32 - BITS_BEFORE)), np.uint32(((1 << BITS_AFTER) - 1) << (32 - BITS_AFTER))


def _gear(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gears of the last WINDOW bytes, each shifted two bits for every byte since."""
    h = _GEAR[data]
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(2 * span)
        span *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if not n:
        return []
    h = _gear(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero((h & _LOOSE) == 0)
    strict = (loose[(h[loose] & _STRICT) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    loose.append(n)
    strict.append(n)
    out, at, i, j = [], 0, 0, 0
    while n - at > LEAST:
        low, aim, high = at + LEAST, at + AIM, min(at + MOST, n)
        while strict[i] < low and strict[i] < n:
            i += 1
        if strict[i] <= aim:
            at = strict[i]
        else:
            while loose[j] <= aim and loose[j] < n:
                j += 1
            at = min(loose[j], high)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def fingerprint(text: str) -> dict[int, int]:
    """Digest to length of each distinct chunk."""
    data = text.encode("utf-8", "surrogatepass")
    out: dict[int, int] = {}
    at = 0
    for end in cuts(data):
        out[xxhash.xxh3_64_intdigest(data[at:end]) >> 24] = end - at
        at = end
    return out


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Length shared over the length of the smaller; two empty fingerprints are alike, one empty one is like no other."""
    if not a or not b:
        return float(not a and not b)
    if len(a) > len(b):
        a, b = b, a
    return sum(n for d, n in a.items() if d in b) / min(sum(a.values()), sum(b.values()))


def shown(f: dict[int, int]) -> str:
    """digest:length of each chunk, by digest."""
    return ",".join(f"{d:010x}:{n}" for d, n in sorted(f.items()))


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by the first as many code points, or all, of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slice, guest, doc_id, text) in the order of their slices; each row meets the one after it in its slice."""
    held = None
    for batch in batches:
        rows: list[tuple] = []
        for part, guest, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            text = text.as_py()
            own = fingerprint(text)
            if held is not None and held[0] == part and not held[1]:
                _, _, doc_before, text_before, before = held
                new = edited(text_before, text)
                of_new = fingerprint(new)
                digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((doc_before, len(text_before), digest, shown(before), shown(of_new), likeness(before, of_new), likeness(before, own)))
            held = (part, guest, doc, text, own)
        cols = list(zip(*rows, strict=True)) or [[]] * len(_COLUMNS)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], list(_COLUMNS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slices: int | None = None) -> DataFrame:
    """Fingerprint each text and its edited text, the next document being that of the next smaller id (the last one's: the first).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are
    empty; an empty text has an empty fingerprint. Rows of one id follow each other by the hash of their texts; null
    ids come last. A single row is its own next. Other columns are not read.

    Ids are cut into slices at borders that a sample of ids gives, so that each slice's rows, sorted, pass through one task
    as a stream and a text is shuffled once. Borders go to the tasks as arrays (at most 0.5 MB), so the plan is the same for
    any number of slices. Each slice ends with a guest, the first row of the slice after it. An id that fills several slices
    is parted by the hashes of its texts; rows of one id and text stay together.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # order: ids downward, then ties upward; nulls as the smallest id. The complement of an id falls as the id grows, over the whole range
    order = rows.withColumn("o", F.bitwise_not(F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))))
    total = order.count()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    n = slices or min(max(8, -(-total // SLICE_ROWS)), MOST_SLICES)
    at = _placed(_borders(order.select("o"), total, n))("o", "tie")
    # one row for each slice that has any: the first
    firsts = order.select("o", "tie", at.alias("slice")).groupBy("slice").agg(F.min(F.struct("o", "tie")).alias("h"))
    chain = sorted((r["slice"], r["h"]["o"], r["h"]["tie"]) for r in firsts.collect())
    heads = spark.createDataFrame([(chain[k - 1][0], o, tie) for k, (_, o, tie) in enumerate(chain)], "slice int, o long, tie long")
    # any of several rows of one id and text will do; what is broadcast has a row for each slice
    guests = order.join(F.broadcast(heads), ["o", "tie"]).groupBy("slice", "o", "tie").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    stream = order.select(at.alias("slice"), F.lit(False).alias("guest"), "doc_id", "text", "o", "tie").unionByName(guests.select("slice", F.lit(True).alias("guest"), "doc_id", "text", "o", "tie"))
    # slices follow each other, so ranges of them are partitions of even sizes where hashes of them would collide
    dealt = stream.repartitionByRange(len(chain), "slice").sortWithinPartitions("slice", "guest", "o", "tie")
    return dealt.select("slice", "guest", "doc_id", "text").mapInArrow(_in_order, SCHEMA)


#: Most slices, whatever the number of rows, and sampled ids for each.
MOST_SLICES, SAMPLED = 20_000, 20


def _borders(keys: DataFrame, total: int, n: int) -> np.ndarray:
    """The first o of each of some n slices, ascending, from a sample of keys(o); an o that comes k times fills about k slices."""
    share = min(1.0, SAMPLED * n / total)
    # a row's place in the table tells rows of one id apart; the sample need not be the same twice, as it is taken once
    picked = keys if share == 1 else keys.filter(F.pmod(F.xxhash64("o", F.monotonically_increasing_id()), F.lit(1_000_000)) < F.lit(share * 1_000_000))
    found = np.sort(np.array([r["o"] for r in picked.collect()], np.int64))
    return found[np.arange(n) * len(found) // n] if len(found) else np.zeros(1, np.int64)


def _placed(borders: np.ndarray):
    """The slice of (o, tie): that of the last border up to o; an o of several borders is dealt over them by ranges of its ties."""

    def run(o: pd.Series, tie: pd.Series) -> pd.Series:
        key = o.to_numpy(np.int64)
        low, high = np.searchsorted(borders, key, "left"), np.searchsorted(borders, key, "right")
        width = high - low
        # ties as shares of their range, in order
        part = (tie.to_numpy(np.int64).astype(np.float64) / 2.0**64 + 0.5) * width
        own = low + np.minimum(part.astype(np.int64), np.maximum(width - 1, 0))
        return pd.Series(np.where(width > 0, own, np.maximum(low - 1, 0)).astype(np.int32))

    return F.pandas_udf(run, "int")
