"""Jump consistent hashing: keys to shards without a ring table (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, gapless_rank, materialise


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each unsigned 64-bit key; going to one more shard moves keys only into it."""
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    live, jump = np.arange(len(key)), np.zeros(len(key), np.int64)
    while len(live):
        at[live] = jump
        k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        key[live] = k
        jump = np.floor((at[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        on = jump < shards
        live, jump = live[on], jump[on]
    return at


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """Shard documents by the law `key`: the id and the number of shards decide, nothing else.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (gapless from 0 in its shard, by a hash
    of id and row, then by id) and
    grown_shard (with one more shard). Null ids are one key of their own; null texts have size 1 and the checksum of
    the empty text; rows with one id share a shard, and so equal texts share one only if their ids do. Repeated rows
    each get a slot. Other columns are not read. A shard's rows are numbered over many tasks, see gapless_rank.
    """

    @F.pandas_udf("shard int, grown_shard int")
    def placed(key: pd.Series) -> pd.DataFrame:
        k = key.to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump_hash(k, shards).astype(np.int32), "grown_shard": jump_hash(k, shards + 1).astype(np.int32)})

    text = blank(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        placed(F.xxhash64(F.col(id_col).cast("string"))).alias("__at"),
    ).select("doc_id", "size", "text_crc32", "__at.*")
    # a row's number as written tells repeated rows apart, so that these are dealt over the buckets too
    rows = materialise(rows.withColumn("__row", F.monotonically_increasing_id()))
    ranked = gapless_rank(rows.withColumn("__salt", F.xxhash64("doc_id", "__row")), ["shard"], ["doc_id", "__row"], "__salt", "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
