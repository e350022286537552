"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return base.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, computes it once and outlives lost executors.

    What is read back is part of the caller's lazy result, so it stays until its folder is cleared: `discard` removes a
    table that has no reader any more.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that materialise wrote; nothing may read it from now on."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        path = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def tidy() -> None:
    """Give memory that a task's batches took back to the system; workers live on, and would keep the most that any task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def blank(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own beside all of df's, whatever these are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"__{name}" in taken:
            name = "_" + name
        out.append(f"__{name}")
    return out


def split_hot(rows: DataFrame, one: DataFrame, key: str, most: int, how: str) -> DataFrame:
    """rows joined with one(key, n, ...), which has one row for each key and the key's number of rows there, of `most` in all.

    Keys of over a HOT_SHARE-th of all rows are at most HOT_SHARE many, so they are broadcast and their rows stay where
    they are; no task gets a hot key whole. The rest is joined by key, `how` inner or left.
    """
    hot = F.broadcast(one.filter(F.col("n") > most / HOT_SHARE).drop("n"))  # at most HOT_SHARE rows
    cold = one.filter(F.col("n") <= most / HOT_SHARE).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, how))


def hot_join(rows: DataFrame, one: DataFrame, key: str, most: int) -> DataFrame:
    return split_hot(rows, one, key, most, "inner")


#: A key is hot from this share of all rows on.
HOT_SHARE = 1_000


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], salt: str, out: str, bucket_rows: int = 100_000) -> DataFrame:
    """Number the rows of each key from 0 without bringing a key's rows into one task.

    Rows are dealt by the column `salt` over so many buckets that one holds some `bucket_rows` rows even if a key has all;
    a small count per (key, bucket) gives each bucket its first number, and rows are numbered within their bucket by
    `order`. df should be materialised: it is read three times.
    """
    buckets = max(64, -(-df.count() // bucket_rows))
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(salt), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*keys, "__b").orderBy(*order)
    ranked = dealt.withColumn("__r", F.row_number().over(within) - 1)
    return ranked.join(starts, [*keys, "__b"]).withColumn(out, (F.col("__start") + F.col("__r")).cast("long")).drop("__b", "__r", "__start")


def ordered_rank(df: DataFrame, order: list[str], out: str, part_rows: int = 1_000_000) -> DataFrame:
    """Number all rows from 0 in ascending `order`, whose columns should tell rows apart; no task gets more than a part of them.

    Rows are dealt by ranges of `order` and written, so that each keeps its part; a count for each part gives its first number.
    """
    spark = df.sparkSession
    # counted from what is dealt, not guessed: at least a task for each million rows
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // part_rows))
    dealt = materialise(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row for each part
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__r", within).join(F.broadcast(starts), "__part").withColumn(out, (F.col("__start") + F.col("__r")).cast("long")).drop("__part", "__start", "__r")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b long): (node, root), root the smallest node; nodes without a link are left out.

    Alternates the large-star and small-star contractions of Kiveris et al. (2014); every round is two aggregations
    with map-side combine and two equi-joins, and ends as a table in the shared folder. A hub's edges may be split over
    tasks because the other join side has one row for each node.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = _state(e)
    if not state[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, e = e, materialise(small.filter("u <> v").distinct())
        now = _state(e)
        discard(before)
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v"))).first())
