"""Structured Streaming: event windows, debounced file changes, journals and incremental graph maintenance."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.steps import shared_dir


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_batch: int = 16) -> DataFrame:
    """The events table as a stream, its time as a timestamp."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its result: the last batch in complete mode, all batches in append mode."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append")
    else:
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").outputMode(mode)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of events by windows; events later than `late` may be dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, n) of each user's runs of events with no gap of that length."""
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def first_of_each(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Events without repeats of their keys within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def change_of(operation: Column) -> Column:
    """added, modified or deleted for create, write, remove and rename; null for others."""
    return F.when(operation == "create", "added").when(operation == "write", "modified").when(operation.isin("remove", "rename"), "deleted")


def debounced(changes: DataFrame, quiet: str = "300 milliseconds") -> DataFrame:
    """(batch_start, path, change) of changes(ts, path, change): a batch ends when nothing changes anywhere for `quiet`.

    Of a path's changes in a batch, a deletion stands, else the last one. The quiet time is global, so a batch is
    one session over all paths; only (path, change, time) triples of a batch, reduced on the map side, meet there.
    """
    last = F.max(F.struct((F.col("change") == "deleted").alias("gone"), "ts", "change"))
    gaps = changes.withColumn("at", F.date_trunc("minute", "ts"))
    # a batch's border is a gap before it: looked for within each minute, and across minutes on their ends alone
    within = Window.partitionBy("at").orderBy("ts")
    ends = gaps.groupBy("at").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    before = ends.select("at", "lo", F.lag("hi").over(Window.orderBy("at")).alias("before"))
    limit = F.expr(f"INTERVAL {quiet}")
    marked = gaps.withColumn("prev", F.lag("ts").over(within)).join(before, "at").withColumn("prev", F.coalesce("prev", "before"))
    fresh = marked.withColumn("border", F.when(F.col("prev").isNull() | (F.col("ts") > F.col("prev") + limit), F.col("ts")))
    carried = fresh.groupBy("at").agg(F.max("border").alias("b"))
    start = carried.select("at", F.last("b", ignorenulls=True).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    own = F.last("border", ignorenulls=True).over(within.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    batches = fresh.withColumn("own", own).join(start, "at").withColumn("batch_start", F.coalesce("own", "carried"))
    return batches.groupBy("batch_start", "path").agg(last["change"].alias("change"))


#: The first line of a journal, with the time of the last full build.
HEADER = "spanwood-journal"


def read_journal(lines: DataFrame) -> DataFrame:
    """(path, change) of a journal's lines(pos, value): changed, or deleted after "DELETED "; the first line on a path counts.

    Blank lines and those after # don't count. Without a header line of a positive time there are no rows.
    """
    head = lines.filter("pos = 0").select(F.expr(f"try_cast(regexp_extract(value, '^{HEADER} ([0-9]+)$', 1) AS BIGINT) > 0").alias("ok")).filter("ok")
    body = lines.filter("pos > 0").filter(~F.trim("value").rlike("^(#.*)?$"))
    gone = F.col("value").startswith("DELETED ") & (F.trim(F.substring("value", 9, 1 << 20)) != "")
    rows = body.select("pos", F.when(gone, F.trim(F.expr("substring(value, 9)"))).otherwise(F.trim("value")).alias("path"), F.when(gone, "deleted").otherwise("changed").alias("change"))
    first = rows.groupBy("path").agg(F.min(F.struct("pos", "change"))["change"].alias("change"))
    return first.join(head.limit(1).select(F.lit(True).alias("ok")), F.lit(True), "left_semi")


def maintained(spark: SparkSession, stream: DataFrame, start: DataFrame, key: str, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Keep a table up to date with a stream of changes, a version for each batch: apply(table, batch) gives the next one."""
    base = f"{shared_dir(spark)}/maintained/{uuid.uuid4().hex}"
    start.write.parquet(f"{base}/v0")
    state = {"v": 0}

    def merge(batch: DataFrame, number: int) -> None:
        now = batch.sparkSession.read.parquet(f"{base}/v{number}")
        apply(now, batch).write.mode("overwrite").parquet(f"{base}/v{number + 1}")
        state["v"] = number + 1

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/v{state['v']}")


def built(stream: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What build(batch) gives for every batch of changes there is, each written once under its number."""
    spark, base = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/built/{uuid.uuid4().hex}"
    run = lambda batch, number: build(batch).write.mode("overwrite").parquet(f"{base}/out/batch={number}")
    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def fanned_out(stream: DataFrame, sinks: dict[str, str]) -> dict[str, DataFrame]:
    """Each batch's rows to every sink whose condition they meet; a batch that runs again replaces what it wrote."""
    spark, base = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/sinks/{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        for name, condition in sinks.items():
            batch.filter(condition).write.mode("overwrite").parquet(f"{base}/{name}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return {name: spark.read.schema(stream.schema).parquet(f"{base}/{name}") for name in sinks}


def replaced(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with rows of the same key replaced."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)
