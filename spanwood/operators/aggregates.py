"""Counts, rankings and windows over nodes, edges and event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, by: str, distinct: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(distinct).alias(f"{distinct}s"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, key, n: nodes and edges by kind, and the number of files."""
    n = nodes.groupBy(F.lit("node").alias("what"), F.col("kind").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy(F.lit("edge").alias("what"), F.col("kind").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(e).unionByName(nodes.agg(F.countDistinct("file").alias("n")).select(F.lit("file").alias("what"), F.lit("all").alias("key"), "n"))


def fan(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """nodes with fan_in and fan_out: distinct neighbours over edges of the kinds."""
    e = edges.filter(F.col("kind").isin(kinds))
    i = e.groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("fan_in"))
    o = e.groupBy(F.col("source_id").alias("id")).agg(F.countDistinct("target_id").alias("fan_out"))
    return nodes.join(i, "id", "left").join(o, "id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("fan_in", "fan_out")})


def top(df: DataFrame, by: str, n: int, tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def hotspots(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """The most connected functions: twice the fan-in, the fan-out, and one if exported."""
    f = fan(nodes.filter(F.col("kind").isin("function", "method")), edges, ["calls"])
    score = 2 * F.col("fan_in") + F.col("fan_out") + F.when(F.col("exported"), 1).otherwise(0)
    return top(f.withColumn("score", score).filter("score > 0"), "score", n).select("id", "name", "fan_in", "fan_out", "score")


def complexity_stats(df: DataFrame, value: str, high: int = 10) -> DataFrame:
    v = F.col(value)
    return df.agg(F.round(F.avg(v), 8).alias("avg_complexity"), F.max(v).alias("max_complexity"), F.count(F.when(v > high, 1)).alias("n_high"), F.sum(v).alias("total"))


def modules(nodes: DataFrame, depth: int, n: int) -> DataFrame:
    """The largest modules, a module being the first `depth` parts of the path."""
    m = nodes.groupBy(F.substring_index("file", "/", depth).alias("module")).agg(F.count(F.lit(1)).alias("n"))
    return top(m, "n", n, "module")


def by_count(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), key)


def sessions(messages: DataFrame) -> DataFrame:
    """For each session (session, turn, agent): size, first and last turn, and the last agent named, else 'default'."""
    return messages.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.coalesce(F.max_by("agent", F.when(F.col("agent").isNotNull(), F.col("turn"))), F.lit("default")).alias("agent")
    )


def triage(nodes: DataFrame, edges: DataFrame, complexity: DataFrame) -> DataFrame:
    """impact, risk and bucket of each node from its callers and complexity (default 1)."""
    callers = edges.filter("kind = 'calls'").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    n = nodes.select("id").join(callers, "id", "left").join(complexity.select("id", "complexity"), "id", "left").fillna({"callers": 0, "complexity": 1})
    impact = 0.5 * F.col("callers")
    risk = 0.3 * F.col("complexity") + 0.7 * impact
    return n.select("id", impact.alias("impact"), F.round(risk, 8).alias("risk"), F.when(risk >= 5, "high").when(risk >= 2, "medium").otherwise("low").alias("bucket"))


def triage_changed(nodes: DataFrame, n: int) -> DataFrame:
    """Changed nodes (id, fan_in, entry) by risk: callers over 20, and 0.3 more for an entry, both at most 1."""
    impact = F.least(F.col("fan_in") / 20.0, F.lit(1.0))
    risk = F.least(F.lit(1.0), impact + F.when(F.col("entry"), 0.3).otherwise(0.0))
    reason = F.when(F.col("entry"), "entry point").when(impact > 0.1, "many callers").otherwise("changed")
    return top(nodes.select("id", F.round(impact, 8).alias("impact"), F.round(risk, 8).alias("risk"), reason.alias("reason")), "risk", n)


def embedding_status(nodes: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    j = nodes.select("id").join(vectors.select(F.col(key).alias("id"), F.lit(1).alias("hit")), "id", "left")
    return j.agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("embedded"), (F.count(F.lit(1)) - F.count("hit")).alias("pending"))


def ids_by(df: DataFrame, key: str, part: Column) -> DataFrame:
    """Sorted ids of each group as text, a row for each part of the group, so that no row grows with the group."""
    return df.groupBy(key, part.alias("__part")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids")).select(key, "ids")


def global_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number all rows from 1 in a total order.

    Rows are numbered among those with their first sort key; only the counts of these keys pass one task.
    """
    first = order[0]
    counted = df.groupBy(first).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select(first, F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = df.withColumn("__k", F.row_number().over(Window.partitionBy(first).orderBy(*order)))
    return ranked.join(starts, first).withColumn(out, F.col("__before") + F.col("__k")).drop("__before", "__k")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def newest(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("ts"), "event_id").limit(n)


def repeated_patterns(events: DataFrame, by: str, order: list[str], value: str, length: int, least: int) -> DataFrame:
    """Runs of `length` values seen `least` times or more so far in their group, each time they come again."""
    w = Window.partitionBy(by).orderBy(*order)
    runs = events.withColumn("__run", F.collect_list(value).over(w.rowsBetween(1 - length, 0))).filter(F.size("__run") == length).withColumn("pattern", F.array_join("__run", ">"))
    seen = F.count(F.lit(1)).over(Window.partitionBy(by, "pattern").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("seen", seen).filter(F.col("seen") >= least)


def recent_repeats(events: DataFrame, by: str, order: list[str], value: str, last: int) -> DataFrame:
    """How often each row's value came among the `last` rows before it in its group."""
    recent = F.collect_list(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(-last, 0))
    return events.withColumn("__r", recent).withColumn("repeats", F.size(F.filter("__r", lambda x: x == F.col(value))) - 1).drop("__r")


def gap_sessions(events: DataFrame, by: str, ts: str, gap: str) -> DataFrame:
    """Sessions parted by gaps: their number and the size of the largest, for each key."""
    s = events.groupBy(by, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy(by).agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))
