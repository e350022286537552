"""Queries on the graph that is kept up to date with changes of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..operators.steps import fresh_dir
from ..streaming.graph_state import GraphState, present
from .registry import query

Spark = SparkSession


def changes(spark: Spark, d: str) -> DataFrame:
    """Events as changes of the files of nodes: (file, ts, tie, present)."""
    nodes = V.nodes(spark, d)
    touched = V.table(spark, d, "events").withColumn("id", F.col("event_id") % nodes.count())
    return touched.join(nodes.select("id", "file"), "id").select("file", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), present(F.col("event_type")).alias("present"))


def start(spark: Spark, d: str) -> DataFrame:
    """Every file as it is before any event."""
    return V.nodes(spark, d).select("file").distinct().select("file", F.lit("1970-01-01").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("tie"), F.lit(True).alias("present"))


def parser(spark: Spark, d: str):
    """A file's symbols and references as of its last event: the event renames a third of the symbols."""
    nodes, edges = V.nodes(spark, d), V.edges(spark, d)

    def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = nodes.join(files.select("file", F.col("tie").alias("g")), "file")
        name = F.when((F.col("g") > 0) & ((F.col("id") + F.col("g")) % 3 == 0), F.concat("name", F.lit("_"), (F.col("g") % 7).cast("string"))).otherwise(F.col("name"))
        target = nodes.select(F.col("id").alias("target_id"), "name")
        references = edges.join(own.select("file", F.col("id").alias("source_id")), "source_id").join(target, "target_id").select("file", "source_id", "name", edges["kind"])
        return own.select("file", "id", name.alias("name"), "exported"), references.distinct()

    return parse


def _watched(spark: Spark, d: str) -> tuple[GraphState, str]:
    """The graph after all events, read as a stream of three batches behind a first build; and the folder of the deltas."""
    home = fresh_dir(spark)
    graph, pushed = GraphState(spark, f"{home}/graph", parser(spark, d)), f"{home}/pushed"

    def push(version: int, delta: DataFrame) -> None:
        delta.write.mode("overwrite").parquet(f"{pushed}/version={version}")

    push(graph.apply(start(spark, d)), graph.delta(0))
    source = changes(spark, d)
    source.repartition(3, "tie").write.parquet(f"{home}/changes")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/changes")
    graph.watch(stream, f"{home}/checkpoint", push)
    return graph, pushed


_GRAPH = """WITH last AS (SELECT n.file, max_by(e.event_id, (e.ts, e.event_id)) g, max_by(e.event_type, (e.ts, e.event_id)) what
    FROM events e JOIN g_nodes n ON n.id = e.event_id % (SELECT count(*) FROM g_nodes) GROUP BY n.file),
  symbols AS (SELECT n.file, regexp_replace(n.file, '/[^/]*$', '') dir, n.id, n.exported, n.name base,
      CASE WHEN coalesce(g, 0) > 0 AND (n.id + g) % 3 = 0 THEN n.name || '_' || (g % 7) ELSE n.name END AS name
    FROM g_nodes n LEFT JOIN last USING (file) WHERE coalesce(what, '') <> 'error'),
  refs AS (SELECT DISTINCT s.file, s.dir, source_id, t.name, g_edges.kind FROM g_edges JOIN symbols s ON s.id = source_id JOIN g_nodes t ON t.id = target_id),
  built AS (SELECT DISTINCT source_id, coalesce(a.id, b.id, c.id) target_id, kind FROM refs
    LEFT JOIN (SELECT name, file, min(id) id FROM symbols GROUP BY ALL) a USING (name, file)
    LEFT JOIN (SELECT name, dir, min(id) id FROM symbols GROUP BY ALL) b USING (name, dir)
    LEFT JOIN (SELECT name, min(id) id FROM symbols WHERE exported GROUP BY ALL) c USING (name) WHERE coalesce(a.id, b.id, c.id) IS NOT NULL)"""


@query(f"{_GRAPH} SELECT * FROM built")
def sr06_incremental_graph(spark: Spark, d: str) -> DataFrame:
    return _watched(spark, d)[0].edges().select("source_id", "target_id", "kind")


@query(f"{_GRAPH} SELECT kind, count(*) edges, count(DISTINCT source_id) sources FROM built GROUP BY kind")
def sr07_graph_deltas(spark: Spark, d: str) -> DataFrame:
    _, pushed = _watched(spark, d)
    signed = spark.read.parquet(pushed).withColumn("n", F.when(F.col("change") == "added", 1).otherwise(-1))
    there = signed.groupBy("source_id", "target_id", "kind").agg(F.sum("n").alias("n")).filter("n = 1")
    return there.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("source_id").alias("sources"))
