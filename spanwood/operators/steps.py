"""Helpers of iterative operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one in a local master's warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return base.rstrip("/")


def fresh_dir(spark: SparkSession) -> str:
    """A path of its own in the shared folder, for tables that are kept."""
    return f"{shared_dir(spark)}/kept/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no earlier round."""
    path = f"{shared_dir(df.sparkSession)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide(df: DataFrame) -> DataFrame:
    """cut, for tables that grow with the graph: what joins them directly is shuffled, as broadcasts of every round would pass through the driver."""
    return cut(df).hint("merge")


def discard(df: DataFrame) -> None:
    """Remove what cut wrote of an earlier round; nothing may read it from now on."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        path = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that a task should sort or group at once.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys over more tasks than the session's shuffles have, where these would take over TASK_ROWS of `rows` rows each."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) of edges(src, dst) and their reverses, without loops."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()


def arrows(edges: DataFrame, direction: str = "out") -> DataFrame:
    """edges(source_id, target_id) as distinct (src, dst) to walk: out, in (against the edges) or both."""
    plain = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    if direction == "both":
        return both_ways(plain)
    if direction == "in":
        plain = plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return plain.distinct()


def simple(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The simple digraph: distinct (src, dst) without loops, both ends being nodes."""
    ids = nodes.select("id").distinct()
    known = arrows(edges).filter("src <> dst")
    return known.join(ids, known["src"] == ids["id"], "left_semi").join(ids, known["dst"] == ids["id"], "left_semi")
