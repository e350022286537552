"""Embedding near-duplicates: an HNSW graph for each shard, every shard asked, links verified, components united."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import components, materialise, scratch
from .hnsw import Graph

#: Most vectors of a shard, fewest shards, most and fewest vectors of a block of queries, and queries answered at a time.
SHARD_ROWS, LEAST_SHARDS, BLOCK_ROWS, LEAST_BLOCK, ASKED = 50_000, 4, 65_536, 1_024, 2_048
#: Share of an audit's queries all of whose links a shard's search must find.
RECALL = 0.999


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, recall: float = RECALL) -> DataFrame:
    """Link vectors whose cosine, in double precision, is at least `threshold`.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest id reachable), kept. Null, empty and
    zero vectors and those with null or non-finite components have no links; neither do vectors of unlike lengths.
    Repeated rows count as links of each other, whatever their ids; a null id gives way to any other in its component.
    An empty table gives an empty one. Other columns are not read.

    Equal vectors are one weighted class. Classes are dealt over shards by hash; a task builds a shard's graph, widens
    its beam until an audit against brute force passes, and writes the graph to the shared folder. Then each task takes
    a block of classes and loads shard after shard by path, so that a vector moves once and no graph is shuffled. Python
    workers must be able to open the shared folder: a local or mounted path, or a file system that pyarrow opens. A dense
    group is a bundle in its shard's graph, met as a whole, so that its links are counted without its pairs; each
    vector gives one row for each bundle in which it has links.
    """
    spark = vectors.sparkSession
    kind = "double" if isinstance(getattr(vectors.schema[vec_col].dataType, "elementType", None), DoubleType) else "float"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"))
    sound = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("h", F.when(sound, F.xxhash64("v")))
    classes = rows.filter("h is not null").groupBy("h", "v").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("weight"))
    classes = materialise(classes.withColumns({"cls": F.monotonically_increasing_id(), "dim": F.size("v")}))
    n = classes.count()
    shards = max(LEAST_SHARDS, -(-n // SHARD_ROWS))
    blocks = max(1, -(-n // BLOCK_ROWS), min(2 * spark.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    placed = classes.select("dim", "cls", "v", "weight", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(shards)).cast("int").alias("shard"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls")
        graph = Graph(np.array(pdf["v"].tolist(), np.float64 if kind == "double" else np.float32), threshold)
        share = graph.audit(recall)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "share": [share], "graph": [graph.dump()], "cls": [pdf["cls"].to_numpy(np.int64).tobytes()], "weight": [pdf["weight"].to_numpy(np.int64).tobytes()]})

    path = scratch(spark)
    built = placed.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, share double, graph binary, cls binary, weight binary")
    built.write.partitionBy("dim", "shard").parquet(path)
    index: dict[int, list[str]] = {}
    # one row for each shard comes to the driver
    for r in spark.read.schema("share double, dim int, shard int").parquet(path).orderBy("dim", "shard").collect() if n else []:
        if r["share"] < recall:
            raise RuntimeError(f"the audit of shard {r['shard']} found only {r['share']} of its links")
        index.setdefault(r["dim"], []).append(f"{path}/dim={r['dim']}/shard={r['shard']}")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, list[np.ndarray]] = {}
        values: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            dims, cls, flat = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy())
            starts = np.cumsum(np.append(0, dims))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                names.setdefault(int(dim), []).append(cls[own])
                values.setdefault(int(dim), []).append(flat[starts[own][:, None] + np.arange(dim)])
        for dim in names:
            asked, raw = np.concatenate(names[dim]), np.vstack(values[dim])
            for shard in index[dim]:
                graph, members, weight = load(shard)
                for a in range(0, len(asked), ASKED):
                    own = asked[a : a + ASKED]
                    at = np.searchsorted(members, own).clip(max=len(members) - 1)
                    found = graph.linked(raw[a : a + ASKED], weight, np.where(members[at] == own, at, -1))
                    cols = np.repeat(own, [len(f[0]) for f in found]), np.concatenate([members[f[0]] for f in found]), np.concatenate([f[1] for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["cls", "node", "n"])

    links = materialise(placed.select("dim", "cls", "v").repartition(blocks).mapInArrow(ask, "cls long, node long, n long"))
    roots = components(links.filter("cls <> node").select(F.col("cls").alias("a"), F.col("node").alias("b")))
    counted = links.groupBy("cls").agg((F.sum("n") - 1).alias("n_links"))
    named = classes.select("cls", "h", "v", "owner").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    first = named.groupBy("root").agg(F.min("owner").alias("component_id"))
    named = named.join(first, "root").join(counted, "cls", "left").select("h", "v", "n_links", "component_id")
    out = rows.join(named, ["h", "v"], "left")
    component = F.when(F.col("h").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def load(path: str) -> tuple[Graph, np.ndarray, np.ndarray]:
    """A shard's graph, the names of its rows and their weights, from the folder that its task wrote."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    file = next(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet"))
    row = pq.read_table(file, columns=["graph", "cls", "weight"], filesystem=store, partitioning=None)
    return Graph.load(row["graph"][0].as_py()), np.frombuffer(row["cls"][0].as_py(), np.int64), np.frombuffer(row["weight"][0].as_py(), np.int64)
