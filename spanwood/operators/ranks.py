"""PageRank over blocks of nodes.

Ids are dealt in ranges into blocks, so that ways between ids that lie near each other stay within a block. The ways from one
block into another are written once, as arrays; a round reads them by path and shuffles only the ranks that a block asks of
another, a number for each node and block that it leads to. Workers must be able to open the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .steps import cut, discard, fresh_dir

#: Nodes of a block, and blocks at most; larger graphs have larger blocks.
NODES, BLOCKS = 65_536, 256

_ROWS = "to long, at long, values array<double>"
#: Rows that go to no block: mass without a way out, and ranks.
_LOOSE, _RANKS = -1, -2


def _read(path: str, columns: list[str]) -> pa.Table:
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    found = [f.path for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.path.endswith(".parquet")]
    tables = [pq.read_table(store.open_input_file(f), columns=columns) for f in found]
    return pa.concat_tables(tables) if tables else pa.table({c: [] for c in columns})


def _array(column: pa.ChunkedArray, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def _between(rows: pa.Table) -> pa.Table:
    """The ways from one block into another: slots that send, and each way's place among these and slot that it leads to."""
    slots, places = np.unique(rows["ss"].to_numpy(), return_inverse=True)
    lists = [pa.array([v.astype(np.int32)], pa.list_(pa.int32())) for v in (slots, places, rows["ds"].to_numpy())]
    return pa.table([rows["db"][:1], rows["sb"][:1], *lists], ["db", "sb", "slots", "places", "ends"])


def _outs(rows: pa.Table) -> pa.Table:
    """Numbers of ways out of a block's nodes by slot."""
    outs = np.zeros(rows.num_rows)
    outs[rows["slot"].to_numpy()] = rows["outs"].to_numpy()
    return pa.table([rows["block"][:1], pa.array([outs], pa.list_(pa.float64()))], ["block", "outs"])


def _block(path: str, n: int, damping: float, loose: float | None, last: bool):
    """A block's round: its ranks from what came, or equal ones without `loose`; what it sends on, or its ranks if it is the last."""

    def run(rows: pa.Table) -> pa.Table:
        to, at = rows["to"][0].as_py(), rows["at"].to_pylist()
        outs = _array(_read(f"{path}/outs/block={to}", ["outs"])["outs"], 0)
        ranks = np.full(len(outs), 1 / n)
        if loose is not None:
            came = np.zeros(len(outs))
            for k in (k for k, other in enumerate(at) if other >= 0):
                ways = _read(f"{path}/ways/db={to}/sb={at[k]}", ["places", "ends"])
                came += np.bincount(_array(ways["ends"], 0), _array(rows["values"], k)[_array(ways["places"], 0)], len(outs))
            ranks = (1 - damping) / n + damping * (came + loose / n)
        if last:
            made = [(_RANKS, ranks)]
        else:
            sends = _read(f"{path}/sends/sb={to}", ["db", "slots"])
            share = ranks / np.maximum(outs, 1)
            made = [(_LOOSE, np.array([ranks[outs == 0].sum()]))]
            made += [(db, share[_array(sends["slots"], k)]) for k, db in enumerate(sends["db"].to_pylist())]
        return pa.table([pa.array([m[0] for m in made], pa.int64()), pa.array([to] * len(made), pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.float64()))], ["to", "at", "values"])

    return run


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 50) -> DataFrame:
    """(id, rank): equal start, mass of nodes without a way out spread evenly, parallel edges counted; ranks add up to 1.

    A round is one job, which writes what blocks send on and sums up the mass without a way out on the way.
    """
    spark = nodes.sparkSession
    path = fresh_dir(spark)
    ids = cut(nodes.select(F.col("id").alias("node")).filter("node IS NOT NULL").distinct())
    n = max(ids.count(), 1)
    ranged = ids.repartitionByRange(min(BLOCKS, -(-n // NODES)), "node").sortWithinPartitions("node")
    # the id that Spark gives a row is its partition's number and its place there
    placed = ranged.select("node", F.monotonically_increasing_id().alias("place"))
    placed = cut(placed.select("node", F.shiftright("place", 33).alias("block"), F.col("place").bitwiseAND((1 << 33) - 1).alias("slot")))
    ways = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    ways = ways.join(placed.select(F.col("node").alias("src"), F.col("block").alias("sb"), F.col("slot").alias("ss")), "src")
    ways = cut(ways.join(placed.select(F.col("node").alias("dst"), F.col("block").alias("db"), F.col("slot").alias("ds")), "dst").select("sb", "ss", "db", "ds"))
    ways.groupBy("db", "sb").applyInArrow(_between, "db long, sb long, slots array<int>, places array<int>, ends array<int>").write.partitionBy("db", "sb").parquet(f"{path}/ways")
    kept = spark.read.schema("slots array<int>, places array<int>, ends array<int>, db long, sb long").parquet(f"{path}/ways")
    kept.select("sb", "db", "slots").repartition("sb").write.partitionBy("sb").parquet(f"{path}/sends")
    outs = ways.groupBy(F.col("sb").alias("block"), F.col("ss").alias("slot")).agg(F.count(F.lit(1)).cast("double").alias("outs"))
    outs = placed.select("block", "slot").join(outs, ["block", "slot"], "left").select("block", "slot", F.coalesce("outs", F.lit(0.0)).alias("outs"))
    outs.groupBy("block").applyInArrow(_outs, "block long, outs array<double>").write.partitionBy("block").parquet(f"{path}/outs")
    discard(ways)
    blocks = cut(placed.select(F.col("block").alias("to"), F.lit(-1).cast("long").alias("at"), F.lit(None).cast("array<double>").alias("values")).distinct())
    tasks = max(blocks.count(), 1)
    sent, loose = None, None
    for k in range(rounds + 1):
        before, seen = sent, Observation()
        rows = (blocks if sent is None else blocks.unionByName(sent.filter("to >= 0"))).repartition(tasks, "to")
        sent = rows.groupBy("to").applyInArrow(_block(path, n, damping, loose, k == rounds), _ROWS)
        sent = cut(sent.observe(seen, F.sum(F.when(F.col("to") == _LOOSE, F.col("values")[0])).alias("loose")))
        loose = seen.get["loose"] or 0.0
        if before is not None:
            discard(before)
    ranks = sent.select(F.col("at").alias("block"), F.posexplode("values").alias("slot", "rank"))
    return placed.join(ranks, ["block", "slot"]).select(F.col("node").alias("id"), "rank")
