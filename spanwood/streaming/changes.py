"""Change detection between file manifests, and what a change set means for the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detect(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change, old_hash, new_hash, old_size, new_size of manifests (path, mtime, size, hash).

    added, removed, modified (hashes differ), touched (only the time differs), unchanged.
    """
    o = old.select(F.col("path").alias("p"), *[F.col(c).alias(f"old_{c}") for c in ("mtime", "size", "hash")])
    n = new.select("path", *[F.col(c).alias(f"new_{c}") for c in ("mtime", "size", "hash")])
    j = n.join(o, F.col("path") == F.col("p"), "full_outer")
    change = F.when(F.col("p").isNull(), "added").when(F.col("path").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified").when(F.col("old_mtime") != F.col("new_mtime"), "touched").otherwise("unchanged")
    return j.select(F.coalesce("path", "p").alias("path"), change.alias("change"), "old_hash", "new_hash", "old_size", "new_size")


def candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose time or size differs or that are new: the only ones whose content need be hashed."""
    o = old.select("path", F.col("mtime").alias("m"), F.col("size").alias("s"))
    return new.join(o, "path", "left").filter(F.col("m").isNull() | (F.col("m") != F.col("mtime")) | (F.col("s") != F.col("size"))).select("path")


def summary(changes: DataFrame) -> DataFrame:
    """Number of paths and change of size in bytes, by kind of change."""
    grown = F.coalesce("new_size", F.lit(0)) - F.coalesce("old_size", F.lit(0))
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum(grown).alias("grown"))


def changed(changes: DataFrame) -> DataFrame:
    """Paths to build anew."""
    return changes.filter(F.col("change").isin("added", "modified")).select("path")


def needs_rebuild(changes: DataFrame, most: int = 500) -> DataFrame:
    """Whether more than `most` paths were added, modified or removed."""
    n = F.count(F.when(F.col("change").isin("added", "modified", "removed"), 1))
    return changes.agg(n.alias("n_changed"), (n > most).alias("rebuild"))
