"""Scans, point lookups, filters and writes on nodes, edges and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Node kinds and edge kinds that each level of a graph view shows.
LEVELS: dict[str, tuple[list[str], list[str]]] = {
    "structure": (["class", "interface", "struct", "module"], ["contains", "imports"]),
    "class": (["class", "interface", "struct"], ["extends", "implements", "contains"]),
    "function": (["function", "method"], ["calls"]),
    "full": ([], []),
    "no-calls": ([], ["imports", "extends", "implements", "contains"]),
    "minimal": (["class", "interface"], ["extends", "implements"]),
}


def all_rows(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*order)


def where(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal each given value; None is left out, a list means any of it."""
    conditions = [F.col(k).isin(v) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in equal.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def page(df: DataFrame, order: list, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sorted rows from offset on, at most limit. The order should be total."""
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def name_like(nodes: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Nodes whose name holds the text, % and _ in it as wildcards, letters in either case; an empty name is any."""
    return page(nodes.filter(F.col("name").ilike(f"%{name}%")), ["id"], limit)


def name_ranked(nodes: DataFrame, name: str, limit: int) -> DataFrame:
    """Nodes holding the name: exact ones first, then prefixes, then the rest, each by name and id."""
    n, low = F.lower("name"), name.lower()
    rank = F.when(n == low, 0).when(n.startswith(low), 1).otherwise(2)
    return nodes.filter(F.col("name").ilike(f"%{name}%")).withColumn("rank", rank).orderBy("rank", "name", "id").limit(limit)


def connected_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at either end of an edge."""
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    return nodes.join(ends, "id", "left_semi")


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def graph_view(nodes: DataFrame, edges: DataFrame, level: str, connected: bool = False) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that a level shows; edges keep to the nodes shown."""
    node_kinds, edge_kinds = LEVELS[level]
    n, e = where(nodes, kind=node_kinds or None), where(edges, kind=edge_kinds or None)
    e = within(e, n)
    return (connected_only(n, e) if connected else n), e


def path_pattern(pattern: str) -> Column:
    """A file filter: a glob with * or ? is matched whole, anything else as a part of the path."""
    from ..functions.text import glob_to_regex

    return F.col("file").rlike(glob_to_regex(pattern)) if set("*?") & set(pattern) else F.col("file").contains(pattern)


#: Three notions of a test file, as parts of the lower-cased path.
TEST_FILES = {
    "search": r"_test\.|test_|\.test\.|\.spec\.|/tests?/|__tests__",
    "context": r"_test\.|\.test\.|\.spec\.|__tests__|/test/|/tests/",
    "symbols": r"test|spec",
}


def is_test_file(variant: str = "search") -> Column:
    return F.lower("file").rlike(TEST_FILES[variant])


def web_label(kind: Column) -> Column:
    """A display label of a node kind."""
    names = ["function", "method", "class", "interface", "struct", "enum", "module", "variable", "constant", "type"]
    return F.coalesce(*[F.when(kind == k, k.capitalize()) for k in names], F.lit("CodeElement"))


def web_type(kind: Column) -> Column:
    """A display type of an edge kind."""
    return F.when(kind == "imports-type", "IMPORTS").otherwise(F.upper(kind))


def relative_path(path: Column, root: str) -> Column:
    """The path below the root, or as it is if it lies elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def folders(files: DataFrame) -> DataFrame:
    """All folders above the files: path, depth."""
    parts = F.split("file", "/", -1)
    ups = files.select("file").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path"))
    return ups.distinct().withColumn("depth", F.size(F.split("path", "/", -1)))


def insert_missing(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """old, with those new rows whose key it lacks; of new rows with one key, the first in the order."""
    first = new.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__r = 1").drop("__r")
    return old.unionByName(first.join(old.select(*key).distinct(), key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """old, with rows of new in place of those with their keys; of new rows with one key, the last in the order."""
    last = new.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))).filter("__r = 1").drop("__r")
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def delete_nodes(nodes: DataFrame, edges: DataFrame, files: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of the files, and edges without those that lose an end."""
    kept = nodes.filter(~F.col("file").isin(files))
    return kept, within(edges, kept)


def set_column(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """df with the column's new values where updates(key, column) has the key."""
    new = updates.select(key, F.col(column).alias("__new"), F.lit(True).alias("__hit"))
    return df.join(new, key, "left").withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))).drop("__new", "__hit")
