"""The calls below a symbol in the order of a depth-first walk, as a sequence diagram shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .steps import cut

#: Nodes whose callees one job looks up ahead of the walk.
AHEAD = 256
MESSAGES = "step int, depth int, from_file string, to_file string, function string, line int, truncated boolean"


def call_sequence(nodes: DataFrame, edges: DataFrame, entry: int, max_depth: int = 10, most: int = 1000, no_tests: bool = False, kind: str | None = None, files: list[str] | None = None) -> DataFrame:
    """(step, depth, from_file, to_file, function, line, truncated): the first `most` messages of the walk from a node.

    A node is entered once, where the walk first meets it at a depth below `max_depth`; its callees follow by id, and each is
    a message whether or not it is entered. Callees in tests, of another kind, or in files that hold none of `files` are left
    out with all below them. `truncated` is on every row: the walk met the depth or the number of messages. An unknown entry,
    or one without callees, has no rows.

    A diagram is a report for people, so the walk itself is on the driver; what it holds is bounded by `most`: at most so
    many callees of a node, of AHEAD nodes a look-up. Each look-up is a filter on a table that is sorted by node, for the
    node that is due and those that are due next, so there are far fewer look-ups than nodes.
    """
    spark = nodes.sparkSession
    kept = nodes.select(F.col("id").alias("target_id"), "name", "kind", "file", "line")
    if no_tests:
        kept = kept.filter(~F.col("file").rlike(r"_test\.|_spec\."))
    if kind:
        kept = kept.filter(F.col("kind") == kind)
    if files:
        kept = kept.filter(F.array_contains(F.array(*[F.contains("file", F.lit(f)) for f in files]), True))
    calls = edges.filter("kind = 'calls'").select("source_id", "target_id").distinct().join(kept, "target_id")
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("target_id"))
    calls = calls.withColumn("k", rank).filter(F.col("k") <= most + 1)
    table = calls.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("target_id", "name", "file", "line"))).alias("callees"))
    table = cut(table.repartitionByRange("source_id").sortWithinPartitions("source_id"))
    start = nodes.filter(F.col("id") == entry).select("file").first()
    known: dict[int, list] = {}
    out: list[tuple] = []
    seen, truncated = {entry}, False
    # open nodes with the callees that are still to come, the innermost last
    stack = [[entry, start["file"] if start else None, None, 0]] if start and max_depth > 0 else []
    while stack and len(out) <= most:
        node, file, at, depth = stack[-1]
        if at is None:
            if node not in known:
                due = [node] + [c["target_id"] for n, _, k, _ in reversed(stack[:-1]) for c in known[n][k:]]
                asked = list(dict.fromkeys(i for i in due if i not in known))[:AHEAD]
                found = {r["source_id"]: r["callees"] for r in table.filter(F.col("source_id").isin(asked)).collect()}
                known |= {i: found.get(i, []) for i in asked}
            at = stack[-1][2] = 0
        if at == len(known[node]):
            stack.pop()
            continue
        stack[-1][2] += 1
        callee = known[node][at]
        out.append((len(out) + 1, depth + 1, file, callee["file"], callee["name"], callee["line"]))
        if depth + 1 >= max_depth:
            truncated = True
        elif callee["target_id"] not in seen:
            seen.add(callee["target_id"])
            stack.append([callee["target_id"], callee["file"], None, depth + 1])
    truncated = truncated or len(out) > most
    return spark.createDataFrame([(*row, truncated) for row in out[:most]], MESSAGES)
