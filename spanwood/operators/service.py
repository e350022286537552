"""Owners, budgets, contexts, change replays, text diffs and other operators that serve users of the graph."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import diff
from ..functions import text as X
from .search import bm25, fuse, nearest
from .traverse import importer_files, neighbours
from . import joins as J

Rules = list[tuple[str, list[str]]]


# owners


def owner_rules(text: str) -> Rules:
    """Rules (pattern, owners) of an owners file: a pattern and its owners on each line; blank lines and those after # don't count."""
    parts = (line.split() for line in text.splitlines() if line.strip() and not line.strip().startswith("#"))
    return [(p[0], p[1:]) for p in parts if len(p) > 1]


def _owner_pattern(pattern: str) -> tuple[str, str]:
    """A regex for the whole path, in which * and ? stay in a folder, and the prefix that matches too."""
    plain = pattern.removeprefix("/")
    glob = re.escape(plain).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return rf"^(?:{glob})\z", plain.removesuffix("/")


def owners_of(path: Column, rules: Rules) -> Column:
    """Owners of a path by the last rule that fits; an empty array without any. The rules are a literal list."""
    out = F.array().cast("array<string>")
    for pattern, owners in rules:
        glob, prefix = _owner_pattern(pattern)
        out = F.when(path.rlike(glob) | path.startswith(prefix), F.array(*map(F.lit, owners))).otherwise(out)
    return out


def owner_summary(files: DataFrame, rules: Rules) -> DataFrame:
    """(owner, files) of files(path); the owner null stands for files without any."""
    return files.select(F.explode_outer(owners_of(F.col("path"), rules)).alias("owner")).groupBy("owner").agg(F.count(F.lit(1)).alias("files"))


# budgets


def byte_chunks(files: DataFrame, budget: int) -> DataFrame:
    """files(path, size) with `chunk`: largest first, a chunk is closed by the first file that would exceed the budget.

    Files of one size are alike, so the walk from the largest down runs over the counts of sizes (as many rows as there
    are sizes, 2 ** 20 at most for source files); files then take their places by their rank within their size.
    """
    spark = files.sparkSession
    plan, chunk, used = [], -1, budget + 1
    for size, n in sorted((tuple(r) for r in files.groupBy("size").count().collect()), reverse=True):
        left = max(0, (budget - used) // size) if size and used <= budget else n if used <= budget else 0
        each = max(1, budget // size) if size else n
        plan.append((size, left, chunk, each))
        if n > left:
            rest = n - left
            chunk += -(-rest // each)
            used = ((rest - 1) % each + 1) * size
        else:
            used += n * size
    planned = spark.createDataFrame(plan, "size long, left long, at long, each long")
    # ranks within a size by hash buckets, so that a common size passes no single task
    dealt = files.withColumn("__b", F.pmod(F.xxhash64("path"), F.lit(64)))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("size").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("size", "__b").agg(F.count(F.lit(1)).alias("__n")).select("size", "__b", before.alias("__start"))
    ranked = dealt.withColumn("__k", F.row_number().over(Window.partitionBy("size", "__b").orderBy("path")) - 1).join(starts, ["size", "__b"])
    rank = F.col("__start") + F.col("__k")
    placed = ranked.join(F.broadcast(planned), "size")  # one row for each size
    return placed.select("path", "size", F.when(rank < F.col("left"), F.col("at")).otherwise(F.col("at") + 1 + F.floor((rank - F.col("left")) / F.col("each"))).alias("chunk"))


# contexts


@dataclass(frozen=True)
class Template:
    """What a context of one purpose holds: graph depth, tokens, results, least score, kinds of edges, sections (title, lines, priority)."""

    depth: int
    tokens: int
    results: int
    least: float
    kinds: tuple[str, ...]
    sections: tuple[tuple[str, int, int], ...]


#: Fixed values.
TEMPLATES = {
    "understand_function": Template(1, 4000, 15, 0.15, ("calls", "called_by", "uses_type", "defines"), (("Target Function", 80, 10), ("Called Functions", 40, 7), ("Callers", 40, 6), ("Type Definitions", 30, 5), ("Related Constants", 20, 3))),
    "change_impact": Template(2, 6000, 25, 0.1, ("calls", "called_by", "implements", "extends", "dataflow"), (("Target Symbol", 60, 10), ("Direct Callers", 50, 9), ("Indirect Callers", 30, 6), ("Implementations", 40, 8), ("Data Flow Sources", 30, 5))),
    "debug_trace": Template(2, 5000, 20, 0.12, ("calls", "dataflow", "handles_error"), (("Entry Point", 60, 10), ("Call Chain", 40, 9), ("Data Flow", 30, 8), ("Error Handling", 30, 7))),
    "explore_module": Template(1, 5000, 20, 0.15, ("contains", "imports", "uses_type"), (("Module Overview", 40, 9), ("Public API", 50, 10), ("Internal Helpers", 30, 5), ("Dependencies", 30, 6))),
    "general": Template(1, 4000, 15, 0.2, ("calls", "called_by", "uses_type"), (("Relevant Code", 60, 10), ("Related Symbols", 40, 7), ("Context", 30, 5))),
}


def template(name: str) -> Template:
    """The template of that name, or the general one."""
    return TEMPLATES.get(name, TEMPLATES["general"])


def anchors(texts: DataFrame, query: str, most: int = 3) -> DataFrame:
    """(id) of the best full-text hits, from which a graph expansion starts."""
    return bm25(texts, query, most).select("id")


def context(texts: DataFrame, vectors: DataFrame, edges: DataFrame, query: str, vector: list[float], name: str = "general") -> DataFrame:
    """(id, score, source) of the hits of full text, vectors and the graph around the best hits, fused by rank."""
    t = template(name)
    sources = {
        "bm25": bm25(texts, query, t.results),
        "semantic": nearest(vectors, vector, t.results).filter(F.col("score") >= t.least).select("id", "score"),
        "graph": neighbours(edges, anchors(texts, query), t.depth, kinds=list(t.kinds)).select("id", "score"),
    }
    return fuse(sources, limit=t.results)


def labelled(file: Column, line: Column, name: Column, text: Column) -> Column:
    """One hit as text to read: a heading with its place and name, then its text."""
    return F.concat(F.lit("### "), file, F.lit(":"), line.cast("string"), F.lit(" "), name, F.lit("\n"), F.coalesce(text, F.lit("")))


# imports


def resolved_import(path: Column, file: Column, aliases: list[tuple[str, str]], workspaces: list[str], exists) -> tuple[Column, Column]:
    """Where an import path of a file leads, and how sure: an alias (1.0), a relative path (1.0), a workspace (0.8), itself (0.5).

    aliases are (regex with one group, folder); workspaces are folders; `exists` says of a path whether it is known.
    """
    where, sure = path, F.lit(0.5)
    for folder in reversed(workspaces):
        inside = F.concat(F.lit(folder.rstrip("*").rstrip("/") + "/"), path)
        where, sure = F.when(exists(inside), inside).otherwise(where), F.when(exists(inside), 0.8).otherwise(sure)
    relative = path.startswith(".") | path.startswith("/")
    where, sure = F.when(relative, X.folded(F.concat_ws("/", X.directory(file), path))).otherwise(where), F.when(relative, 1.0).otherwise(sure)
    for pattern, folder in reversed(aliases):
        fits = path.rlike(pattern)
        where = F.when(fits, X.folded(F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_extract(path, pattern, 1)))).otherwise(where)
        sure = F.when(fits, 1.0).otherwise(sure)
    return where, sure


#: Extensions to try, in order, then the same after /index.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".go", ".py", ".rs", ".java", ".cs", ".php", ".rb")


def possible_files(path: Column) -> Column:
    return F.array(*[F.concat(path, F.lit(e)) for e in EXTENSIONS], *[F.concat(path, F.lit("/index" + e)) for e in EXTENSIONS])


# changes


def changed_files(lines: DataFrame) -> DataFrame:
    """(file, change) of a diff's name and status lines(value): added, modified, deleted; a rename deletes one path and adds another."""
    p = F.split("value", "\t")
    status = F.substring(p[0], 1, 1)
    word = F.when(status == "A", "added").when(status == "M", "modified").when(status == "D", "deleted")
    one = lambda file, change: F.struct(file.alias("file"), change.alias("change"))
    found = F.when(status.isin("R", "C") & (F.size(p) > 2), F.array(F.when(status == "R", one(p[1], F.lit("deleted"))), one(F.get(p, F.lit(2)), F.lit("added"))))
    found = found.when(word.isNotNull() & (F.size(p) > 1), F.array(one(F.get(p, F.lit(1)), word)))
    return lines.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("c")).select("c.*")


def operation(name: Column) -> Column:
    """added, modified or deleted for the names that journals use, else null."""
    return F.when(name.isin("added", "create"), "added").when(name.isin("modified", "update"), "modified").when(name.isin("deleted", "remove"), "deleted")


def replayed(journal: DataFrame, known: DataFrame) -> DataFrame:
    """(path, change, old_hash) of journal(pos, path, operation): each path's last entry, with the hash known before."""
    named = journal.withColumn("change", operation(F.col("operation"))).filter("change IS NOT NULL")
    last = named.groupBy("path").agg(F.max_by("change", "pos").alias("change"))
    return last.join(known.select("path", F.col("hash").alias("old_hash")), "path", "left").withColumn("old_hash", F.when(F.col("change") != "added", F.col("old_hash")))


def write_set(nodes: DataFrame, edges: DataFrame, file: str, module: str, max_depth: int = 4) -> DataFrame:
    """(file) to build again when `file` changes: its importers, its neighbours, and files that import a module it may now stand for."""
    importers = importer_files(nodes, edges, file, max_depth).select("file")
    near = J.neighbour_files(edges, nodes, F.col("file") == file).select("file")
    return importers.union(near).union(J.importing_files(edges, nodes, module).select("file")).distinct()


def first_backups(changes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first change of each key: what a backup keeps."""
    return changes.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__k = 1").drop("__k")


def _diffs(old: pa.Array, new: pa.Array) -> pa.Array:
    # one pair of texts at a time leaves Arrow's memory
    rows = [diff.line_diff(a.as_py() or "", b.as_py() or "") for a, b in zip(old, new, strict=True)]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(),) * 3 + (pa.string(),))], ["equal", "insert", "delete", "hunks"])


def line_diff(old: Column, new: Column) -> Column:
    """struct (equal, insert, delete: lines; hunks: their lines after - and +) of two texts, by a shortest edit script; null is empty."""
    return F.arrow_udf(_diffs, "equal long, insert long, delete long, hunks string")(old, new)


# words for people

#: Fixed values.
ROLE_TEXTS = {
    "entry": "Entry point - high fan-out, initiates operations", "core": "Core component - high connectivity, central to system", "utility": "Utility - moderate connectivity, helper functions",
    "adapter": "Adapter - connects external systems, high fan-out", "dead": "Dead code - no references, can be removed", "test-only": "Test-only - only referenced by tests", "leaf": "Leaf node - low fan-out, terminal operations",
}
RISK_TEXTS = {
    "low": "Low risk - safe to modify", "medium": "Medium risk - verify changes don't break callers", "high": "High risk - many components depend on this", "critical": "Critical risk - changes will impact many components",
}


def described(key: Column, texts: dict[str, str], unknown: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])[key], F.lit(unknown))
