"""Control flow and data flow from rows of syntax trees: ast(fn, pos, id, kind, name, text, line), `pos` from 0 in each function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .traverse import bfs

#: Types of blocks by kind of their first row, kinds that open a block and kinds that end one.
BLOCK_TYPES = {
    "condition": ("if_statement", "if"), "loop": ("for_statement", "for", "while_statement", "while"), "switch": ("switch_statement", "switch"), "return": ("return_statement", "return"),
    "break": ("break_statement", "break"), "continue": ("continue_statement", "continue"), "try": ("try_statement", "try"), "catch": ("catch_clause", "catch"), "throw": ("throw_statement", "throw"),
    "entry": ("function_definition", "function_declaration", "method_declaration"), "block": ("block", "compound_statement"),
}
OPENING = tuple(k for t in ("condition", "loop", "switch", "try", "entry") for k in BLOCK_TYPES[t])
ENDING = tuple(k for t in ("return", "break", "continue", "throw") for k in BLOCK_TYPES[t])
#: How sure each kind of data flow is.
SURE = {"parameter": 0.9, "assignment": 0.95, "return": 0.9, "arg_flow": 0.85, "mutation": 0.95}


def block_type(kind: Column) -> Column:
    out = F.lit("statement")
    for name, kinds in BLOCK_TYPES.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def blocks(ast: DataFrame) -> DataFrame:
    """(fn, idx, type, start_line, end_line): a row that opens a block begins one, as does any row after one that ends it."""
    w = Window.partitionBy("fn").orderBy("pos")
    begins = F.col("kind").isin(*OPENING) | F.coalesce(F.lag("kind").over(w).isin(*ENDING), F.lit(True))
    marked = ast.withColumn("begins", begins)
    numbered = marked.withColumn("idx", F.sum(F.col("begins").cast("int")).over(w).cast("int") - 1)
    first, last = F.min_by(F.struct("kind", "line"), "pos"), F.max_by("line", "pos")
    each = numbered.groupBy("fn", "idx").agg(first.alias("first"), last.alias("end_line"))
    kind = F.when(F.col("first.kind").isin(*OPENING), block_type(F.col("first.kind"))).otherwise("statement")
    return each.select("fn", "idx", kind.alias("type"), F.col("first.line").alias("start_line"), "end_line")


def else_block(w) -> Column:
    """The next block of type `block` with no condition before it, or null."""
    after = w.rowsBetween(1, Window.unboundedFollowing)
    place = F.min(F.when(F.col("type") == "block", F.col("idx"))).over(after)
    other = F.min(F.when(F.col("type") == "condition", F.col("idx"))).over(after)
    return F.when(other.isNull() | (place < other), place)


def flow_edges(blocks: DataFrame) -> DataFrame:
    """(fn, source, target, kind) between blocks: true and false, enter, loop and exit, case, or sequential."""
    w = Window.partitionBy("fn").orderBy("idx")
    n = F.max("idx").over(Window.partitionBy("fn"))
    nxt, over = F.when(F.col("idx") + 1 <= n, F.col("idx") + 1), F.when(F.col("idx") + 2 <= n, F.col("idx") + 2)
    # cases follow their switch without a gap
    other = F.min(F.when(F.col("type") != "case", F.col("idx"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = blocks.withColumns({"nxt": nxt, "over": over, "else": F.coalesce(else_block(w), over), "cases": F.coalesce(other, n + 1)})
    edge = lambda source, target, kind: F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"))
    i, nxt, over, no = (F.col(c) for c in ("idx", "nxt", "over", "else"))
    t = F.col("type")
    of_case = F.transform(F.when(F.col("cases") > i + 1, F.sequence(i + 1, F.col("cases") - 1)).otherwise(F.array().cast("array<int>")), lambda j: edge(i, j, "case"))
    out = (
        F.when(t == "condition", F.array(edge(i, nxt, "true"), edge(i, no, "false")))
        .when(t == "loop", F.array(edge(i, nxt, "enter"), edge(nxt, i, "loop"), edge(i, over, "exit")))
        .when(t == "switch", of_case)
        .when(t.isin("return", "break", "continue", "throw"), F.array().cast("array<struct<source:int,target:int,kind:string>>"))
        .otherwise(F.array(edge(i, nxt, "sequential")))
    )
    return rows.select("fn", F.explode(out).alias("e")).select("fn", "e.*").filter("source IS NOT NULL AND target IS NOT NULL")


def linear_flow(ast: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A block for each row (fn, idx, type, line, label), and an edge to each from the one before it."""
    w = Window.partitionBy("fn").orderBy("pos")
    rows = ast.select("fn", (F.row_number().over(w) - 1).alias("idx"), F.col("kind").alias("type"), "line", F.col("name").alias("label"))
    edges = rows.filter("idx > 0").select("fn", (F.col("idx") - 1).alias("source"), F.col("idx").alias("target"), F.lit("sequential").alias("kind"))
    return rows, edges


def flow_metrics(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, blocks, edges, cyclomatic, reachable, unreachable): edges less blocks and 2, at least 1; blocks reached from the first."""
    place = lambda i: F.struct(F.col("fn"), F.col(i).alias("i"))
    e = edges.select(place("source").alias("source_id"), place("target").alias("target_id"))
    met = bfs(e, blocks.filter("idx = 0").select(place("idx").alias("id"))).select("node.fn").groupBy("fn").agg(F.count(F.lit(1)).alias("reachable"))
    counts = blocks.groupBy("fn").agg(F.count(F.lit(1)).alias("blocks")).join(edges.groupBy("fn").agg(F.count(F.lit(1)).alias("edges")), "fn", "left").join(met, "fn", "left").fillna(0)
    return counts.select("fn", "blocks", "edges", F.greatest(F.col("edges") - F.col("blocks") + 2, F.lit(1)).alias("cyclomatic"), "reachable", (F.col("blocks") - F.col("reachable")).alias("unreachable"))


def parameters(ast: DataFrame) -> DataFrame:
    """(fn, name, index, line) of parameters, in order."""
    w = Window.partitionBy("fn").orderBy("pos")
    return ast.filter("kind = 'parameter'").select("fn", "name", (F.row_number().over(w) - 1).alias("index"), "line")


def returns(ast: DataFrame) -> DataFrame:
    """(fn, expression, names, line) of return statements, with the names that they hold."""
    return ast.filter("kind = 'return_statement'").select("fn", F.col("text").alias("expression"), X.identifiers(F.col("text")).alias("names"), "line")


def assignments(ast: DataFrame) -> DataFrame:
    """(fn, name, expression, source, line): source is the text after the first =."""
    return ast.filter("kind IN ('assignment', 'variable_declarator')").select("fn", "name", F.col("text").alias("expression"), X.source_text(F.col("text")).alias("source"), "line")


def argument_flows(ast: DataFrame) -> DataFrame:
    """(fn, callee, index, argument, line) of calls."""
    found = ast.filter("kind IN ('call_expression', 'function_call')").select("fn", F.col("name").alias("callee"), F.posexplode(X.call_arguments(F.col("text"))).alias("index", "argument"), "line")
    return found.select("fn", "callee", "index", "argument", "line")


def mutations(ast: DataFrame) -> DataFrame:
    """(fn, name, expression, change, line) of updates."""
    return ast.filter("kind IN ('update_expression', 'augmented_assignment')").select("fn", "name", F.col("text").alias("expression"), X.mutation(F.col("text")).alias("change"), "line")


def dataflow_edges(ast: DataFrame) -> DataFrame:
    """(fn, source_id, target_id, kind, line, confidence): flows between the function (id fn) and the last row of each name."""
    named = ast.groupBy("fn", "name").agg(F.max_by("id", "pos").alias("node"))
    to = lambda df, key, out: df.join(named.select("fn", F.col("name").alias(key), F.col("node").alias(out)), ["fn", key])
    flows = {
        "parameter": to(parameters(ast), "name", "t").select("fn", F.col("fn").alias("s"), "t", "line"),
        "assignment": to(assignments(ast), "name", "t").select("fn", F.col("fn").alias("s"), "t", "line"),
        "return": to(returns(ast).select("fn", "line", F.explode("names").alias("name")), "name", "s").select("fn", "s", F.col("fn").alias("t"), "line"),
        "arg_flow": to(to(argument_flows(ast), "callee", "t"), "argument", "s").select("fn", "s", "t", "line"),
        "mutation": to(mutations(ast), "name", "t").select("fn", F.col("fn").alias("s"), "t", "line"),
    }
    out = None
    for kind, df in flows.items():
        part = df.select("fn", F.col("s").alias("source_id"), F.col("t").alias("target_id"), F.lit(kind).alias("kind"), "line", F.lit(SURE[kind]).alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out
