"""Contexts from ranked hits: sections of a template, each within its share of a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .service import template

# fixed values: what sections hold; others hold what is general
SECTIONS = {
    "targets": "Target Function,Target Symbol,Entry Point,Module Overview,Relevant Code,Public API".split(","),
    "callees": "Called Functions,Call Chain".split(","),
    "callers": "Callers,Direct Callers,Indirect Callers".split(","),
    "types": "Type Definitions,Implementations".split(","),
    "dataflow": "Data Flow,Data Flow Sources".split(","),
    "imports": "Dependencies".split(","),
}
TYPES = ("type", "interface", "struct", "class", "enum")
CUT, TRIMMED = "// ... (truncated)", "\n// ... (budget trimmed)"


def category(source: Column, kind: Column, depth: Column) -> Column:
    """What a hit is to its query, by where it was found."""
    onward = (kind == "function") & (depth > 0)
    graph = source.contains("graph")
    return (
        F.when((depth == 0) & source.isin("semantic_desc", "semantic_code", "keyword"), "targets")
        .when(graph & (source.contains("called_by") | onward), "callers")
        .when(graph & source.contains("calls"), "callees")
        .when(kind.isin(*TYPES), "types")
        .when(source.contains("dataflow"), "dataflow")
        .when(source.contains("import") | source.contains("contains"), "imports")
        .otherwise("general")
    )


def _tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("int")


def _item(most: Column) -> Column:
    """A hit's header and at most `most` lines of its content."""
    header = F.format_string("// %s:%d %s (%s)\n", F.col("file"), F.col("line"), F.col("name"), F.col("kind"))
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    shown = F.when(F.size(lines) > most, F.concat(F.slice(lines, F.lit(1), most), F.array(F.lit(CUT)))).otherwise(lines)
    return F.when(F.coalesce("content", F.lit("")) == "", header).otherwise(F.concat(header, F.array_join(shown, "\n"), F.lit("\n")))


def assembled(hits: DataFrame, name: str, budget: int | None = None, pass_on: bool = False) -> DataFrame:
    """(query, place, title, content, tokens, priority) of each query's hits(query, rank, file, line, name, kind, source, depth, content).

    A hit has one category; a section takes its category's hits by rank, each file and line once, and the general ones if
    it has none. Sections are served by priority, ties in the template's order. Each has a share of the budget in
    proportion to its priority, and no more than is left; one that is longer is cut to its share, at a character. With
    `pass_on`, what a section leaves of its share goes to the next. Nothing is left out while tokens are left. A budget of
    0 or less is none. Hits of a query are a top-k list; queries are as many as there are.
    """
    t = template(name)
    budget = t.tokens if budget is None else budget
    of = {title: c for c, titles in SECTIONS.items() for title in titles}
    spec = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(title).alias("title"), F.lit(lines).alias("lines"), F.lit(p).alias("priority"), F.lit(of.get(title, "general")).alias("wants")) for k, (title, lines, p) in enumerate(t.sections)])
    rows = hits.withColumn("category", category(F.col("source"), F.col("kind"), F.col("depth")))
    has = F.collect_set("category").over(Window.partitionBy("query"))
    each = rows.withColumn("has", has).withColumn("s", F.explode(spec))
    each = each.filter(F.col("category") == F.when(F.array_contains("has", F.col("s.wants")), F.col("s.wants")).otherwise("general"))
    first = F.row_number().over(Window.partitionBy("query", "s.k", "file", "line").orderBy("rank"))
    items = each.withColumn("turn", first).filter("turn = 1").select("query", "s", "rank", _item(F.col("s.lines")).alias("item"))
    sections = items.groupBy("query", "s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]), "\n").alias("content"))
    served = F.array_sort(F.collect_list(F.struct((-F.col("s.priority")).alias("order"), F.col("s.k").alias("k"), F.col("s.title").alias("title"), "content", _tokens(F.col("content")).alias("tokens"), F.col("s.priority").alias("priority"))))
    each = sections.groupBy("query").agg(served.alias("all"), F.sum("s.priority").cast("int").alias("total"))

    def step(acc: Column, s: Column) -> Column:
        own = F.floor(F.lit(budget) * s["priority"] / F.col("total")).cast("int")
        share = F.least(own + (acc["spare"] if pass_on else F.lit(0)), acc["left"])
        head = F.regexp_replace(F.make_valid_utf8(F.substring(s["content"].cast("binary"), F.lit(1), share * 4).cast("string")), "\ufffd+$", "")
        content = F.when(s["tokens"] <= share, s["content"]).otherwise(F.concat(head, F.lit(TRIMMED)))
        tokens = _tokens(content)
        taken = F.struct(s["title"].alias("title"), content.alias("content"), tokens.alias("tokens"), s["priority"].alias("priority"))
        return F.when(acc["left"] <= 0, acc).otherwise(F.struct((acc["left"] - tokens).alias("left"), F.greatest(share - tokens, F.lit(0)).alias("spare"), F.concat(acc["out"], F.array(taken)).alias("out")))

    start = F.struct(F.lit(budget).alias("left"), F.lit(0).alias("spare"), F.array().cast("array<struct<title:string,content:string,tokens:int,priority:int>>").alias("out"))
    whole = F.transform("all", lambda s: F.struct(s["title"].alias("title"), s["content"].alias("content"), s["tokens"].alias("tokens"), s["priority"].alias("priority")))
    out = F.aggregate("all", start, step)["out"] if budget > 0 else whole
    return each.select("query", F.posexplode(out).alias("place", "s")).select("query", "place", "s.*")
