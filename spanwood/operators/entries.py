"""Entry points by their names, and the processes that start there."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .steps import cut, discard

# fixed values: names of entry points in any language, and by extension
ANY = r"^(main|init|bootstrap|start|run|setup|configure)$ ^[Hh]andle[A-Z_] ^[Oo]n[A-Z_] [Hh]andler$ [Cc]ontroller$ ^[Pp]rocess[A-Z_] ^[Ee]xecute[A-Z_] ^[Pp]erform[A-Z_] ^[Dd]ispatch[A-Z_] ^[Ss]erve[A-Z_]".split()
_C = r"^main$ ^(handle|on|process|execute|dispatch|run|serve)_ _(handler|callback|hook|listener)$".split()
_JS = r"^(handle|on)[A-Z_] _(handler|middleware|controller|route|action)$ ^(handleRequest|middleware|handler|route|action|controller)$ ^(get|post|put|delete|patch)[A-Z]".split()
_JSX = r"^(handle|on)[A-Z_] _(handler|action)$".split()
BY_EXTENSION = {
    ".py": r"^(handle|on|view|endpoint|dispatch|process|execute|perform|serve|run|get|post|put|delete|patch)_ _(handler|view|endpoint|controller)$ ^do_(get|post|put|delete|patch|request|handle) ^(wsgi_app|asgi_app|application)$".split(),
    ".java": r"^do(Get|Post|Put|Delete|Patch|Head|Options|Filter|Forward|Handle|Process|Execute|Run) ^(handle|process|execute|perform|dispatch|serve|run)[A-Z] (Controller|Handler|Servlet|Endpoint|Action|Service)$ ^(main|init|destroy|service)$".split(),
    ".rs": r"^(main|run|start|serve|handle|execute|process|dispatch)$ ^(handle|process|execute|dispatch|serve|run)_ _(handler|controller|service|endpoint)$".split(),
    ".rb": r"^(handle|on|process|execute|perform|dispatch|serve|call|run)_ _(handler|controller|action)$ ^(index|show|create|update|destroy|new|edit|call)$ ^(handle|perform|execute|process|run)$".split(),
    ".php": r"^(handle|process|execute|dispatch|invoke|run|call)$ ^(handle|process|execute|dispatch|on)[A-Z_] ^__invoke$ (Controller|Handler|Action|Middleware)$ ^(index|show|store|update|destroy|create|edit)$".split(),
    ".c": _C,
    ".cpp": [*_C, "^(Handle|Process|Execute|Dispatch|Run|Serve)[A-Z]"],
    ".cc": _C,
    ".cxx": _C,
    ".cs": r"^(Handle|Process|Execute|Dispatch|Run|Serve|Perform)[A-Z] ^On[A-Z] (Controller|Handler|Middleware|Action|Command)$ ^(Main|Run|Start|Execute|Invoke|Handle)$ ^(Get|Post|Put|Delete|Patch)[A-Za-z]".split(),
    ".js": _JS,
    ".ts": [*_JS, "(Controller|Handler|Middleware|Resolver|Guard)$"],
    ".jsx": _JSX,
    ".tsx": _JSX,
}
#: Fixed value: what marks a file of tests.
TESTS = r"_test\.|\.test\.|\.spec\."


def universal(name: Column) -> Column:
    """Whether a name is that of an entry point in any language."""
    return name.rlike("|".join(ANY))


def of_language(name: Column, file: Column) -> Column:
    """Whether a name is that of an entry point in its file's language; false in others."""
    ext, out = X.extension(file), F.lit(False)
    for e, patterns in BY_EXTENSION.items():
        out = F.when(ext == e, name.rlike("|".join(patterns))).otherwise(out)
    return out


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, file, score) of functions and methods that call something and score above 0.

    The score is callees over callers plus one; 1 more if exported, 2 for a universal name, 1.5 for one of its language,
    5 less in a file of tests.
    """
    calls = edges.filter("kind = 'calls'")
    out_n = calls.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("callees"))
    in_n = calls.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    some = nodes.filter(F.col("kind").isin("function", "method")).join(out_n, "id").join(in_n, "id", "left")
    bonus = [(F.col("exported"), 1.0), (universal(F.col("name")), 2.0), (of_language(F.col("name"), F.col("file")), 1.5), (F.col("file").rlike(TESTS), -5.0)]
    score = F.col("callees") / (F.coalesce("callers", F.lit(0)) + 1)
    for condition, value in bonus:
        score = score + F.when(condition, value).otherwise(0.0)
    return some.select("id", "name", "file", F.round(score, 8).alias("score")).filter("score > 0")


def _onward(branching: int):
    def run(traces: pd.Series, steps: pd.Series) -> pd.Series:
        """Each trace with the new callees of its last level: nodes in turn take their first ones that are not yet in it."""
        out = []
        for trace, found in zip(traces, steps, strict=True):
            trace, met = list(trace), set(trace)
            for step in sorted(found, key=lambda s: s["place"]):
                new = [c for c in step["callees"] if c not in met][:branching]
                met.update(new)
                trace += new
            out.append(trace)
        return pd.Series(out)

    return F.pandas_udf(run, "array<bigint>")


def processes(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None, max_depth: int = 10, branching: int = 4, least_steps: int = 3, most: int = 75) -> DataFrame:
    """(process, label, type, steps, entry, terminal, score, trace) of the `most` best entry points whose trace has enough steps.

    A trace goes breadth first along calls between functions; each node in turn adds up to `branching` callees, the least
    ids first, that the trace does not have yet. Entries go by score, ties by id, in waves until `most` are found or none is
    left. The label names the first three; the process is named after its entry. With communities(id, community), the type
    says whether a trace stays in one. A wave's state is one row for each entry; a level is one join for all of them.
    """
    functions = nodes.filter(F.col("kind").isin("function", "method")).select("id", "name")
    calls = edges.filter("kind = 'calls'").select("source_id", "target_id").distinct().join(functions.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    callees = cut(calls.groupBy(F.col("source_id").alias("node")).agg(F.array_sort(F.collect_list("target_id")).alias("callees")))
    ranked = cut(entry_points(nodes, edges))
    found, n, after, size = None, 0, None, 2 * most
    while n < most:
        rest = ranked if after is None else ranked.filter((F.col("score") < after["score"]) | ((F.col("score") == after["score"]) & (F.col("id") > after["id"])))
        wave = cut(rest.orderBy(F.desc("score"), "id").limit(size))
        after = wave.orderBy("score", F.desc("id")).first()
        if after is None:
            break
        traced = _traces(wave, callees, max_depth, branching).filter(F.size("trace") >= least_steps)
        found = traced if found is None else found.unionByName(traced)
        n, size = n + traced.count(), 2 * size
    if found is None:
        found = ranked.withColumn("trace", F.array("id")).limit(0)
    best = found.orderBy(F.desc("score"), "id").limit(most)
    named = best.select("id", F.posexplode("trace").alias("place", "node")).join(functions.withColumnRenamed("id", "node").withColumnRenamed("name", "step"), "node")
    if communities is not None:
        named = named.join(communities.select(F.col("id").alias("node"), "community"), "node", "left")
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") < 3, F.struct("place", "step")))), lambda s: s["step"]), " → ")
    kinds = F.when(F.count_distinct("community") > 1, "cross_community").otherwise("intra_community") if communities is not None else F.lit("unknown")
    said = named.groupBy("id").agg(first.alias("first"), kinds.alias("type"))
    steps = F.size("trace")
    label = F.concat("first", F.when(steps > 3, F.format_string(" (+%d)", steps - 3)).otherwise(""))
    process = F.concat(F.lit("proc_"), F.substring(F.regexp_replace("name", "[^a-zA-Z0-9_]", "_"), 1, 30), F.lit("_"), F.col("id"))
    return best.join(said, "id").select(process.alias("process"), label.alias("label"), "type", steps.alias("steps"), F.col("id").alias("entry"), F.element_at("trace", -1).alias("terminal"), "score", "trace")


def _traces(wave: DataFrame, callees: DataFrame, max_depth: int, branching: int) -> DataFrame:
    """wave(id, name, file, score) with its trace."""
    state = cut(wave.select("*", F.array("id").alias("trace"), F.lit(0).alias("upto")))
    for _ in range(max_depth):
        level = state.select("id", F.posexplode(F.slice("trace", F.col("upto") + 1, F.greatest(F.size("trace") - F.col("upto"), F.lit(0)))).alias("place", "node")).join(callees, "node")
        steps = level.groupBy("id").agg(F.collect_list(F.struct("place", "callees")).alias("found"))
        joined = state.join(steps, "id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<place:int,callees:array<bigint>>>")))
        before, state = state, cut(joined.select("id", "name", "file", "score", _onward(branching)("trace", "found").alias("trace"), F.size("trace").alias("upto")))
        done = state.filter(F.size("trace") > F.col("upto")).isEmpty()
        discard(before)
        if done:
            break
    return state.drop("upto")
