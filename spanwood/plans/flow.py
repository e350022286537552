"""Queries on control flow, data flow and definitions in source code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..functions import text as X
from ..operators import flow as W
from ..sources import files as I
from .registry import query

Spark = SparkSession

_OPENS = "('if_statement', 'for_statement', 'switch_statement', 'try_statement')"
_ENDS = "('return_statement', 'break_statement')"
_BLOCKS = f"""m AS (SELECT *, CASE WHEN kind IN {_OPENS} OR coalesce(lag(kind) OVER (PARTITION BY fn ORDER BY pos) IN {_ENDS}, true) THEN 1 ELSE 0 END b FROM syntax), n AS (SELECT *, CAST(sum(b) OVER (PARTITION BY fn ORDER BY pos) - 1 AS INTEGER) idx FROM m),
  blk AS (SELECT fn, idx, CASE arg_min(kind, pos) WHEN 'if_statement' THEN 'condition' WHEN 'for_statement' THEN 'loop' WHEN 'switch_statement' THEN 'switch' WHEN 'try_statement' THEN 'try' ELSE 'statement' END AS type, arg_min(line, pos) start_line, arg_max(line, pos) end_line FROM n GROUP BY fn, idx)"""
_EDGES = """nn AS (SELECT fn, max(idx) n FROM blk GROUP BY fn), raw AS (
  SELECT fn, idx source, idx + 1 target, CASE type WHEN 'condition' THEN 'true' WHEN 'loop' THEN 'enter' ELSE 'sequential' END kind FROM blk WHERE type NOT IN ('switch', 'return', 'break', 'continue', 'throw')
  UNION ALL SELECT fn, idx + 1, idx, 'loop' FROM blk JOIN nn USING (fn) WHERE type = 'loop' AND idx < n
  UNION ALL SELECT fn, idx, idx + 2, 'exit' FROM blk WHERE type = 'loop'
  UNION ALL SELECT x.fn, x.idx, coalesce((SELECT min(y.idx) FROM blk y WHERE y.fn = x.fn AND y.idx > x.idx AND y.type = 'block' AND NOT EXISTS (SELECT 1 FROM blk z WHERE z.fn = x.fn AND z.type = 'condition' AND z.idx > x.idx AND z.idx < y.idx)), x.idx + 2), 'false' FROM blk x WHERE x.type = 'condition'
  UNION ALL SELECT x.fn, x.idx, y.idx, 'case' FROM blk x JOIN blk y ON y.fn = x.fn AND y.type = 'case' AND y.idx > x.idx AND NOT EXISTS (SELECT 1 FROM blk z WHERE z.fn = x.fn AND z.type <> 'case' AND z.idx > x.idx AND z.idx < y.idx) WHERE x.type = 'switch'),
  edge AS (SELECT raw.fn, source, target, kind FROM raw JOIN nn USING (fn) WHERE target <= n)"""


def _blocks(spark: Spark, d: str) -> DataFrame:
    return W.blocks(V.ast(spark, d))


@query(f"WITH {_BLOCKS} SELECT fn, idx, type, start_line, end_line FROM blk")
def gr31_flow_blocks(spark: Spark, d: str) -> DataFrame:
    return _blocks(spark, d)


@query(f"WITH {_BLOCKS}, {_EDGES} SELECT fn, source, target, kind FROM edge")
def gr31_flow_edges(spark: Spark, d: str) -> DataFrame:
    return W.flow_edges(_blocks(spark, d))


@query(f"""WITH RECURSIVE {_BLOCKS}, {_EDGES}, r(fn, idx) AS (SELECT fn, 0 FROM blk WHERE idx = 0 UNION SELECT r.fn, target FROM r JOIN edge e ON e.fn = r.fn AND e.source = r.idx), a AS (SELECT fn, count(*) "blocks" FROM blk GROUP BY fn), b AS (SELECT fn, count(*) "edges" FROM edge GROUP BY fn), c AS (SELECT fn, count(*) reachable FROM r GROUP BY fn)
  SELECT fn, "blocks", coalesce("edges", 0) "edges", greatest(coalesce("edges", 0) - "blocks" + 2, 1) cyclomatic, reachable, "blocks" - reachable unreachable FROM a LEFT JOIN b USING (fn) JOIN c USING (fn)""")
def gr32_flow_metrics(spark: Spark, d: str) -> DataFrame:
    b = _blocks(spark, d)
    return W.flow_metrics(b, W.flow_edges(b))


_TYPED = "blk AS (SELECT fn, pos idx, CASE kind WHEN 'if_statement' THEN 'condition' WHEN 'for_statement' THEN 'loop' WHEN 'switch_statement' THEN 'switch' WHEN 'return_statement' THEN 'return' WHEN 'break_statement' THEN 'break' WHEN 'try_statement' THEN 'try' WHEN 'block' THEN 'block' WHEN 'expression_statement' THEN 'case' ELSE 'statement' END AS type FROM syntax)"


@query(f"WITH {_TYPED}, {_EDGES} SELECT fn, source, target, kind FROM edge")
def rm11_else_and_cases(spark: Spark, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == "expression_statement", "case").otherwise(W.block_type(F.col("kind")))
    return W.flow_edges(V.ast(spark, d).select("fn", F.col("pos").alias("idx"), kind.alias("type")))


@query("SELECT fn, CAST(pos - 1 AS INTEGER) source, pos target, 'sequential' kind FROM syntax WHERE pos > 0")
def rm16_linear_flow(spark: Spark, d: str) -> DataFrame:
    return W.linear_flow(V.ast(spark, d))[1]


@query("""SELECT fn, 'parameter' family, name, CAST(row_number() OVER (PARTITION BY fn ORDER BY pos) - 1 AS VARCHAR) detail, line FROM syntax WHERE kind = 'parameter'
  UNION ALL SELECT fn, 'return', '', 'return v' || sup % 7, line FROM syntax WHERE kind = 'return_statement' UNION ALL SELECT fn, 'assignment', name, ' v' || sup % 7 || ' + 1', line FROM syntax WHERE kind = 'assignment'
  UNION ALL SELECT fn, 'argument', name, i || ':' || ['v1', 'g(v2, v3)', '[v4, v5]'][CAST(i + 1 AS INTEGER)], line FROM syntax, range(3) r(i) WHERE kind = 'call_expression'
  UNION ALL SELECT fn, 'mutation', name, ['increment', 'decrement', 'increment', 'multiply', 'unknown'][CAST(sup % 5 + 1 AS INTEGER)], line FROM syntax WHERE kind = 'update_expression'""")
def rm10_extracted(spark: Spark, d: str) -> DataFrame:
    a = V.ast(spark, d)
    row = lambda df, family, name, detail: df.select("fn", F.lit(family).alias("family"), name.alias("name"), detail.cast("string").alias("detail"), "line")
    out = row(W.parameters(a), "parameter", F.col("name"), F.col("index"))
    out = out.unionByName(row(W.returns(a), "return", F.lit(""), F.array_join("names", " ")))
    out = out.unionByName(row(W.assignments(a), "assignment", F.col("name"), F.col("source")))
    out = out.unionByName(row(W.argument_flows(a), "argument", F.col("callee"), F.concat("index", F.lit(":"), "argument")))
    return out.unionByName(row(W.mutations(a), "mutation", F.col("name"), F.col("change")))


@query("""WITH n AS (SELECT fn, name, arg_max(id, pos) node FROM syntax GROUP BY 1, 2)
  SELECT s.fn, s.fn source_id, node target_id, CASE kind WHEN 'update_expression' THEN 'mutation' ELSE kind END kind, line, CASE kind WHEN 'parameter' THEN 0.9 ELSE 0.95 END::DOUBLE confidence FROM syntax s JOIN n USING (fn, name) WHERE kind IN ('parameter', 'assignment', 'update_expression')
  UNION ALL SELECT s.fn, node, s.fn, 'return', line, 0.9::DOUBLE FROM syntax s JOIN n ON n.fn = s.fn AND n.name = 'v' || sup % 7 WHERE kind = 'return_statement'
  UNION ALL SELECT s.fn, a.node, c.node, 'arg_flow', line, 0.85::DOUBLE FROM syntax s JOIN n c ON c.fn = s.fn AND c.name = s.name JOIN n a ON a.fn = s.fn AND a.name = 'v1' WHERE kind = 'call_expression'""")
def gr38_dataflow(spark: Spark, d: str) -> DataFrame:
    return W.dataflow_edges(V.ast(spark, d))


@query("SELECT page_id id, array_to_string(list_filter(regexp_extract_all(coalesce(html, ''), '[A-Za-z0-9_]+'), lambda w: NOT regexp_matches(w, '^[0-9]')), ' ') names FROM pages")
def fn18_identifiers(spark: Spark, d: str) -> DataFrame:
    return V.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.array_join(X.identifiers(F.coalesce("html", F.lit(""))), " ").alias("names"))


# source files; the checks know from the parts what the files hold

_PARTS = "pp AS (SELECT p_partkey k, 'src/mod' || regexp_extract(p_brand, '([0-9]+)', 1) || '.py' AS path, p_partkey % 7 = 0 imp, p_partkey % 5 = 0 cls, p_partkey % 3 = 0 hidden, CAST(sum(CASE WHEN p_partkey % 7 = 0 THEN 3 ELSE 2 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) line, CAST(sum(CASE WHEN p_partkey % 7 = 0 THEN 3 ELSE 2 END) OVER (PARTITION BY p_brand) AS INTEGER) total FROM part)"
_DEFS = f"""{_PARTS}, named AS (SELECT *, CASE WHEN cls THEN 'C' || k WHEN hidden THEN '_f' || k ELSE 'f' || k END AS name FROM pp)"""


@query(f"WITH {_DEFS} SELECT path AS file, line, CAST(coalesce(lead(line) OVER (PARTITION BY path ORDER BY line) - 1, total) AS INTEGER) end_line, CASE WHEN cls THEN 'class' ELSE 'function' END kind, name, cls OR NOT hidden exported, CASE WHEN cls OR NOT hidden THEN 'public' ELSE 'private' END visibility FROM named")
def sc16_definitions(spark: Spark, d: str) -> DataFrame:
    return I.definitions(V.code_files(spark, d)).drop("parent")


@query(f"WITH {_DEFS} SELECT path AS file, CAST(line + 1 AS INTEGER) line, unnest(['f' || (k + 5), 'g']) AS name FROM named WHERE NOT cls")
def sc17_calls(spark: Spark, d: str) -> DataFrame:
    return I.calls(V.code_files(spark, d))


@query(f"WITH {_DEFS} SELECT path AS file, CAST(line - 1 AS INTEGER) line, 'mod' || k % 25 AS source, unnest(['f' || (k + 1), 'f' || (k + 2)]) symbol FROM named WHERE imp")
def sc17_imports(spark: Spark, d: str) -> DataFrame:
    return I.imports(V.code_files(spark, d))


@query(f"WITH {_DEFS} SELECT path AS file, line, name AS class, 'extends' relation, 'C' || (k - 25) AS base FROM named WHERE cls AND k > 25")
def sc17_bases(spark: Spark, d: str) -> DataFrame:
    return I.bases(V.code_files(spark, d))


@query(f"""WITH {_DEFS}, d AS (SELECT path || ':' || name AS id, path, name, cls FROM named), raw AS (
  SELECT path AS source, path || ':' || name AS target, 'contains' kind, 1.0::DOUBLE confidence FROM named
  UNION ALL SELECT path || ':' || name, (SELECT min(id) FROM d WHERE d.name = 'C' || (k - 25)), 'extends', 1.0::DOUBLE FROM named WHERE cls AND k > 25
  UNION ALL SELECT path, (SELECT id FROM d WHERE d.path = 'src/mod' || k % 25 || '.py' AND d.name = s), 'imports', 0.9::DOUBLE FROM (SELECT path, k, unnest(['f' || (k + 1), 'f' || (k + 2)]) s FROM named WHERE imp)
  UNION ALL SELECT path || ':' || name, coalesce((SELECT id FROM d WHERE d.path = n.path AND d.name = 'f' || (n.k + 5)), (SELECT min(id) FROM d WHERE d.name = 'f' || (n.k + 5))), 'calls', 1.0::DOUBLE FROM named n WHERE NOT cls)
  SELECT DISTINCT source, target, kind, confidence FROM raw WHERE target IS NOT NULL""")
def gr33_built_edges(spark: Spark, d: str) -> DataFrame:
    return I.code_edges(V.code_files(spark, d))


@query("SELECT '.py' ext, 'python' AS language, count(DISTINCT p_brand) n FROM part")
def sc18_languages(spark: Spark, d: str) -> DataFrame:
    return V.code_files(spark, d).groupBy(X.extension(F.col("path")).alias("ext"), X.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'src/mod' || regexp_extract(p_brand, '([0-9]+)', 1) || '.py' AS path FROM part WHERE NOT regexp_matches(p_brand, '#1[0-9]?$') GROUP BY p_brand")
def fn02_excluded(spark: Spark, d: str) -> DataFrame:
    return V.code_files(spark, d).filter(~I.excluded(F.col("path"), ["src/**", "!mod*", "mod1*.py"])).select("path")


@query("SELECT id, name FROM g_nodes WHERE regexp_matches(name, '^b.* b.lt$') OR name LIKE 'green %'")
def fn01_globs(spark: Spark, d: str) -> DataFrame:
    return V.nodes(spark, d).filter(F.col("name").rlike(X.glob_to_regex("b* b?lt")) | F.col("name").rlike(X.glob_to_regex("green *"))).select("id", "name")


@query("SELECT 'c' || l_orderkey sha, l_orderkey * 60 epoch, 'f' || l_suppkey AS file FROM lineitem GROUP BY l_orderkey, l_suppkey")
def sc19_commit_log(spark: Spark, d: str) -> DataFrame:
    lines = F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("f"), "l_suppkey"))), "\n")
    log = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(lines.alias("files")).select(F.concat_ws("\n", F.concat(F.lit("c"), "l_orderkey"), (F.col("l_orderkey") * 60).cast("string"), "files", F.lit("")).alias("value"))
    return I.commit_log(log)
