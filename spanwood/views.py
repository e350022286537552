"""Graph-shaped views over the star-schema tables, in Spark and, word for word alike, as SQL for the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.steps import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Symbols, made from part: id, name, kind, file, line, end_line, exported, qualified_name, scope, docstring."""
    return table(spark, d, "part").selectExpr(
        "p_partkey AS id",
        "p_name AS name",
        "CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'method' ELSE 'function' END AS kind",
        "concat(p_brand, '/', p_type, '/', CASE WHEN p_partkey % 11 = 0 THEN 'unit_test' ELSE cast(p_size % 7 AS string) END, '.go') AS file",
        "p_size AS line",
        "CAST(p_size + p_partkey % 9 AS INT) AS end_line",
        "p_partkey % 3 = 0 AS exported",
        "concat(p_brand, '.', p_name) AS qualified_name",
        "p_brand AS scope",
        "CASE WHEN p_partkey % 4 > 0 THEN concat(p_type, ' part of ', p_brand) END AS docstring",
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Relations between symbols, from the first and last line of urgent orders: source_id, target_id, kind."""
    first, last = F.min(F.struct("l_linenumber", "l_partkey")), F.max(F.struct("l_linenumber", "l_partkey"))
    ends = table(spark, d, "lineitem").groupBy("l_orderkey").agg(first["l_partkey"].alias("s"), last["l_partkey"].alias("t"))
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderstatus")
    kind = F.expr("CASE WHEN o_orderstatus = 'P' THEN 'imports' WHEN o_orderkey % 17 = 0 THEN 'implements' WHEN o_orderkey % 19 = 0 THEN 'extends' ELSE 'calls' END")
    return ends.join(urgent, F.col("l_orderkey") == F.col("o_orderkey")).filter("s <> t").select(F.col("s").alias("source_id"), F.col("t").alias("target_id"), kind.alias("kind")).distinct()


def dense_edges(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring lines of each order as source_id, target_id."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source_id"), F.lead("l_partkey").over(w).alias("target_id"))
    return pairs.filter("target_id IS NOT NULL AND source_id <> target_id").distinct()


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Containment of regions, nations, suppliers and customers: id, parent_id."""
    part = lambda name, expr: table(spark, d, name).selectExpr(*expr)
    return (
        part("region", ["concat('r', r_regionkey) id", "cast(null AS string) parent_id"])
        .unionByName(part("nation", ["concat('n', n_nationkey) id", "concat('r', n_regionkey) parent_id"]))
        .unionByName(part("supplier", ["concat('s', s_suppkey) id", "concat('n', s_nationkey) parent_id"]))
        .unionByName(part("customer", ["concat('c', c_custkey) id", "concat('n', c_nationkey) parent_id"]))
    )


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits of suppliers as files: sha, file, epoch."""
    o = table(spark, d, "orders").selectExpr("o_orderkey AS sha", "unix_timestamp(cast(o_orderdate AS timestamp)) AS epoch")
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey AS sha", "l_suppkey AS file")
    return dealt(lines, lines.count(), "sha").join(o, "sha").select("sha", "file", "epoch").distinct()


def manifest(spark: SparkSession, d: str, new: bool) -> DataFrame:
    """A file manifest of documents before or after changes: path, mtime, size, hash."""
    docs = table(spark, d, "documents")
    if not new:
        return docs.filter("doc_id % 10 < 9").selectExpr("doc_id AS path", "doc_id % 1000 AS mtime", "n_chars AS size", "md5(coalesce(text, '')) AS hash")
    text = "CASE WHEN doc_id % 7 = 0 THEN concat(coalesce(text, ''), '!') ELSE coalesce(text, '') END"
    return docs.filter("doc_id % 10 > 0").selectExpr("doc_id AS path", "CASE WHEN doc_id % 7 = 0 OR doc_id % 13 = 0 THEN doc_id % 1000 + 5 ELSE doc_id % 1000 END AS mtime", "CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS size", f"md5({text}) AS hash")


KINDS = ("if_statement", "for_statement", "switch_statement", "return_statement", "break_statement", "try_statement", "block", "call_expression", "assignment", "update_expression", "parameter", "expression_statement")


def ast(spark: SparkSession, d: str) -> DataFrame:
    """Rows of syntax trees, from lines of orders as functions: fn, pos, id, kind, name, text, line."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = dealt(lines, lines.count(), "l_orderkey").withColumn("pos", F.row_number().over(w) - 1)
    kind = F.array(*map(F.lit, KINDS))[(F.col("l_partkey") % len(KINDS)).cast("int")]
    rows = rows.select(F.col("l_orderkey").alias("fn"), "pos", (F.col("l_orderkey") * 100 + F.col("pos")).alias("id"), kind.alias("kind"), F.expr("concat('v', l_partkey % 7)").alias("name"), "l_suppkey", F.col("l_linenumber").alias("line"))
    text = F.expr("""CASE kind WHEN 'call_expression' THEN concat(name, '(v1, g(v2, v3), [v4, v5])') WHEN 'assignment' THEN concat(name, ' = v', l_suppkey % 7, ' + 1')
      WHEN 'return_statement' THEN concat('return v', l_suppkey % 7, ' + 3x') WHEN 'update_expression' THEN concat(name, CASE l_suppkey % 5 WHEN 0 THEN '++' WHEN 1 THEN '--' WHEN 2 THEN ' += 2' WHEN 3 THEN ' *= 3' ELSE ' := 1' END) ELSE concat(kind, ' ', name) END""")
    return rows.select("fn", "pos", "id", "kind", "name", text.alias("text"), "line")


def code_files(spark: SparkSession, d: str) -> DataFrame:
    """Source files, from parts of a brand as definitions: path, language, text."""
    lines = F.expr("""concat(
      CASE WHEN p_partkey % 7 = 0 THEN concat('from mod', p_partkey % 25, ' import f', p_partkey + 1, ', f', p_partkey + 2, '\\n') ELSE '' END,
      CASE WHEN p_partkey % 5 = 0 THEN concat('class C', p_partkey, CASE WHEN p_partkey > 25 THEN concat('(C', p_partkey - 25, ')') ELSE '' END, ':\\n    size = ', p_size)
        ELSE concat('def ', CASE WHEN p_partkey % 3 = 0 THEN '_' ELSE '' END, 'f', p_partkey, '(a, b):\\n    return f', p_partkey + 5, '(a) + g(b)') END)""")
    parts = table(spark, d, "part").select(F.col("p_brand"), F.col("p_partkey"), lines.alias("code"))
    files = parts.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "code"))), lambda x: x["code"]), "\n").alias("text"))
    return files.select(F.concat(F.lit("src/mod"), F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit(".py")).alias("path"), F.lit("python").alias("language"), "text")


SQL: dict[str, str] = {
    "syntax": """SELECT l_orderkey fn, CAST(pos AS INTEGER) pos, l_orderkey * 100 + pos id, kind, name, CASE kind WHEN 'call_expression' THEN name || '(v1, g(v2, v3), [v4, v5])' WHEN 'assignment' THEN name || ' = v' || l_suppkey % 7 || ' + 1'
      WHEN 'return_statement' THEN 'return v' || l_suppkey % 7 || ' + 3x' WHEN 'update_expression' THEN name || CASE l_suppkey % 5 WHEN 0 THEN '++' WHEN 1 THEN '--' WHEN 2 THEN ' += 2' WHEN 3 THEN ' *= 3' ELSE ' := 1' END ELSE kind || ' ' || name END AS text, l_linenumber line, l_suppkey sup
      FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 pos, """ + repr(list(KINDS)) + """[CAST(l_partkey % 12 + 1 AS INTEGER)] kind, 'v' || l_partkey % 7 AS name FROM lineitem)""",
    "g_nodes": """SELECT p_partkey id, p_name AS name, CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'method' ELSE 'function' END kind,
      p_brand || '/' || p_type || '/' || CASE WHEN p_partkey % 11 = 0 THEN 'unit_test' ELSE CAST(p_size % 7 AS VARCHAR) END || '.go' AS file, p_size line,
      CAST(p_size + p_partkey % 9 AS INTEGER) end_line, p_partkey % 3 = 0 exported, p_brand || '.' || p_name qualified_name, p_brand AS scope,
      CASE WHEN p_partkey % 4 > 0 THEN p_type || ' part of ' || p_brand END docstring FROM part""",
    "g_edges": """SELECT DISTINCT s source_id, t target_id, CASE WHEN o_orderstatus = 'P' THEN 'imports' WHEN o_orderkey % 17 = 0 THEN 'implements' WHEN o_orderkey % 19 = 0 THEN 'extends' ELSE 'calls' END kind
      FROM (SELECT l_orderkey, min_by(l_partkey, (l_linenumber, l_partkey)) s, max_by(l_partkey, (l_linenumber, l_partkey)) t FROM lineitem GROUP BY 1)
      JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND s <> t""",
    "g_dense": """SELECT DISTINCT source_id, target_id FROM (SELECT l_partkey source_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) target_id FROM lineitem)
      WHERE target_id IS NOT NULL AND source_id <> target_id""",
    "g_tree": """SELECT 'r' || r_regionkey id, CAST(NULL AS VARCHAR) parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
      UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer""",
    "commits": "SELECT DISTINCT l_orderkey sha, l_suppkey AS file, CAST(epoch(o_orderdate) AS BIGINT) epoch FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "manifest_old": "SELECT doc_id AS path, doc_id % 1000 mtime, n_chars size, md5(coalesce(text, '')) hash FROM documents WHERE doc_id % 10 < 9",
    "manifest_new": """SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 OR doc_id % 13 = 0 THEN doc_id % 1000 + 5 ELSE doc_id % 1000 END mtime, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END size,
      md5(CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) hash FROM documents WHERE doc_id % 10 > 0""",
}


def with_views(body: str) -> str:
    """The SQL with the views that it names in front."""
    used = [f"{name} AS MATERIALIZED ({sql})" for name, sql in SQL.items() if name in body]
    if not used:
        return body
    head, rest = ("WITH RECURSIVE ", body.lstrip()[len("WITH RECURSIVE ") :]) if body.lstrip().startswith("WITH RECURSIVE ") else ("WITH ", body.lstrip()[5:] if body.lstrip().startswith("WITH ") else None)
    return head + ", ".join(used) + (", " + rest if rest is not None else " " + body)


View = Callable[[SparkSession, str], DataFrame]
