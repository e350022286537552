"""Queries on source trees: which files count, what they define, and what is not parsed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..functions import text as X
from ..operators.steps import fresh_dir
from ..sources import extract as E
from ..sources import ignore as G
from ..sources.cache import ParseCache
from .registry import query

Spark = SparkSession

# a tree of paths, one for each part, under four layers of rules

_PATH = """concat('p', p_partkey div 50, '/', element_at(array('src', 'vendor', 'node_modules', 'docs', 'build', 'lib'), cast(p_partkey % 6 AS int) + 1), '/', element_at(array('gen', 'tmp', 'a', 'dist', 'core'), cast(p_partkey % 5 AS int) + 1), '/',
  element_at(array('main', 'keep', 'x.min', 'go', 'util.secret', 'app', 'old'), cast(p_partkey % 7 AS int) + 1), CASE WHEN p_partkey % 7 = 2 THEN '.js' ELSE concat(p_partkey, element_at(array('.go', '.py', '.js', '.log', '.md', '.ts'), cast(p_partkey % 11 % 6 AS int) + 1)) END) AS path"""
_PATH_SQL = """'p' || p_partkey // 50 || '/' || ['src', 'vendor', 'node_modules', 'docs', 'build', 'lib'][p_partkey % 6 + 1] d1, ['gen', 'tmp', 'a', 'dist', 'core'][p_partkey % 5 + 1] d2,
  ['main', 'keep', 'x.min', 'go', 'util.secret', 'app', 'old'][p_partkey % 7 + 1] || CASE WHEN p_partkey % 7 = 2 THEN '.js' ELSE p_partkey || ['.go', '.py', '.js', '.log', '.md', '.ts'][p_partkey % 11 % 6 + 1] END f"""
IGNORES = [
    ("", "own", "# what the project says\n!vendor/\n*.secret*\n"),
    ("p1", "own", "!node_modules/\n!x.min.js\n"),
    ("", "git", "*.log\n!keep*.log\ntmp/\np2/src/\nold[0-4]*.ts\n"),
    ("p0", "git", "/docs/\ngen/\n!src/gen/\n"),
    ("p3/src", "git", "**/core/*.py\n/a/**\n"),
    ("p2/src/a", "git", "!*\n"),
]


@query(f"""WITH t AS (SELECT {_PATH_SQL}, p_size * 20000 size FROM part), s AS (SELECT *, split_part(d1, '/', 1) top, split_part(d1, '/', 2) kind FROM t)
  SELECT d1 || '/' || d2 || '/' || f AS path, CASE WHEN f LIKE '%.go' THEN 'go' WHEN f LIKE '%.py' THEN 'python' WHEN f LIKE '%.js' THEN 'javascript' ELSE 'typescript' END AS language, size FROM s
  WHERE regexp_matches(f, '[.](go|py|js|ts)$') AND size <= 1048576 AND kind <> 'build' AND (kind <> 'node_modules' OR top = 'p1') AND d2 NOT IN ('dist', 'tmp') AND f NOT LIKE '%.secret%' AND (f <> 'x.min.js' OR top = 'p1')
    AND NOT (top = 'p2' AND kind = 'src') AND NOT regexp_matches(f, '^old[0-4].*[.]ts$') AND NOT (top = 'p0' AND kind = 'docs') AND NOT (top = 'p0' AND d2 = 'gen' AND kind <> 'src')
    AND NOT (top = 'p3' AND kind = 'src' AND (d2 = 'a' OR (d2 = 'core' AND f LIKE '%.py'))) AND NOT (kind = 'lib' AND d2 = 'core')""")
def sc15_collected(spark: Spark, d: str) -> DataFrame:
    files = V.table(spark, d, "part").selectExpr(_PATH, "p_size * 20000 AS size")
    return G.collected(files, spark.createDataFrame(IGNORES, "folder string, layer string, text string"), exclude=["**/lib/core"])


# sources whose strings and comments look like code, some lines for each part

_PYTHON = """# def c{k}(): class Fake:
class C{k}(Base{b}, mod.Other):
    '''class D{k}: def e{k}(): pass
def broken(:'''
    def m{k}(self):
        s = "def n{k}(): z({k})"
        return f{k}(s)  # call z{k}()
def f{k}(a,
        b=")"):
    return C{k}().m{k}()
"""
_GO = """// func c{k}() {
type C{k} struct {
\ta string // }
}
/* func d{k}() { */
func (c *C{k}) m{k}(s string) string {
\tx := "func e{k}() {" + `}}
func g{k}() {`
\treturn f{k}(x)
}
"""
_TS = """// class Fake{k} {
export class C{k} extends Base{b} implements Other {
  m{k}(s: string) { // }
    return f{k}(`}${s}
  class D{k} {`);
  }
}
export function f{k}(a = "{") {
  return "function g{k}() {" + new C{k}().m{k}(a);
}
"""
_LINES = 10


def _filled(text: str) -> str:
    """The text as a Spark expression in p_partkey, with its number in each file."""
    quoted = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t")
    return f"replace(replace('{quoted}', '{{k}}', cast(p_partkey AS string)), '{{b}}', cast(p_partkey % 3 AS string))"


def trapped(spark: Spark, d: str) -> DataFrame:
    """(path, language, text): files of 25 parts each, in three languages by turns."""
    lang = "element_at(array('python', 'go', 'typescript'), cast(p_partkey div 25 % 3 AS int) + 1)"
    code = f"CASE p_partkey div 25 % 3 WHEN 0 THEN {_filled(_PYTHON)} WHEN 1 THEN {_filled(_GO)} ELSE {_filled(_TS)} END"
    parts = V.table(spark, d, "part").selectExpr("p_partkey", f"{lang} AS language", f"{code} AS code", "concat('src/m', p_partkey div 25, element_at(array('.py', '.go', '.ts'), cast(p_partkey div 25 % 3 AS int) + 1)) AS path")
    each = parts.groupBy("path", "language").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "code"))).alias("c"))
    return each.select("path", "language", F.array_join("c.code", "").alias("text"))


_PARTS = f"""pp AS (SELECT p_partkey k, p_partkey // 25 % 3 lang, 'src/m' || p_partkey // 25 || ['.py', '.go', '.ts'][p_partkey // 25 % 3 + 1] AS file, CAST({_LINES} * (row_number() OVER (PARTITION BY p_partkey // 25 ORDER BY p_partkey) - 1) AS INTEGER) o FROM part),
  defs AS (SELECT file, 'class' kind, 'C' || k AS name, o + 2 AS line, o + [7, 4, 7][lang + 1] end_line, CAST(NULL AS VARCHAR) parent, true exported FROM pp
    UNION ALL SELECT file, 'method', 'm' || k, o + [5, 6, 3][lang + 1], o + [7, 10, 6][lang + 1], 'C' || k, lang = 0 FROM pp
    UNION ALL SELECT file, 'function', 'f' || k, o + 8, o + 10, NULL, true FROM pp WHERE lang <> 1)"""


@query(f"WITH {_PARTS} SELECT * FROM defs")
def sc17_lexed_definitions(spark: Spark, d: str) -> DataFrame:
    return E.unnested(E.parsed(trapped(spark, d)), "definitions")


@query(f"""WITH {_PARTS} SELECT file, 'f' || k AS name, CAST(NULL AS VARCHAR) receiver, o + [7, 9, 4][lang + 1] AS line, 'm' || k AS caller FROM pp
  UNION ALL SELECT file, 'C' || k, NULL, o + [10, 0, 9][lang + 1], 'f' || k FROM pp WHERE lang <> 1 UNION ALL SELECT file, 'm' || k, '()', o + [10, 0, 9][lang + 1], 'f' || k FROM pp WHERE lang <> 1""")
def sc17_lexed_calls(spark: Spark, d: str) -> DataFrame:
    return E.unnested(E.parsed(trapped(spark, d)), "calls")


@query(f"""WITH {_PARTS} SELECT file, 'C' || k AS class, 'extends' relation, 'Base' || k % 3 AS base, o + 2 AS line FROM pp WHERE lang <> 1
  UNION ALL SELECT file, 'C' || k, CASE lang WHEN 0 THEN 'extends' ELSE 'implements' END, CASE lang WHEN 0 THEN 'mod.Other' ELSE 'Other' END, o + 2 FROM pp WHERE lang <> 1""")
def sc17_lexed_bases(spark: Spark, d: str) -> DataFrame:
    return E.unnested(E.parsed(trapped(spark, d)), "bases")


@query(f"WITH {_PARTS}, n AS (SELECT count(DISTINCT file) files, count(DISTINCT file) FILTER (k // 25 % 4 = 0) changed FROM pp) SELECT file, count(*) definitions, any_value(changed) parsed_again FROM defs, n GROUP BY file")
def sc16_cached_parse(spark: Spark, d: str) -> DataFrame:
    """The definitions of each file by a second run, before which a quarter of the files changed; and how many that run parsed."""
    files, cache = trapped(spark, d), ParseCache(spark, fresh_dir(spark))
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    cache.parse(files.withColumn("text", F.when(number % 4 == 0, F.concat("text", F.lit("\n// before"))).otherwise(F.col("text"))))
    rows, parsed = cache.parse(files)
    return rows.select("file", F.size("definitions").cast("long").alias("definitions"), F.lit(parsed).cast("long").alias("parsed_again"))
