"""Queries on lookups, filters, joins, aggregates, windows and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views as V
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import lookup as L
from .registry import query

NODE = ["id", "name", "kind", "file", "line", "exported"]
COLS = "id, name, kind, file, line, exported"
Spark = SparkSession


def _n(spark: Spark, d: str) -> DataFrame:
    return V.nodes(spark, d)


# scans and lookups


@query(f"SELECT {COLS} FROM g_nodes ORDER BY id")
def sc01_all_nodes(spark: Spark, d: str) -> DataFrame:
    return L.all_rows(_n(spark, d).select(*NODE), "id")


@query("SELECT source_id, target_id, kind FROM g_edges")
def sc01_all_edges(spark: Spark, d: str) -> DataFrame:
    return L.all_rows(V.edges(spark, d), "source_id", "target_id", "kind")


@query(f"SELECT {COLS} FROM g_nodes WHERE id = 42")
def sc02_node_by_id(spark: Spark, d: str) -> DataFrame:
    return L.where(_n(spark, d), id=42).select(*NODE).limit(1)


@query(f"SELECT {COLS} FROM g_nodes WHERE name ILIKE '%bolt%' ORDER BY id LIMIT 50")
def sc03_name_like(spark: Spark, d: str) -> DataFrame:
    return L.name_like(_n(spark, d), "bolt", 50).select(*NODE)


@query(f"SELECT {COLS} FROM g_nodes WHERE name = 'blue bolt'")
def sc04_name_exact(spark: Spark, d: str) -> DataFrame:
    return L.where(_n(spark, d), name="blue bolt").select(*NODE)


@query(f"SELECT {COLS} FROM g_nodes WHERE qualified_name = 'Brand#4.blue bolt'")
def sc04_qualified_name(spark: Spark, d: str) -> DataFrame:
    return L.where(_n(spark, d), qualified_name="Brand#4.blue bolt").select(*NODE)


@query(f"SELECT {COLS} FROM g_nodes WHERE file = 'Brand#4/SMALL/5.go' AND kind = 'method' ORDER BY line, id")
def sc05_by_file_and_kind(spark: Spark, d: str) -> DataFrame:
    return L.page(L.where(_n(spark, d), file="Brand#4/SMALL/5.go", kind="method"), ["line", "id"]).select(*NODE)


@query(f"SELECT {COLS} FROM g_nodes WHERE kind = 'class' ORDER BY file, line, id LIMIT 40 OFFSET 20")
def sc06_by_kind_paged(spark: Spark, d: str) -> DataFrame:
    return L.page(L.where(_n(spark, d), kind="class"), ["file", "line", "id"], 40, 20).select(*NODE)


@query(f"SELECT {COLS} FROM g_nodes WHERE exported ORDER BY file, line, id LIMIT 100")
def sc07_exported(spark: Spark, d: str) -> DataFrame:
    return L.page(L.where(_n(spark, d), exported=True), ["file", "line", "id"], 100).select(*NODE)


@query(f"SELECT {COLS} FROM g_nodes WHERE kind IN ('function', 'method') ORDER BY file, line, id LIMIT 100 OFFSET 10")
def sc08_functions(spark: Spark, d: str) -> DataFrame:
    return L.page(L.where(_n(spark, d), kind=["function", "method"]), ["file", "line", "id"], 100, 10).select(*NODE)


@query(f"SELECT {COLS} FROM g_nodes WHERE name = 'blue bolt' AND kind = 'method' AND file = 'Brand#4/SMALL/5.go' AND line = 5")
def sc09_unique_key(spark: Spark, d: str) -> DataFrame:
    return L.where(_n(spark, d), name="blue bolt", kind="method", file="Brand#4/SMALL/5.go", line=5).select(*NODE)


@query("SELECT * FROM g_edges WHERE kind = 'calls' ORDER BY source_id, target_id LIMIT 200 OFFSET 5")
def sc10_edges_by_kind(spark: Spark, d: str) -> DataFrame:
    return L.page(L.where(V.edges(spark, d), kind="calls"), ["source_id", "target_id"], 200, 5)


@query("SELECT * FROM g_edges WHERE source_id IN (1, 2, 3, 5, 8) UNION SELECT * FROM g_edges WHERE target_id IN (1, 2, 3, 5, 8)")
def sc10_edges_by_end(spark: Spark, d: str) -> DataFrame:
    e, ids = V.edges(spark, d), [1, 2, 3, 5, 8]
    return L.where(e, source_id=ids).union(L.where(e, target_id=ids)).distinct()


@query("SELECT DISTINCT file FROM g_nodes")
def sc11_files(spark: Spark, d: str) -> DataFrame:
    return _n(spark, d).select("file").distinct()


@query("SELECT * FROM manifest_old WHERE size > 100")
def sc12_manifest(spark: Spark, d: str) -> DataFrame:
    return V.manifest(spark, d, new=False).filter("size > 100")


@query("SELECT l_orderkey parent, l_linenumber line, l_returnflag kind, l_partkey FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 500 OFFSET 50")
def sc13_ast_rows_paged(spark: Spark, d: str) -> DataFrame:
    rows = V.table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return L.page(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 500, 50).select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("kind"), "l_partkey")


@query("SELECT source_id, target_id FROM g_dense WHERE source_id = 7 UNION ALL SELECT source_id, target_id FROM g_dense WHERE target_id = 7 AND source_id <> 7")
def sc14_dataflow_by_end(spark: Spark, d: str) -> DataFrame:
    e = V.dense_edges(spark, d)
    return e.filter("source_id = 7").unionByName(e.filter("target_id = 7 AND source_id <> 7"))


# filters and projections


@query(f"SELECT {COLS} FROM g_nodes WHERE kind IN ('class', 'function', 'method') AND kind NOT IN ('method')")
def fi01_kinds(spark: Spark, d: str) -> DataFrame:
    n = L.where(_n(spark, d), kind=["class", "function", "method"])
    return n.filter(~F.col("kind").isin(["method"])).select(*NODE)


@query("SELECT source_id, target_id, e.kind FROM g_edges e JOIN g_nodes a ON a.id = source_id JOIN g_nodes b ON b.id = target_id WHERE e.kind = 'calls' AND a.kind IN ('function', 'method') AND b.kind IN ('function', 'method')")
def fi02_level_function(spark: Spark, d: str) -> DataFrame:
    return L.graph_view(_n(spark, d), V.edges(spark, d), "function")[1].select("source_id", "target_id", "kind")


@query(f"SELECT {COLS} FROM g_nodes WHERE id IN (SELECT source_id FROM g_edges WHERE kind = 'imports' UNION SELECT target_id FROM g_edges WHERE kind = 'imports')")
def fi03_connected_only(spark: Spark, d: str) -> DataFrame:
    return L.connected_only(_n(spark, d), V.edges(spark, d).filter("kind = 'imports'")).select(*NODE)


@query("SELECT id, regexp_matches(lower(file), '_test\\.|test_|\\.test\\.|\\.spec\\.|/tests?/|__tests__') search, regexp_matches(lower(file), '_test\\.|\\.test\\.|\\.spec\\.|__tests__|/test/|/tests/') context, regexp_matches(lower(file), 'test|spec') symbols FROM g_nodes")
def fi04_test_files(spark: Spark, d: str) -> DataFrame:
    return _n(spark, d).select("id", *[L.is_test_file(k).alias(k) for k in L.TEST_FILES])


@query("SELECT id, file FROM g_nodes WHERE regexp_matches(file, '^Brand#1.*/4\\.go$') UNION SELECT id, file FROM g_nodes WHERE contains(file, 'PROMO/')")
def fi05_path_patterns(spark: Spark, d: str) -> DataFrame:
    n = _n(spark, d).select("id", "file")
    return n.filter(L.path_pattern("Brand#1*/4.go")).union(n.filter(L.path_pattern("PROMO/"))).distinct()


@query("SELECT * FROM (SELECT id, CAST(id * 7 % 100 AS DOUBLE) / 100 score, kind FROM g_nodes ORDER BY score DESC, id LIMIT 60) WHERE score >= 0.98 AND kind = 'function'")
def fi06_threshold_after_topk(spark: Spark, d: str) -> DataFrame:
    top = _n(spark, d).select("id", (F.col("id") * 7 % 100 / 100).alias("score"), "kind").orderBy(F.desc("score"), "id").limit(60)
    return top.filter("score >= 0.98 AND kind = 'function'")


@query(f"SELECT {COLS} FROM g_nodes WHERE scope = 'Brand#3' AND exported")
def fi07_optional_filters(spark: Spark, d: str) -> DataFrame:
    return L.where(_n(spark, d), scope="Brand#3", exported=True, kind=None).select(*NODE)


@query("""SELECT id, CASE kind WHEN 'class' THEN 'Class' WHEN 'interface' THEN 'Interface' WHEN 'method' THEN 'Method' WHEN 'function' THEN 'Function' ELSE 'CodeElement' END label FROM g_nodes""")
def fi08_labels(spark: Spark, d: str) -> DataFrame:
    return _n(spark, d).select("id", L.web_label(F.col("kind")).alias("label"))


@query("SELECT source_id, target_id, upper(kind) web_type FROM g_edges")
def fi08_types(spark: Spark, d: str) -> DataFrame:
    return V.edges(spark, d).select("source_id", "target_id", L.web_type(F.col("kind")).alias("web_type"))


@query("SELECT id, CASE WHEN starts_with(file, 'Brand#1/') THEN substr(file, 9) ELSE file END path FROM g_nodes")
def fi09_relative_paths(spark: Spark, d: str) -> DataFrame:
    return _n(spark, d).select("id", L.relative_path(F.col("file"), "Brand#1").alias("path"))


@query("SELECT DISTINCT path, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM (SELECT string_split(file, '/') p FROM g_nodes) t, LATERAL (SELECT unnest(list_transform(range(1, len(p)), lambda i: array_to_string(p[1:i], '/'))) path)")
def fi10_folders(spark: Spark, d: str) -> DataFrame:
    return L.folders(_n(spark, d))


# writes


@query(f"SELECT {COLS} FROM g_nodes WHERE id % 2 = 0 UNION ALL SELECT min(id), name, kind, file, line, bool_and(exported) FROM (SELECT * FROM g_nodes n WHERE NOT EXISTS (SELECT 1 FROM g_nodes m WHERE m.id % 2 = 0 AND (m.name, m.kind, m.file, m.line) = (n.name, n.kind, n.file, n.line))) GROUP BY name, kind, file, line HAVING count(*) = 1 UNION ALL SELECT id, name, kind, file, line, exported FROM (SELECT *, row_number() OVER (PARTITION BY name, kind, file, line ORDER BY id) r, count(*) OVER (PARTITION BY name, kind, file, line) c FROM (SELECT * FROM g_nodes n WHERE NOT EXISTS (SELECT 1 FROM g_nodes m WHERE m.id % 2 = 0 AND (m.name, m.kind, m.file, m.line) = (n.name, n.kind, n.file, n.line)))) WHERE r = 1 AND c > 1")
def sk01_insert_missing(spark: Spark, d: str) -> DataFrame:
    n = _n(spark, d).select(*NODE)
    return L.insert_missing(n.filter("id % 2 = 0"), n, ["name", "kind", "file", "line"], ["id"])


@query("SELECT path, size, hash FROM manifest_new UNION ALL SELECT path, size, hash FROM manifest_old WHERE path NOT IN (SELECT path FROM manifest_new)")
def sk02_upsert(spark: Spark, d: str) -> DataFrame:
    keep = ["path", "size", "hash"]
    return L.upsert(V.manifest(spark, d, new=False).select(*keep), V.manifest(spark, d, new=True).select(*keep), ["path"], ["hash"]).select(*keep)


@query("SELECT e.source_id, e.target_id, e.kind FROM g_edges e JOIN g_nodes a ON a.id = source_id JOIN g_nodes b ON b.id = target_id WHERE a.file NOT IN ('Brand#4/SMALL/5.go', 'Brand#1/PROMO/2.go') AND b.file NOT IN ('Brand#4/SMALL/5.go', 'Brand#1/PROMO/2.go')")
def sk03_cascade_delete(spark: Spark, d: str) -> DataFrame:
    return L.delete_nodes(_n(spark, d), V.edges(spark, d), ["Brand#4/SMALL/5.go", "Brand#1/PROMO/2.go"])[1].select("source_id", "target_id", "kind")


@query("SELECT id, CASE WHEN id % 6 = 0 THEN 'doc of ' || name ELSE docstring END docstring FROM g_nodes")
def sk04_set_column(spark: Spark, d: str) -> DataFrame:
    n = _n(spark, d).select("id", "docstring")
    new = _n(spark, d).filter("id % 6 = 0").select("id", F.concat(F.lit("doc of "), "name").alias("docstring"))
    return L.set_column(n, new, "id", "docstring")


# joins


@query("SELECT DISTINCT n.id, name FROM g_edges e JOIN g_nodes n ON n.id = source_id WHERE e.kind = 'calls' AND target_id IN (SELECT id FROM g_nodes WHERE file LIKE 'Brand#2/%')")
def jo01_callers(spark: Spark, d: str) -> DataFrame:
    return J.neighbours(_n(spark, d), V.edges(spark, d), _n(spark, d).filter("file LIKE 'Brand#2/%'"), "in", ["calls"]).select("id", "name")


@query("SELECT DISTINCT n.id, name FROM g_edges e JOIN g_nodes n ON n.id = target_id WHERE e.kind = 'calls' AND source_id IN (SELECT id FROM g_nodes WHERE file LIKE 'Brand#2/%')")
def jo01_callees(spark: Spark, d: str) -> DataFrame:
    return J.neighbours(_n(spark, d), V.edges(spark, d), _n(spark, d).filter("file LIKE 'Brand#2/%'"), "out", ["calls"]).select("id", "name")


@query("SELECT DISTINCT source_id, n.id, name FROM g_edges e JOIN g_nodes n ON n.id = target_id WHERE e.kind IN ('extends', 'implements')")
def jo02_inheritance(spark: Spark, d: str) -> DataFrame:
    return J.inheritance(_n(spark, d), V.edges(spark, d))


@query("""SELECT id, CAST(count(*) FILTER (b = 'extends') AS BIGINT) n_extends, CAST(count(*) FILTER (b = 'implements') AS BIGINT) n_implements, CAST(count(*) FILTER (b = 'extended_by') AS BIGINT) n_extended_by, CAST(count(*) FILTER (b = 'implemented_by') AS BIGINT) n_implemented_by FROM (
  SELECT DISTINCT source_id id, n.id other, CASE n.kind WHEN 'interface' THEN 'implements' ELSE 'extends' END b FROM g_edges e JOIN g_nodes n ON n.id = target_id WHERE e.kind IN ('extends', 'implements') AND n.kind IN ('class', 'interface')
  UNION ALL SELECT DISTINCT target_id, n.id, CASE n.kind WHEN 'interface' THEN 'implemented_by' ELSE 'extended_by' END FROM g_edges e JOIN g_nodes n ON n.id = source_id WHERE e.kind IN ('extends', 'implements') AND n.kind IN ('class', 'interface')) GROUP BY id""")
def jo03_inheritance_lists(spark: Spark, d: str) -> DataFrame:
    return J.inheritance_counts(_n(spark, d), V.edges(spark, d))


@query("SELECT source_id, target_id, e.kind, a.file source_file, b.file target_file FROM g_edges e JOIN g_nodes a ON a.id = source_id JOIN g_nodes b ON b.id = target_id")
def jo04_with_ends(spark: Spark, d: str) -> DataFrame:
    return J.with_ends(V.edges(spark, d), _n(spark, d), ["file"]).select("source_id", "target_id", "kind", "source_file", "target_file")


@query("SELECT DISTINCT b.file FROM g_edges JOIN g_nodes a ON a.id = source_id JOIN g_nodes b ON b.id = target_id WHERE a.file LIKE 'Brand#5/%' AND b.file NOT LIKE 'Brand#5/%' UNION SELECT DISTINCT a.file FROM g_edges JOIN g_nodes a ON a.id = source_id JOIN g_nodes b ON b.id = target_id WHERE b.file LIKE 'Brand#5/%' AND a.file NOT LIKE 'Brand#5/%'")
def jo05_neighbour_files(spark: Spark, d: str) -> DataFrame:
    return J.neighbour_files(V.edges(spark, d), _n(spark, d), F.col("file").like("Brand#5/%"))


@query("SELECT DISTINCT a.file FROM g_edges e JOIN g_nodes a ON a.id = source_id JOIN g_nodes b ON b.id = target_id WHERE e.kind = 'imports' AND b.qualified_name LIKE 'Brand#7.%'")
def jo06_importing_files(spark: Spark, d: str) -> DataFrame:
    return J.importing_files(V.edges(spark, d), _n(spark, d), "Brand#7.%")


@query("SELECT source_id, target_id, e.kind FROM g_edges e JOIN g_nodes a ON a.id = source_id JOIN g_nodes b ON b.id = target_id WHERE (a.scope = 'Brand#1' AND b.scope = 'Brand#2') OR (a.scope = 'Brand#2' AND b.scope = 'Brand#1')")
def jo07_edges_between(spark: Spark, d: str) -> DataFrame:
    n = _n(spark, d)
    return J.edges_between(V.edges(spark, d), n.filter("scope = 'Brand#1'"), n.filter("scope = 'Brand#2'"))


@query("SELECT source_id, target_id, kind FROM g_edges WHERE source_id IN (SELECT id FROM g_nodes WHERE scope = 'Brand#1') OR target_id IN (SELECT id FROM g_nodes WHERE scope = 'Brand#1')")
def jo08_edges_of_file(spark: Spark, d: str) -> DataFrame:
    return J.edges_touching(V.edges(spark, d), _n(spark, d).filter("scope = 'Brand#1'"))


@query(f"SELECT {COLS} FROM g_nodes WHERE kind IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.kind = 'calls' AND target_id = id)")
def jo09_uncalled(spark: Spark, d: str) -> DataFrame:
    return J.uncalled(_n(spark, d), V.edges(spark, d)).select(*NODE)


@query("SELECT id, name FROM g_nodes n LEFT JOIN embeddings ON vec_id = id WHERE vec_id IS NULL AND kind IN ('function', 'class')")
def jo10_without_embedding(spark: Spark, d: str) -> DataFrame:
    return J.without(L.where(_n(spark, d), kind=["function", "class"]), V.table(spark, d, "embeddings"), "id", "vec_id").select("id", "name")


@query("SELECT n.id, coalesce(o.n, 1) complexity FROM g_nodes n LEFT JOIN (SELECT source_id, count(*) n FROM g_dense GROUP BY 1) o ON source_id = id")
def jo11_left_default(spark: Spark, d: str) -> DataFrame:
    out = V.dense_edges(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return J.left_default(_n(spark, d).select("id"), out, "id", "source_id", "n", 1, "complexity")


@query("SELECT id, name, n complexity FROM g_nodes JOIN (SELECT source_id, count(*) n FROM g_dense GROUP BY 1) ON source_id = id WHERE n > 10 ORDER BY n DESC, id LIMIT 25")
def jo12_top_complex(spark: Spark, d: str) -> DataFrame:
    c = V.dense_edges(spark, d).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("complexity"))
    return A.top(_n(spark, d).join(c.filter("complexity > 10"), "id").select("id", "name", "complexity"), "complexity", 25)


@query("SELECT l_orderkey process_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) step, id, name FROM lineitem JOIN g_nodes ON id = l_partkey")
def jo13_process_steps(spark: Spark, d: str) -> DataFrame:
    steps = V.table(spark, d, "lineitem").withColumn("step", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    return steps.join(_n(spark, d), F.col("l_partkey") == F.col("id")).select(F.col("l_orderkey").alias("process_id"), "step", "id", "name")


@query("""WITH b AS (SELECT file AS fn, id, CAST(row_number() OVER (PARTITION BY file ORDER BY line, id) - 1 AS INTEGER) idx FROM g_nodes)
  SELECT x.fn, x.idx from_idx, y.idx to_idx, e.kind FROM g_edges e JOIN b x ON x.id = source_id JOIN b y ON y.id = target_id AND y.fn = x.fn""")
def jo14_block_indexes(spark: Spark, d: str) -> DataFrame:
    return J.indexed_edges(V.edges(spark, d), _n(spark, d).withColumnRenamed("file", "fn"), "fn", ["line", "id"])


@query("""SELECT c.id call_id, arg_min(n.id, (CASE WHEN n.kind IN ('function', 'method') THEN 0 ELSE 1 END, n.line, n.id)) enclosing FROM g_nodes c JOIN g_nodes n ON n.scope = c.scope AND n.line <= c.line AND n.end_line >= c.line AND n.id <> c.id WHERE n.kind IN ('function', 'method', 'class', 'interface') GROUP BY c.id""")
def jo15_enclosing(spark: Spark, d: str) -> DataFrame:
    n = _n(spark, d)
    return J.enclosing(n.select(F.col("id").alias("call_id"), "scope", F.col("line").alias("at")), n, "scope")


@query("""WITH cand AS (SELECT c.id call_id, n.id target, CASE WHEN n.file = c.file THEN 1 WHEN n.scope = c.scope THEN 2 WHEN n.exported THEN 3 ELSE 4 END tier FROM g_nodes c JOIN g_nodes n ON n.name = c.name AND n.id <> c.id),
  best AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY target) r, min(tier) OVER (PARTITION BY call_id) m FROM cand QUALIFY tier = m)
  SELECT call_id, target, CAST(tier AS INTEGER) tier, CASE tier WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.9::DOUBLE WHEN 3 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END confidence FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY target) k FROM best) WHERE k <= 3""")
def jo16_name_resolution(spark: Spark, d: str) -> DataFrame:
    n = _n(spark, d)
    return J.resolve_names(n.select(F.col("id").alias("call_id"), "name", "file", "scope"), n)


@query("""SELECT c.id, arg_min(n.id, (CASE WHEN n.file = c.file THEN 0 WHEN n.scope = c.scope THEN 1 ELSE 2 END, n.id)) best FROM g_nodes c JOIN g_nodes n ON n.name = c.name AND n.id <> c.id WHERE n.kind IN ('class', 'interface') GROUP BY c.id""")
def jo17_best_match(spark: Spark, d: str) -> DataFrame:
    n = _n(spark, d)
    return J.best_match(n.select("id", "name", "file", "scope"), L.where(n, kind=["class", "interface"]))


@query("""WITH f AS (SELECT DISTINCT file AS path FROM g_nodes), suffix AS (SELECT array_to_string(p[i:], '/') s, path FROM (SELECT path, string_split(path, '/') p FROM f) t, LATERAL (SELECT unnest(range(1, len(p) + 1)) i)),
  want AS (SELECT DISTINCT id % 50 imp, regexp_replace(file, '^[^/]+/', '') s FROM g_nodes) SELECT imp, s suffix, min(path) path FROM want JOIN suffix USING (s) GROUP BY imp, s""")
def jo18_path_suffix(spark: Spark, d: str) -> DataFrame:
    n = _n(spark, d)
    wants = n.select((F.col("id") % 50).alias("imp"), F.regexp_replace("file", "^[^/]+/", "").alias("suffix")).distinct()
    return J.by_suffix(wants, n.select(F.col("file").alias("path")).distinct())


@query("""WITH m AS (SELECT DISTINCT o_custkey owner, o_orderdate meth FROM orders WHERE o_orderpriority <> '1-URGENT'), i AS (SELECT DISTINCT o_orderkey // 8 owner, o_orderdate meth FROM orders WHERE o_orderpriority = '1-URGENT'), k AS (SELECT owner, count(*) n FROM i GROUP BY owner)
  SELECT m.owner struct, i.owner iface, 0.8::DOUBLE confidence FROM m JOIN i USING (meth) JOIN k ON k.owner = i.owner GROUP BY m.owner, i.owner HAVING count(*) = any_value(n)""")
def jo19_structural_subtypes(spark: Spark, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").withColumnRenamed("o_orderdate", "method")
    structs = o.filter("o_orderpriority <> '1-URGENT'").select(F.col("o_custkey").alias("owner"), "method").distinct()
    return J.structural_subtypes(structs, o.filter("o_orderpriority = '1-URGENT'").select(F.expr("o_orderkey div 8").alias("owner"), "method").distinct())


@query("""WITH r(rule, f, t) AS (VALUES (1, 'Brand#1/', 'Brand#2'), (2, 'PROMO', 'SMALL'), (3, 'ECONOMY', 'Brand#3/'))
  SELECT rule, source_id, target_id FROM (SELECT rule, source_id, target_id, row_number() OVER (PARTITION BY rule ORDER BY source_id, target_id, e.kind) k FROM r, g_edges e JOIN g_nodes a ON a.id = source_id JOIN g_nodes b ON b.id = target_id WHERE contains(a.file, f) AND contains(b.file, t)) WHERE k <= 100""")
def jo21_architecture_rules(spark: Spark, d: str) -> DataFrame:
    rules = [(1, "deny", "Brand#1/", "Brand#2"), (2, "deny", "PROMO", "SMALL"), (3, "deny", "ECONOMY", "Brand#3/"), (4, "allow", "x", "y")]
    return J.rule_violations(V.edges(spark, d), _n(spark, d), rules, 100)


@query("SELECT source_id, target_id, a.scope source_owner, b.scope target_owner FROM g_edges JOIN g_nodes a ON a.id = source_id JOIN g_nodes b ON b.id = target_id WHERE a.file <> b.file AND a.scope <> b.scope")
def jo22_ownership_boundaries(spark: Spark, d: str) -> DataFrame:
    owners = _n(spark, d).select("file", F.array("scope").alias("owners")).distinct()
    out = J.owner_boundaries(V.edges(spark, d), _n(spark, d), owners)
    return out.select("source_id", "target_id", F.element_at("source_owners", 1).alias("source_owner"), F.element_at("target_owners", 1).alias("target_owner"))


# aggregates


@query("SELECT kind, count(*) n, count(DISTINCT file) files FROM g_nodes GROUP BY kind")
def ag01_counts(spark: Spark, d: str) -> DataFrame:
    return A.counts(_n(spark, d), "kind", "file")


@query("SELECT 'node' what, kind AS key, count(*) n FROM g_nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM g_edges GROUP BY kind UNION ALL SELECT 'file', 'all', count(DISTINCT file) FROM g_nodes")
def ag02_stats(spark: Spark, d: str) -> DataFrame:
    return A.graph_stats(_n(spark, d), V.edges(spark, d))


@query("SELECT id, coalesce(i.n, 0) fan_in, coalesce(o.n, 0) fan_out FROM g_nodes LEFT JOIN (SELECT target_id t, count(DISTINCT source_id) n FROM g_edges WHERE kind = 'calls' GROUP BY 1) i ON t = id LEFT JOIN (SELECT source_id s, count(DISTINCT target_id) n FROM g_edges WHERE kind = 'calls' GROUP BY 1) o ON s = id")
def ag03_fan(spark: Spark, d: str) -> DataFrame:
    return A.fan(_n(spark, d).select("id"), V.edges(spark, d), ["calls"])


@query("""SELECT id, name, fan_in, fan_out, score FROM (SELECT id, name, coalesce(i.n, 0) fan_in, coalesce(o.n, 0) fan_out, 2 * coalesce(i.n, 0) + coalesce(o.n, 0) + CASE WHEN exported THEN 1 ELSE 0 END score FROM g_nodes LEFT JOIN (SELECT target_id t, count(DISTINCT source_id) n FROM g_edges WHERE kind = 'calls' GROUP BY 1) i ON t = id
  LEFT JOIN (SELECT source_id s, count(DISTINCT target_id) n FROM g_edges WHERE kind = 'calls' GROUP BY 1) o ON s = id WHERE kind IN ('function', 'method')) WHERE score > 0 ORDER BY score DESC, id LIMIT 20""")
def ag04_hotspots(spark: Spark, d: str) -> DataFrame:
    return A.hotspots(_n(spark, d), V.edges(spark, d), 20)


@query("SELECT round(avg(n), 8) avg_complexity, max(n) max_complexity, count(*) FILTER (n > 10) n_high, CAST(sum(n) AS BIGINT) total FROM (SELECT source_id, count(*) n FROM g_dense GROUP BY 1)")
def ag05_complexity_stats(spark: Spark, d: str) -> DataFrame:
    return A.complexity_stats(V.dense_edges(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("n")), "n")


@query("SELECT substr(file, 1, CASE WHEN p2 = 0 THEN len(file) ELSE p1 + p2 - 1 END) module, count(*) n FROM (SELECT file, instr(file, '/') p1, instr(substr(file, instr(file, '/') + 1), '/') p2 FROM g_nodes) GROUP BY 1 ORDER BY n DESC, module LIMIT 30")
def ag09_modules(spark: Spark, d: str) -> DataFrame:
    return A.modules(_n(spark, d), 2, 30)


@query("SELECT CASE WHEN file LIKE '%test%' THEN 'test' ELSE 'source' END language, count(DISTINCT file) files FROM g_nodes GROUP BY 1")
def ag12_languages(spark: Spark, d: str) -> DataFrame:
    files = _n(spark, d).select("file", F.when(F.col("file").contains("test"), "test").otherwise("source").alias("language")).distinct()
    return A.by_count(files, "language", "files")


@query("SELECT conv_id session, count(*) n_messages, min(turn) first_turn, max(turn) last_turn, coalesce(max_by(role, turn) FILTER (role <> 'user'), 'default') agent FROM conversations GROUP BY conv_id")
def ag13_sessions(spark: Spark, d: str) -> DataFrame:
    chat = V.table(spark, d, "conversations").dropDuplicates(["conv_id", "turn"])
    return A.sessions(chat.select(F.col("conv_id").alias("session"), "turn", F.when(F.col("role") != "user", F.col("role")).alias("agent")))


@query("""SELECT id, (0.5 * callers)::DOUBLE impact, round((0.3 * complexity + 0.7 * (0.5 * callers))::DOUBLE, 8) risk, CASE WHEN 0.3::DOUBLE * complexity + 0.7::DOUBLE * (0.5::DOUBLE * callers) >= 5 THEN 'high' WHEN 0.3::DOUBLE * complexity + 0.7::DOUBLE * (0.5::DOUBLE * callers) >= 2 THEN 'medium' ELSE 'low' END bucket
  FROM (SELECT id, (SELECT count(*) FROM g_edges WHERE kind = 'calls' AND target_id = id) callers, coalesce(nullif((SELECT count(*) FROM g_dense WHERE source_id = id), 0), 1) complexity FROM g_nodes)""")
def ag14_triage(spark: Spark, d: str) -> DataFrame:
    c = V.dense_edges(spark, d).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("complexity"))
    return A.triage(_n(spark, d), V.edges(spark, d), c)


@query("""SELECT id, impact, risk, CASE WHEN entry THEN 'entry point' WHEN impact > 0.1 THEN 'many callers' ELSE 'changed' END reason FROM (SELECT id, exported AND o > 0 AND i = 0 entry, round(least(i / 20.0, 1.0), 8)::DOUBLE impact, round(least(1.0, least(i / 20.0, 1.0) + CASE WHEN exported AND o > 0 AND i = 0 THEN 0.3 ELSE 0.0 END), 8)::DOUBLE risk
  FROM (SELECT id, exported, (SELECT count(DISTINCT source_id) FROM g_edges WHERE kind = 'calls' AND target_id = id) i, (SELECT count(DISTINCT target_id) FROM g_edges WHERE kind = 'calls' AND source_id = id) o FROM g_nodes WHERE scope = 'Brand#3')) ORDER BY risk DESC, id LIMIT 20""")
def ag15_triage_changed(spark: Spark, d: str) -> DataFrame:
    n = _n(spark, d).filter("scope = 'Brand#3'")
    fan = A.fan(n, V.edges(spark, d), ["calls"])
    return A.triage_changed(fan.withColumn("entry", F.col("exported") & (F.col("fan_out") > 0) & (F.col("fan_in") == 0)), 20)


@query("SELECT count(*) total, count(vec_id) embedded, count(*) - count(vec_id) pending FROM g_nodes LEFT JOIN embeddings ON vec_id = id")
def ag17_embedding_status(spark: Spark, d: str) -> DataFrame:
    return A.embedding_status(_n(spark, d), V.table(spark, d, "embeddings"), "vec_id")


@query("SELECT user_id, max(value) score FROM events GROUP BY user_id")
def ag18_best_per_key(spark: Spark, d: str) -> DataFrame:
    return V.table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("score"))


@query("SELECT scope || '/' || kind AS bucket, array_to_string(list_sort(list(id)), ',') ids FROM g_nodes GROUP BY scope, kind, id // 1000")
def ag19_ids_by_kind(spark: Spark, d: str) -> DataFrame:
    # a kind may hold any share of the nodes: a row has the ids of one range of ids
    n = _n(spark, d).withColumn("bucket", F.concat("scope", F.lit("/"), "kind"))
    return A.ids_by(n, "bucket", F.expr("id div 1000"))


# windows and sets


@query("SELECT id, rank FROM (SELECT id, kind, row_number() OVER (ORDER BY name, id) rank FROM g_nodes WHERE name ILIKE '%re%') WHERE kind = 'function'")
def wi01_rank_then_filter(spark: Spark, d: str) -> DataFrame:
    hits = _n(spark, d).filter(F.col("name").ilike("%re%"))
    return A.global_rank(hits, ["name", "id"], "rank").filter("kind = 'function'").select("id", F.col("rank").cast("long"))


@query("SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) rank FROM events QUALIFY rank <= 50")
def wi02_rank_per_source(spark: Spark, d: str) -> DataFrame:
    return A.top_per_group(V.table(spark, d, "events"), ["event_type"], [F.desc("value"), F.col("event_id")], 50).select("event_type", "event_id", "rank")


@query("SELECT name, kind, min(id) id FROM g_nodes GROUP BY name, kind")
def wi03_first_per_key(spark: Spark, d: str) -> DataFrame:
    return A.top_per_group(_n(spark, d), ["name", "kind"], [F.col("id")], 1).select("name", "kind", "id")


@query("SELECT event_id FROM (SELECT event_id FROM events WHERE event_type <> 'error' ORDER BY ts DESC, event_id LIMIT 150) UNION SELECT event_id FROM (SELECT event_id FROM (SELECT event_id, ts FROM events WHERE event_type = 'error') ORDER BY ts DESC, event_id LIMIT 450)")
def wi04_retention(spark: Spark, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    return A.newest(e.filter("event_type <> 'error'"), 150).union(A.newest(e.filter("event_type = 'error'"), 450)).select("event_id").distinct()


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) k FROM events) WHERE k <= 5")
def wi05_top_per_rule(spark: Spark, d: str) -> DataFrame:
    return A.top_per_group(V.table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")], 5).select("user_id", "event_id", "ts")


@query("""SELECT user_id, event_id, pattern, CAST(seen AS BIGINT) seen FROM (SELECT *, count(*) OVER (PARTITION BY user_id, pattern ORDER BY ts, event_id) seen FROM (SELECT user_id, event_id, ts, string_agg(event_type, '>') OVER w pattern, count(*) OVER w k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)) WHERE k = 3) WHERE seen >= 3""")
def wi06_repeated_patterns(spark: Spark, d: str) -> DataFrame:
    return A.repeated_patterns(V.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", 3, 3).select("user_id", "event_id", "pattern", "seen")


@query("SELECT event_id, CAST(list_count(list_filter(recent, lambda x: x = event_type)) - 1 AS INTEGER) repeats FROM (SELECT event_id, event_type, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 10 PRECEDING) recent FROM events)")
def wi07_recent_repeats(spark: Spark, d: str) -> DataFrame:
    return A.recent_repeats(V.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", 10).select("event_id", "repeats")


@query("SELECT user_id, count(*) n_sessions, max(n) longest FROM (SELECT user_id, s, count(*) n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END b FROM events)) GROUP BY ALL) GROUP BY user_id")
def wi10_gap_sessions(spark: Spark, d: str) -> DataFrame:
    return A.gap_sessions(V.table(spark, d, "events"), "user_id", "ts", "30 minutes")


@query("SELECT source_id id FROM g_edges UNION SELECT target_id FROM g_edges")
def st01_union_of_ends(spark: Spark, d: str) -> DataFrame:
    e = V.edges(spark, d)
    return e.select(F.col("source_id").alias("id")).union(e.select("target_id")).distinct()


CHANGES = """SELECT coalesce(n.path, o.path) path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.hash <> n.hash THEN 'modified' WHEN o.mtime <> n.mtime THEN 'touched' ELSE 'unchanged' END change FROM manifest_old o FULL JOIN manifest_new n ON o.path = n.path"""


@query(CHANGES)
def st04_changes(spark: Spark, d: str) -> DataFrame:
    from ..streaming.changes import detect

    return detect(V.manifest(spark, d, False), V.manifest(spark, d, True)).select("path", "change")


@query("SELECT id FROM g_nodes WHERE id NOT IN (SELECT target_id FROM g_edges)")
def st05_difference(spark: Spark, d: str) -> DataFrame:
    return _n(spark, d).select("id").subtract(V.edges(spark, d).select("target_id"))


@query("SELECT source_id FROM g_edges WHERE kind = 'calls' INTERSECT SELECT target_id FROM g_edges WHERE kind = 'calls'")
def st05_intersection(spark: Spark, d: str) -> DataFrame:
    e = V.edges(spark, d).filter("kind = 'calls'")
    return e.select("source_id").intersect(e.select("target_id"))


@query("SELECT 'node' what, id, CAST(NULL AS BIGINT) target FROM g_nodes WHERE scope = 'Brand#6' UNION ALL SELECT DISTINCT 'edge', source_id, target_id FROM g_edges JOIN g_nodes a ON a.id = source_id JOIN g_nodes b ON b.id = target_id WHERE a.scope = 'Brand#6' OR b.scope = 'Brand#6'")
def st06_graph_delta(spark: Spark, d: str) -> DataFrame:
    n = _n(spark, d)
    changed = n.filter("scope = 'Brand#6'")
    e = J.edges_touching(V.edges(spark, d), changed)
    return changed.select(F.lit("node").alias("what"), "id", F.lit(None).cast("long").alias("target")).unionByName(e.select(F.lit("edge").alias("what"), F.col("source_id").alias("id"), F.col("target_id").alias("target")).distinct())


@query("SELECT id, name, CAST(CASE WHEN lower(name) = 'bolt' THEN 0 WHEN starts_with(lower(name), 're') THEN 1 ELSE 2 END AS INTEGER) rank FROM g_nodes WHERE name ILIKE '%re%' ORDER BY CASE WHEN lower(name) = 're' THEN 0 WHEN starts_with(lower(name), 're') THEN 1 ELSE 2 END, name, id LIMIT 40")
def so01_ranked_names(spark: Spark, d: str) -> DataFrame:
    return L.name_ranked(_n(spark, d), "re", 40).select("id", "name", "rank")
