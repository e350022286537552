"""Queries on walks and whole-graph algorithms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..operators import entries as E
from ..operators import structure as S
from ..operators import traverse as T
from ..operators.betweenness import betweenness
from .registry import query

Spark = SparkSession
ROOT, TARGET = 797, 1076


def _ids(spark: Spark, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id long")


def _walk(start: str, step: str, depth: int, more: str = "") -> str:
    """SQL of a walk: least depth of each node; step joins b(node, depth) with edges and yields the next node."""
    return f"WITH RECURSIVE b(node, depth) AS ({start} UNION SELECT {step} AND depth < {depth}){more} "


_CALLERS = "e.source_id, depth + 1 FROM b JOIN g_edges e ON e.target_id = b.node WHERE e.kind = 'calls'"
_LEAST = "SELECT node id, CAST(min(depth) AS INTEGER) depth FROM b"
_INHERIT = "kind IN ('extends', 'implements')"


@query(_walk(f"SELECT {ROOT}::BIGINT, 0", _CALLERS, 4) + f"{_LEAST} WHERE node <> {ROOT} GROUP BY node")
def gr01_impact(spark: Spark, d: str) -> DataFrame:
    return T.impact(V.edges(spark, d), _ids(spark, ROOT), 4)


@query(_walk("SELECT id, 0 FROM (SELECT id FROM g_nodes WHERE name ILIKE '%bolt%' AND kind = 'class' ORDER BY name = 'blue bolt' DESC, id LIMIT 1)", "e.target_id, depth + 1 FROM b JOIN g_edges e ON e.source_id = b.node WHERE e.kind = 'calls'", 5) + f"{_LEAST} GROUP BY node HAVING min(depth) > 0")
def gr02_impact_by_name(spark: Spark, d: str) -> DataFrame:
    root = V.nodes(spark, d).filter(F.col("name").ilike("%bolt%") & (F.col("kind") == "class")).orderBy((F.col("name") == "blue bolt").desc(), "id").limit(1)
    found = T.bfs(V.edges(spark, d).filter("kind = 'calls'"), root, 5, "out").filter("depth > 0")
    return found.withColumnRenamed("node", "id")


@query(_walk(f"SELECT target_id, 1 FROM g_edges WHERE source_id = {ROOT}", "e.target_id, depth + 1 FROM b JOIN g_edges e ON e.source_id = b.node WHERE true", 3) + "SELECT node id, CAST(min(depth) AS INTEGER) depth, min(depth) = 1 direct FROM b GROUP BY node")
def gr03_dependencies(spark: Spark, d: str) -> DataFrame:
    return T.dependencies(V.edges(spark, d), ROOT, 3)


@query("WITH RECURSIVE seeds AS (SELECT id FROM g_nodes WHERE scope = 'Brand#7'), b(root, node, depth) AS (SELECT id, id, 0 FROM seeds UNION SELECT root, e.source_id, depth + 1 FROM b JOIN g_edges e ON e.target_id = b.node WHERE kind = 'calls' AND depth < 3), best AS (SELECT root, node, min(depth) depth FROM b GROUP BY 1, 2) SELECT node id, CAST(min(depth) AS INTEGER) depth FROM best WHERE depth > 0 GROUP BY node")
def gr04_diff_impact(spark: Spark, d: str) -> DataFrame:
    return T.impact_of_each(V.edges(spark, d), V.nodes(spark, d).filter("scope = 'Brand#7'"), 3)


@query(f"""WITH RECURSIVE p(path, tail) AS (SELECT [{ROOT}::BIGINT], {ROOT}::BIGINT UNION ALL SELECT list_append(path, e.target_id), e.target_id FROM p JOIN (SELECT DISTINCT source_id, target_id FROM g_edges) e ON e.source_id = p.tail
  WHERE p.tail <> {TARGET} AND NOT list_contains(path, e.target_id) AND len(path) <= 7) SELECT array_to_string(path, '>') AS chain, CAST(len(path) - 1 AS INTEGER) n_edges FROM p WHERE tail = {TARGET}""")
def gr05_call_chains(spark: Spark, d: str) -> DataFrame:
    return T.call_chains(V.edges(spark, d), ROOT, TARGET, 7).select(F.array_join("path", ">").alias("chain"), "n_edges")


@query(f"SELECT CAST(count(*) - 1 AS INTEGER) steps FROM (" + _walk(f"SELECT {ROOT}::BIGINT, 0", "e.target_id, depth + 1 FROM b JOIN g_edges e ON e.source_id = b.node WHERE true", 20).replace("WITH RECURSIVE ", "WITH RECURSIVE ") + f"SELECT unnest(range(coalesce(min(depth), -1) + 1)) FROM b WHERE node = {TARGET})")
def gr06_shortest_path(spark: Spark, d: str) -> DataFrame:
    return T.shortest_path(V.edges(spark, d), ROOT, TARGET).agg((F.count(F.lit(1)) - 1).cast("int").alias("steps"))


_BOTH = "(SELECT source_id s, target_id t FROM g_edges WHERE {0} UNION SELECT target_id, source_id FROM g_edges WHERE {0})"


@query(_walk(f"SELECT {ROOT}::BIGINT, 0", f"e.t, depth + 1 FROM b JOIN {_BOTH.format('true')} e ON e.s = b.node WHERE true", 3) + "SELECT node id, CAST(min(depth) AS INTEGER) depth, round(1 - 0.2 * min(depth), 2)::DOUBLE score FROM b GROUP BY node HAVING min(depth) > 0")
def gr07_neighbours(spark: Spark, d: str) -> DataFrame:
    return T.neighbours(V.edges(spark, d), _ids(spark, ROOT), 3)


@query(_walk(f"SELECT {ROOT}::BIGINT, 0", f"e.t, depth + 1 FROM b JOIN {_BOTH.format('true')} e ON e.s = b.node WHERE true", 3) + "SELECT id, kind, depth FROM (SELECT node id, CAST(min(depth) AS INTEGER) depth FROM b GROUP BY node) JOIN g_nodes USING (id) WHERE kind IN ('class', 'interface')")
def gr08_drilldown(spark: Spark, d: str) -> DataFrame:
    near = T.bfs(V.edges(spark, d), _ids(spark, ROOT), 3, "both").withColumnRenamed("node", "id")
    return near.join(V.nodes(spark, d).filter(F.col("kind").isin("class", "interface")), "id").select("id", "kind", "depth")


@query(_walk(f"SELECT {ROOT}::BIGINT, 0", f"e.t, depth + 1 FROM b JOIN {_BOTH.format(chr(39).join(['kind = ', 'imports', '']))} e ON e.s = b.node WHERE true", 4) + "SELECT node id, CAST(min(depth) AS INTEGER) depth, round(1 - 0.2 * min(depth), 2)::DOUBLE score FROM b GROUP BY node HAVING min(depth) > 0")
def gr09_neighbours_by_kind(spark: Spark, d: str) -> DataFrame:
    return T.neighbours(V.edges(spark, d), _ids(spark, ROOT), 4, kinds=["imports"])


@query("""WITH RECURSIVE f AS (SELECT DISTINCT a.file s, b.file t FROM g_edges JOIN g_nodes a ON a.id = source_id JOIN g_nodes b ON b.id = target_id WHERE g_edges.kind = 'imports' AND a.file <> b.file),
  b(node, depth) AS (SELECT 'Brand#23/STANDARD/0.go', 0 UNION SELECT f.s, depth + 1 FROM b JOIN f ON f.t = b.node WHERE depth < 4) SELECT node AS file, CAST(min(depth) AS INTEGER) depth FROM b GROUP BY node HAVING min(depth) > 0""")
def gr10_importer_files(spark: Spark, d: str) -> DataFrame:
    return T.importer_files(V.nodes(spark, d), V.edges(spark, d), "Brand#23/STANDARD/0.go")


@query("WITH RECURSIVE b(id, depth) AS (SELECT 'r2', 0 UNION ALL SELECT g_tree.id, depth + 1 FROM b JOIN g_tree ON parent_id = b.id) SELECT id, CAST(depth AS INTEGER) depth FROM b WHERE depth > 0")
def gr11_descendants(spark: Spark, d: str) -> DataFrame:
    return T.descendants(V.tree(spark, d), "r2")


@query("WITH RECURSIVE b(id, depth) AS (SELECT 'c77', 0 UNION ALL SELECT g_tree.parent_id, depth + 1 FROM b JOIN g_tree ON g_tree.id = b.id WHERE parent_id IS NOT NULL) SELECT id, CAST(depth AS INTEGER) depth FROM b WHERE depth > 0")
def gr11_ancestors(spark: Spark, d: str) -> DataFrame:
    return T.ancestors(V.tree(spark, d), "c77")


@query(_walk(f"SELECT {ROOT}::BIGINT, 0", "e.target_id, depth + 1 FROM b JOIN g_edges e ON e.source_id = b.node WHERE e.kind = 'calls'", 5) + "SELECT m.depth, e.source_id src, e.target_id dst, x.file from_file, y.file to_file, x.name caller, y.name callee FROM (SELECT node, CAST(min(depth) AS INTEGER) depth FROM b GROUP BY node) m JOIN g_edges e ON e.source_id = m.node AND e.kind = 'calls' JOIN g_nodes x ON x.id = e.source_id JOIN g_nodes y ON y.id = e.target_id")
def gr12_sequence(spark: Spark, d: str) -> DataFrame:
    return T.messages(V.nodes(spark, d), V.edges(spark, d), ROOT, 6)


_REACH = "WITH RECURSIVE e AS (SELECT DISTINCT source_id s, target_id t FROM g_edges WHERE {0} AND source_id <> target_id), r(a, b) AS (SELECT s, t FROM e UNION SELECT r.a, e.t FROM r JOIN e ON e.s = r.b)"


@query(_REACH.format("kind IN ('imports', 'extends', 'implements')") + " SELECT id, coalesce((SELECT min(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = id), id) component FROM g_nodes")
def gr13_strong_components(spark: Spark, d: str) -> DataFrame:
    return S.strong_components(V.nodes(spark, d), V.edges(spark, d).filter("kind IN ('imports', 'extends', 'implements')"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT source_id s, target_id t FROM g_edges WHERE source_id <> target_id), r(a, b) USING KEY (a, b) AS (SELECT s, t FROM e UNION SELECT r.a, e.t FROM r JOIN e ON e.s = r.b LEFT JOIN recurring.r x ON x.a = r.a AND x.b = e.t WHERE x.a IS NULL), c AS (SELECT x.a id, least(x.a, min(x.b)) component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a) SELECT component, count(*) AS size FROM c GROUP BY component HAVING count(*) > 1")
def gr13_cycles_all_kinds(spark: Spark, d: str) -> DataFrame:
    return S.cycles(V.nodes(spark, d), V.edges(spark, d))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT source_id s, target_id t FROM g_edges WHERE {_INHERIT}), w(id, n) AS (SELECT id, 0 FROM g_nodes UNION SELECT e.t, n + 1 FROM w JOIN e ON e.s = w.id WHERE n < 3000)
  SELECT id, CASE WHEN max(n) < 3000 THEN CAST(max(n) AS INTEGER) END AS level FROM w GROUP BY id""")
def gr14_topological_levels(spark: Spark, d: str) -> DataFrame:
    return S.levels(V.nodes(spark, d), V.edges(spark, d).filter(_INHERIT))


@query("WITH RECURSIVE e AS (SELECT DISTINCT source_id s, target_id t FROM g_edges), r(a, b) USING KEY (a, b) AS (SELECT s, t FROM e UNION SELECT r.a, e.t FROM r JOIN e ON e.s = r.b LEFT JOIN recurring.r x ON x.a = r.a AND x.b = e.t WHERE x.a IS NULL) SELECT count(*) = 0 is_dag FROM r WHERE a = b")
def gr14_is_dag(spark: Spark, d: str) -> DataFrame:
    return S.is_dag(V.nodes(spark, d), V.edges(spark, d))


@query("WITH RECURSIVE e AS (SELECT source_id s, target_id t FROM g_edges UNION SELECT target_id, source_id FROM g_edges), r(a, b) AS (SELECT id, id FROM g_nodes WHERE id NOT IN (SELECT s FROM e) UNION SELECT s, s FROM e UNION SELECT r.a, e.t FROM r JOIN e ON e.s = r.b WHERE e.t < r.a OR r.b > r.a OR e.t > r.a) SELECT a id, min(b) component FROM r GROUP BY a")
def gr15_components(spark: Spark, d: str) -> DataFrame:
    return S.weak_components(V.nodes(spark, d), V.edges(spark, d))


@query()
def gr16_communities(spark: Spark, d: str) -> DataFrame:
    return S.communities(V.nodes(spark, d), V.edges(spark, d))


@query("""WITH e AS (SELECT DISTINCT least(source_id, target_id) u, greatest(source_id, target_id) v FROM g_edges WHERE source_id <> target_id), c AS (SELECT id, scope FROM g_nodes),
  j AS (SELECT a.scope ca, b.scope cb FROM e JOIN c a ON a.id = u JOIN c b ON b.id = v), d AS (SELECT c, count(*) deg FROM (SELECT ca c FROM j UNION ALL SELECT cb FROM j) GROUP BY c), m AS (SELECT count(*)::DOUBLE m FROM j)
  SELECT round((SELECT count(*) FROM j WHERE ca = cb) / m - (SELECT sum(deg * deg) FROM d) / (4 * m * m), 8) modularity FROM m""")
def gr16_modularity(spark: Spark, d: str) -> DataFrame:
    return S.modularity(V.edges(spark, d), V.nodes(spark, d).select("id", F.col("scope").alias("community")))


@query(_walk(f"SELECT {ROOT}::BIGINT, 0", "e.target_id, depth + 1 FROM b JOIN g_edges e ON e.source_id = b.node WHERE e.kind = 'calls'", 60) + "SELECT id, coalesce(CAST(min(depth) AS DOUBLE), 'inf'::DOUBLE) distance FROM g_nodes LEFT JOIN b ON node = id GROUP BY id")
def gr17_shortest_distances(spark: Spark, d: str) -> DataFrame:
    met = T.bfs(V.edges(spark, d).filter("kind = 'calls'"), _ids(spark, ROOT)).withColumnRenamed("node", "id")
    return V.nodes(spark, d).select("id").join(met, "id", "left").select("id", F.coalesce(F.col("depth").cast("double"), F.lit(float("inf"))).alias("distance"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT source_id s, target_id t FROM g_edges), r(a, b, n) USING KEY (a, b) AS (SELECT s, t, 1 FROM e UNION SELECT r.a, e.t, r.n + 1 FROM r JOIN e ON e.s = r.b LEFT JOIN recurring.r x ON x.a = r.a AND x.b = e.t WHERE x.n IS NULL), p AS (SELECT a, b, n FROM r WHERE a <> b) SELECT CAST(coalesce(max(n), 0) AS INTEGER) diameter, round(coalesce(avg(n), 0.0), 8) average_path FROM p")
def gr18_path_lengths(spark: Spark, d: str) -> DataFrame:
    return T.path_lengths(T.path_counts(V.nodes(spark, d), V.edges(spark, d)))


def _ranks(rounds: int) -> str:
    ctes = ["n AS (SELECT count(*)::DOUBLE n FROM g_nodes)", "o AS (SELECT source_id s, count(*)::DOUBLE o FROM g_dense GROUP BY 1)", "p0 AS (SELECT id, 1 / n r FROM g_nodes, n)"]
    for k in range(rounds):
        ctes.append(f"l{k} AS MATERIALIZED (SELECT coalesce(sum(r), 0) x FROM p{k} WHERE id NOT IN (SELECT s FROM o)), c{k} AS MATERIALIZED (SELECT target_id t, sum(r / o) x FROM g_dense JOIN p{k} ON p{k}.id = source_id JOIN o ON s = source_id GROUP BY 1), p{k + 1} AS MATERIALIZED (SELECT id, 0.15 / n + 0.85 * (coalesce(c{k}.x, 0) + l{k}.x / n) r FROM g_nodes LEFT JOIN c{k} ON t = id, n, l{k})")
    return "WITH " + ", ".join(ctes) + f" SELECT id, round(r, 10) AS rank FROM p{rounds}"


@query(_ranks(50))
def gr19_pagerank(spark: Spark, d: str) -> DataFrame:
    return S.pagerank(V.nodes(spark, d), V.dense_edges(spark, d)).select("id", F.round("rank", 10).alias("rank"))


@query("WITH n AS (SELECT count(*) - 1 n FROM g_nodes), e AS (SELECT source_id x FROM g_dense UNION ALL SELECT target_id FROM g_dense) SELECT id, round(count(x) / any_value(n)::DOUBLE, 10) centrality FROM n, g_nodes LEFT JOIN e ON x = id GROUP BY id")
def gr20_degree_centrality(spark: Spark, d: str) -> DataFrame:
    return S.degree_centrality(V.nodes(spark, d), V.dense_edges(spark, d)).select("id", F.round("centrality", 10).alias("centrality"))


@query()
def gr21_betweenness(spark: Spark, d: str) -> DataFrame:
    return betweenness(V.nodes(spark, d), V.edges(spark, d)).select("id", F.round("betweenness", 12).alias("betweenness"))


@query("""WITH e AS (SELECT DISTINCT source_id s, target_id t FROM g_dense WHERE source_id <> target_id), b AS (SELECT s, t FROM e UNION SELECT t, s FROM e), k AS (SELECT s id, count(*) k FROM b GROUP BY s),
  l AS (SELECT x.s id, count(*) l FROM b x JOIN b y ON x.s = y.s AND x.t <> y.t JOIN e ON e.s = x.t AND e.t = y.t GROUP BY 1)
  SELECT id, round(CASE WHEN k > 1 THEN coalesce(l, 0) / (k * (k - 1))::DOUBLE ELSE 0.0 END, 10)::DOUBLE clustering FROM g_nodes LEFT JOIN k USING (id) LEFT JOIN l USING (id)""")
def gr22_clustering(spark: Spark, d: str) -> DataFrame:
    return S.clustering(V.nodes(spark, d), V.dense_edges(spark, d)).select("id", F.round("clustering", 10).alias("clustering"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT source_id s, target_id t FROM g_edges WHERE source_id <> target_id), r(a, b) USING KEY (a, b) AS (SELECT s, t FROM e UNION SELECT r.a, e.t FROM r JOIN e ON e.s = r.b LEFT JOIN recurring.r x ON x.a = r.a AND x.b = e.t WHERE x.a IS NULL),
  k AS (SELECT x.a id, least(x.a, min(x.b)) component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a), c AS (SELECT coalesce(component, g_nodes.id) component, count(*) size FROM g_nodes LEFT JOIN k ON k.id = g_nodes.id GROUP BY 1),
  d AS (SELECT (SELECT count(*) FROM g_nodes) n, (SELECT count(*) FROM g_edges) m) SELECT n, m, round(m / n::DOUBLE, 10) avg_in, round(m / n::DOUBLE, 10) avg_out, (SELECT max(i) FROM (SELECT count(*) i FROM g_edges GROUP BY target_id)) max_in,
  (SELECT max(o) FROM (SELECT count(*) o FROM g_edges GROUP BY source_id)) max_out, round(m / (n * (n - 1))::DOUBLE, 10) density, (SELECT count(*) FROM c) n_scc, (SELECT max(size) FROM c) largest_scc, (SELECT max(size) = 1 FROM c) is_dag FROM d""")
def gr23_metrics(spark: Spark, d: str) -> DataFrame:
    return S.metrics(V.nodes(spark, d), V.edges(spark, d))


_FANS = "SELECT id, exported, (SELECT count(*) FROM g_edges WHERE target_id = id) i, (SELECT count(*) FROM g_edges WHERE source_id = id) o FROM g_nodes"
_KINDS = ["calls", "imports", "extends", "implements"]


@query(f"SELECT id, CASE WHEN NOT exported AND i = 0 THEN 'dead' WHEN i = 0 AND o > 0 OR exported AND o >= 3 THEN 'entry' WHEN i >= 5 AND o >= 5 THEN 'core' WHEN o >= 5 AND i <= 3 THEN 'adapter' WHEN i BETWEEN 1 AND 5 AND o BETWEEN 1 AND 5 THEN 'utility' WHEN i > 0 AND o < 3 THEN 'leaf' ELSE 'utility' END AS role FROM ({_FANS})")
def gr24_roles(spark: Spark, d: str) -> DataFrame:
    f = S.fans(V.nodes(spark, d), V.edges(spark, d), _KINDS)
    return f.select("id", S.role(F.col("fan_in"), F.col("fan_out"), F.col("exported")).alias("role"))


@query(f"SELECT CASE WHEN i >= 10 THEN 'critical' WHEN exported OR i >= 5 THEN 'high' WHEN i > 0 THEN 'medium' ELSE 'low' END risk, count(*) n FROM ({_FANS}) GROUP BY 1")
def gr25_risk(spark: Spark, d: str) -> DataFrame:
    f = S.fans(V.nodes(spark, d), V.edges(spark, d), _KINDS)
    return f.groupBy(S.risk(F.col("fan_in"), F.col("exported")).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CASE WHEN NOT exported AND i = 0 THEN 'dead' WHEN i = 0 AND o > 0 OR exported AND o >= 3 THEN 'entry' WHEN i >= 5 AND o >= 5 THEN 'core' WHEN o >= 5 AND i <= 3 THEN 'adapter' WHEN i BETWEEN 1 AND 5 AND o BETWEEN 1 AND 5 THEN 'utility' WHEN i > 0 AND o < 3 THEN 'leaf' ELSE 'utility' END AS role, count(*) n FROM ({_FANS}) GROUP BY 1")
def ag10_role_statistics(spark: Spark, d: str) -> DataFrame:
    return gr24_roles(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


_UNCALLED = "kind IN ('function', 'method') AND id NOT IN (SELECT target_id FROM g_edges WHERE kind = 'calls')"


def _uncalled(spark: Spark, d: str) -> DataFrame:
    called = V.edges(spark, d).filter("kind = 'calls'").select(F.col("target_id").alias("id")).distinct()
    return V.nodes(spark, d).filter("kind IN ('function', 'method')").join(called, "id", "left_anti")


@query(f"SELECT id, CASE WHEN exported THEN 'unused_export' ELSE 'dead' END finding FROM g_nodes WHERE {_UNCALLED} AND NOT regexp_matches(lower(file), 'test')")
def gr26_dead_code(spark: Spark, d: str) -> DataFrame:
    return _uncalled(spark, d).filter(~F.lower("file").contains("test")).select("id", F.when(F.col("exported"), "unused_export").otherwise("dead").alias("finding"))


@query(f"SELECT id, name, file FROM g_nodes WHERE {_UNCALLED} AND NOT exported AND NOT name LIKE 'main%' AND NOT name LIKE 'Test%'")
def gr27_dead_code_audit(spark: Spark, d: str) -> DataFrame:
    return _uncalled(spark, d).filter(~F.col("exported") & ~F.col("name").like("main%") & ~F.col("name").like("Test%")).select("id", "name", "file")


@query("SELECT id, name FROM g_nodes WHERE exported AND kind IN ('function', 'method') AND (name LIKE 'green%' OR name LIKE '%bolt')")
def gr28_entry_points(spark: Spark, d: str) -> DataFrame:
    return V.nodes(spark, d).filter("exported AND kind IN ('function', 'method')").filter(F.col("name").rlike("^green|bolt$")).select("id", "name")


_CODE_NAMES = "array('main', 'handle', 'On', 'getUser', 'do_post', 'x_handler', 'runJob', 'UserController', 'index', 'plain', 'perform_', 'Execute')"
_EXTENSIONS = "array('.go', '.py', '.java', '.rs', '.rb', '.php', '.c', '.cpp', '.cs', '.js', '.ts', '.tsx', '_test.go')"


def _code_nodes(spark: Spark, d: str) -> DataFrame:
    """Nodes with names and files as code has them."""
    name = F.expr(f"concat(element_at({_CODE_NAMES}, cast(id % 12 AS int) + 1), CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN '_item' WHEN 2 THEN 'Item' WHEN 3 THEN '_action' ELSE 'Service' END)")
    file = F.expr(f"replace(file, '.go', element_at({_EXTENSIONS}, cast(id % 13 AS int) + 1))")
    return V.nodes(spark, d).withColumns({"name": name, "file": file})


_CODE_SQL = f"""n AS (SELECT id, kind, exported, replace(file, '.go', {_EXTENSIONS.replace('array(', '[').replace(')', ']')}[CAST(id % 13 + 1 AS INTEGER)]) AS file,
  {_CODE_NAMES.replace('array(', '[').replace(')', ']')}[CAST(id % 12 + 1 AS INTEGER)] || CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN '_item' WHEN 2 THEN 'Item' WHEN 3 THEN '_action' ELSE 'Service' END AS name FROM g_nodes)"""
_ENTRY = "regexp_matches(name, '" + "|".join(E.ANY) + "')"
_OWN = "CASE " + " ".join(f"WHEN regexp_matches(file, '[.]{e[1:]}$') THEN regexp_matches(name, '{'|'.join(p)}')" for e, p in E.BY_EXTENSION.items()) + " ELSE false END"


@query(f"WITH {_CODE_SQL} SELECT id, {_ENTRY} universal, {_OWN} own FROM n")
def fn23_entry_names(spark: Spark, d: str) -> DataFrame:
    return _code_nodes(spark, d).select("id", E.universal(F.col("name")).alias("universal"), E.of_language(F.col("name"), F.col("file")).alias("own"))


@query(f"""WITH {_CODE_SQL}, o AS (SELECT source_id id, count(*) c FROM g_edges WHERE kind = 'calls' GROUP BY 1), i AS (SELECT target_id id, count(*) c FROM g_edges WHERE kind = 'calls' GROUP BY 1),
  s AS (SELECT n.id, name, file, round(o.c / (coalesce(i.c, 0) + 1)::DOUBLE + exported::INT + 2 * ({_ENTRY})::INT + 1.5::DOUBLE * ({_OWN})::INT - CASE WHEN contains(file, '_test.') THEN 5 ELSE 0 END, 8)::DOUBLE score
    FROM n JOIN o USING (id) LEFT JOIN i USING (id) WHERE kind IN ('function', 'method')) SELECT * FROM s WHERE score > 0""")
def gr28_scored_entry_points(spark: Spark, d: str) -> DataFrame:
    return E.entry_points(_code_nodes(spark, d), V.edges(spark, d))


@query()
def gr30_processes(spark: Spark, d: str) -> DataFrame:
    return E.processes(_code_nodes(spark, d), V.edges(spark, d))


@query("SELECT source_id, target_id, e.kind FROM g_edges e JOIN g_nodes a ON a.id = source_id JOIN g_nodes b ON b.id = target_id WHERE e.kind IN ('calls', 'extends') AND a.kind IN ('class', 'function') AND b.kind IN ('class', 'function')")
def gr34_graph_view(spark: Spark, d: str) -> DataFrame:
    ids = V.nodes(spark, d).filter(F.col("kind").isin("class", "function")).select("id")
    e = V.edges(spark, d).filter(F.col("kind").isin("calls", "extends"))
    return e.join(ids, e["source_id"] == ids["id"], "left_semi").join(ids, e["target_id"] == ids["id"], "left_semi")


@query(f"SELECT n.id, n.name, side FROM (SELECT DISTINCT source_id id, 'caller' side FROM g_edges WHERE kind = 'calls' AND target_id = {ROOT} UNION SELECT target_id, 'callee' FROM g_edges WHERE kind = 'calls' AND source_id = {ROOT}) JOIN g_nodes n USING (id)")
def gr35_symbol_context(spark: Spark, d: str) -> DataFrame:
    e = V.edges(spark, d).filter("kind = 'calls'")
    sides = e.filter(F.col("target_id") == ROOT).select(F.col("source_id").alias("id"), F.lit("caller").alias("side")).unionByName(e.filter(F.col("source_id") == ROOT).select(F.col("target_id").alias("id"), F.lit("callee").alias("side"))).distinct()
    return V.nodes(spark, d).join(sides, "id").select("id", "name", "side")


@query("SELECT file, count(*) symbols, count(*) FILTER (exported) exported FROM g_nodes GROUP BY file")
def gr36_file_analysis(spark: Spark, d: str) -> DataFrame:
    return V.nodes(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("symbols"), F.count_if("exported").alias("exported"))


@query("SELECT id, name, file FROM g_nodes WHERE file IN (SELECT DISTINCT file FROM g_nodes WHERE line = 17)")
def gr37_branch_compare(spark: Spark, d: str) -> DataFrame:
    n = V.nodes(spark, d)
    return n.join(n.filter("line = 17").select("file").distinct(), "file", "left_semi").select("id", "name", "file")
