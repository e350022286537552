"""Queries on owners, budgets, contexts, cycles, changes and the smaller lookups of a graph service."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views as V
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import lookup as L
from ..operators import search as R
from ..operators import service as P
from ..operators import structure as S
from ..operators import traverse as T
from ..operators.sequence import call_sequence
from ..operators.steps import shared_dir
from ..sources import files as I
from ..streaming import changes as C
from ..streaming import streams as D
from .registry import query
from .relational import CHANGES
from .retrieval import _NEAR, _TEXTS, _WORDS, _bm25, _fused, _vector_of, _vectors

Spark = SparkSession
FILE = "Brand#23/STANDARD/0.go"


def _n(spark: Spark, d: str) -> DataFrame:
    return V.nodes(spark, d)


# owners and budgets

OWNERS = "# teams\n* @all\n/Brand#1 @one @two\nBrand#2*/*/3.go @three\n\nBrand#21/ @four\nBrand#3/PROMO/*.go @five\n"
_OWNED = """CASE WHEN starts_with(path, 'Brand#3/PROMO/*.go') OR regexp_matches(path, '^Brand#3/PROMO/[^/]*[.]go$') THEN ['@five'] WHEN starts_with(path, 'Brand#21') THEN ['@four'] WHEN regexp_matches(path, '^Brand#2[^/]*/[^/]*/3[.]go$') THEN ['@three']
  WHEN starts_with(path, 'Brand#1') THEN ['@one', '@two'] WHEN NOT contains(path, '/') THEN ['@all'] ELSE [] END"""


@query(f"SELECT path, array_to_string({_OWNED}, ' ') owners FROM (SELECT DISTINCT file AS path FROM g_nodes)")
def fn03_owners(spark: Spark, d: str) -> DataFrame:
    files = _n(spark, d).select(F.col("file").alias("path")).distinct()
    return files.select("path", F.array_join(P.owners_of(F.col("path"), P.owner_rules(OWNERS)), " ").alias("owners"))


@query(f"WITH o AS (SELECT path, {_OWNED} w FROM (SELECT DISTINCT file AS path FROM g_nodes)) SELECT owner, count(*) files FROM (SELECT unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS owner FROM o) GROUP BY owner")
def ag11_owner_summary(spark: Spark, d: str) -> DataFrame:
    return P.owner_summary(_n(spark, d).select(F.col("file").alias("path")).distinct(), P.owner_rules(OWNERS))


@query("""WITH RECURSIVE s AS (SELECT n_chars size, row_number() OVER (ORDER BY n_chars DESC) k FROM documents WHERE n_chars IS NOT NULL), r(k, chunk, used) AS (SELECT k, 0, size FROM s WHERE k = 1
  UNION ALL SELECT s.k, CASE WHEN r.used + s.size > 20000 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.used + s.size > 20000 THEN s.size ELSE r.used + s.size END FROM r JOIN s ON s.k = r.k + 1)
  SELECT chunk::BIGINT chunk, count(*) files, sum(size)::BIGINT bytes FROM r JOIN s USING (k) GROUP BY chunk""")
def wi09_byte_chunks(spark: Spark, d: str) -> DataFrame:
    files = V.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size")).filter("size IS NOT NULL")
    return P.byte_chunks(files, 20_000).groupBy("chunk").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


# joins with vectors, contexts

_NODE_TEXT = "concat_ws(' ', qualified_name, '(' || kind || ')', 'in ' || file, docstring)"
_NODE_WORDS = "SELECT id, {0} w FROM (SELECT id, {1} AS t FROM g_nodes)".format(_WORDS.format("t"), _NODE_TEXT)


def _texts(spark: Spark, d: str) -> DataFrame:
    c = F.col
    return _n(spark, d).select("id", X.description(c("qualified_name"), c("name"), c("kind"), c("file"), c("docstring")).alias("text"))


@query(f"SELECT n.id, n.name, n.file, distance FROM (SELECT * FROM ({_NEAR}) ORDER BY distance, id LIMIT 50) v JOIN g_nodes n ON n.id = v.id")
def jo20_nearest_nodes(spark: Spark, d: str) -> DataFrame:
    hits = R.nearest(_vectors(spark, d), _vector_of(spark, d), 50)
    return _n(spark, d).join(F.broadcast(hits), "id").select("id", "name", "file", "distance")  # 50 rows


_BM_NODES = _bm25(["bolt", "promo"]).replace(_TEXTS, _NODE_WORDS) + " ORDER BY score DESC, id LIMIT "


@query("SELECT id FROM (" + _BM_NODES + str(3) + ")")
def rm05_anchors(spark: Spark, d: str) -> DataFrame:
    return P.anchors(_texts(spark, d), "promo bolt")


def _context(most: int, least: float, kinds: str) -> str:
    walk = f"SELECT DISTINCT t id, 0.8::DOUBLE score FROM (SELECT source_id s, target_id t FROM g_edges WHERE kind IN ({kinds}) UNION SELECT target_id, source_id FROM g_edges WHERE kind IN ({kinds})) WHERE s IN (SELECT id FROM ({_BM_NODES}{3})) AND t NOT IN (SELECT id FROM ({_BM_NODES}{3}))"
    near = f"SELECT id, score FROM (SELECT id, round(1 / (1 + distance), 8) score FROM ({_NEAR}) ORDER BY distance, id LIMIT {most}) WHERE score >= {least}"
    return _fused({"bm25": _BM_NODES + str(most), "semantic": near, "graph": walk}, 60).replace("LIMIT 30", f"LIMIT {most}")


@query(_context(15, 0.2, "'calls'"))
def se12_general_context(spark: Spark, d: str) -> DataFrame:
    return P.context(_texts(spark, d), _vectors(spark, d), V.edges(spark, d), "promo bolt", _vector_of(spark, d))


@query(_context(20, 0.15, "'imports'"))
def se12_module_context(spark: Spark, d: str) -> DataFrame:
    return P.context(_texts(spark, d), _vectors(spark, d), V.edges(spark, d), "promo bolt", _vector_of(spark, d), "explore_module")


@query("SELECT id, '### ' || file || ':' || line || ' ' || name || chr(10) || coalesce(docstring, '') AS text FROM g_nodes")
def fn27_labels(spark: Spark, d: str) -> DataFrame:
    return _n(spark, d).select("id", P.labelled(F.col("file"), F.col("line"), F.col("name"), F.col("docstring")).alias("text"))


@query(f"SELECT rank, id, CASE WHEN length(text) <= 40 THEN text ELSE text[1:35] || chr(10) || '...' || chr(10) END AS short FROM (SELECT id, t AS text, file, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT h.id, h.score, {_NODE_TEXT} AS t, file FROM ({_BM_NODES}{60}) h JOIN g_nodes n ON n.id = h.id)) WHERE NOT contains(file, 'test')")
def rm17_shaped_hits(spark: Spark, d: str) -> DataFrame:
    hits = R.bm25(_texts(spark, d), "promo bolt", 60)
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # a top-k list
    shown = ranked.join(_n(spark, d).select("id", "file"), "id").join(_texts(spark, d), "id").filter(~F.col("file").contains("test"))
    return shown.select("rank", "id", X.truncated(F.col("text"), 40).alias("short"))


# cycles, communities, views


@query("""WITH RECURSIVE e AS (SELECT DISTINCT source_id s, target_id t FROM g_edges WHERE source_id <> target_id), p(path, last) AS (SELECT [s, t], t FROM e WHERE s < t UNION ALL SELECT list_append(path, e.t), e.t FROM p JOIN e ON e.s = p.last WHERE e.t > path[1] AND NOT list_contains(path, e.t) AND len(path) < 5)
  SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) length FROM p JOIN e ON e.s = p.last AND e.t = path[1] ORDER BY len(path), p.path LIMIT 100""")
def gr29_cycle_paths(spark: Spark, d: str) -> DataFrame:
    return T.cycle_paths(V.edges(spark, d)).select(F.array_join("path", ">").alias("path"), "length")


@query()
def gr16_louvain(spark: Spark, d: str) -> DataFrame:
    return S.louvain(_n(spark, d), V.edges(spark, d))


@query("WITH RECURSIVE b(node, depth) AS (SELECT 797::BIGINT, 0 UNION SELECT e.target_id, depth + 1 FROM b JOIN g_edges e ON e.source_id = b.node WHERE e.kind = 'calls' AND depth < 5) SELECT DISTINCT file AS participant FROM g_nodes WHERE id IN (SELECT unnest([source_id, target_id]) FROM g_edges WHERE kind = 'calls' AND source_id IN (SELECT node FROM b))")
def gr12_participants(spark: Spark, d: str) -> DataFrame:
    m = T.messages(_n(spark, d), V.edges(spark, d), 797, 6)
    return m.select(F.explode(F.array("from_file", "to_file")).alias("participant")).distinct()


@query()
def gr12_call_sequence(spark: Spark, d: str) -> DataFrame:
    return call_sequence(_n(spark, d), V.edges(spark, d), 797)


_SHOWN = "n AS (SELECT * FROM g_nodes WHERE kind IN ('class', 'function')), e AS (SELECT * FROM g_edges WHERE kind IN ('calls', 'extends') AND source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)), c AS (SELECT source_id id FROM e UNION SELECT target_id FROM e)"


def _shown(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    n = L.where(_n(spark, d), kind=["class", "function"])
    return n, L.within(L.where(V.edges(spark, d), kind=["calls", "extends"]), n)


@query(f"WITH {_SHOWN} SELECT id, name, kind FROM n WHERE id IN (SELECT id FROM c) ORDER BY id LIMIT 500")
def gr34_view_nodes(spark: Spark, d: str) -> DataFrame:
    n, e = _shown(spark, d)
    return L.page(L.connected_only(n, e), ["id"], 500).select("id", "name", "kind")


@query(f"WITH {_SHOWN} SELECT (SELECT count(*) FROM n) n_nodes, (SELECT count(*) FROM e) n_edges, (SELECT count(*) FROM c) connected")
def gr34_view_stats(spark: Spark, d: str) -> DataFrame:
    n, e = _shown(spark, d)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(n, "n_nodes").crossJoin(one(e, "n_edges")).crossJoin(one(L.connected_only(n, e), "connected"))  # single rows


@query(f"SELECT id, name, line, exported FROM g_nodes WHERE file = '{FILE}' ORDER BY line, id LIMIT 50")
def gr36_file_symbols(spark: Spark, d: str) -> DataFrame:
    return L.page(L.where(_n(spark, d), file=FILE), ["line", "id"], 50).select("id", "name", "line", "exported")


# diffs and changes

_DIFF = "SELECT file, CASE length(file) % 4 WHEN 0 THEN 'M' || chr(9) || file WHEN 1 THEN 'A' || chr(9) || file WHEN 2 THEN 'D' || chr(9) || file ELSE 'R090' || chr(9) || 'old/' || file || chr(9) || file END AS value FROM (SELECT DISTINCT file FROM g_nodes)"
_CHANGED = "SELECT file, CASE length(file) % 4 WHEN 0 THEN 'modified' WHEN 2 THEN 'deleted' ELSE 'added' END change FROM (SELECT DISTINCT file FROM g_nodes) UNION ALL SELECT 'old/' || file, 'deleted' FROM (SELECT DISTINCT file FROM g_nodes) WHERE length(file) % 4 = 3"


def _diff(spark: Spark, d: str) -> DataFrame:
    value = "CASE length(file) % 4 WHEN 0 THEN concat('M\t', file) WHEN 1 THEN concat('A\t', file) WHEN 2 THEN concat('D\t', file) ELSE concat('R090\told/', file, '\t', file) END AS value"
    return _n(spark, d).select("file").distinct().selectExpr(value)


@query(_CHANGED)
def sc20_changed_files(spark: Spark, d: str) -> DataFrame:
    return P.changed_files(_diff(spark, d))


@query(f"SELECT id, name, n.file, 'changed' status FROM g_nodes n JOIN ({_CHANGED}) c ON c.file = n.file WHERE change = 'modified'")
def gr37_branch_symbols(spark: Spark, d: str) -> DataFrame:
    changed = P.changed_files(_diff(spark, d)).filter("change = 'modified'").select("file").distinct()
    return _n(spark, d).join(changed, "file", "left_semi").select("id", "name", "file", F.lit("changed").alias("status"))


@query("SELECT user_id AS path, arg_min(CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'changed' END, event_id) change FROM (SELECT event_id, event_type, 'u' || user_id AS user_id FROM events WHERE event_type <> 'view') GROUP BY user_id")
def sr03_journal(spark: Spark, d: str) -> DataFrame:
    value = "CASE event_type WHEN 'error' THEN concat('DELETED u', user_id) WHEN 'view' THEN '# seen' ELSE concat('u', user_id) END AS value"
    head = spark.createDataFrame([(0, f"{D.HEADER} 17")], "pos long, value string")
    return D.read_journal(head.unionByName(V.table(spark, d, "events").selectExpr("event_id + 1 AS pos", value)))


@query(f"""WITH RECURSIVE f AS (SELECT DISTINCT a.file s, b.file t, g_edges.kind = 'imports' imp FROM g_edges JOIN g_nodes a ON a.id = source_id JOIN g_nodes b ON b.id = target_id WHERE a.file <> b.file),
  b(node, depth) AS (SELECT '{FILE}', 0 UNION SELECT f.s, depth + 1 FROM b JOIN f ON f.t = b.node AND imp WHERE depth < 4)
  SELECT node AS file FROM b WHERE depth > 0 AND node <> '{FILE}' UNION SELECT t FROM f WHERE s = '{FILE}' UNION SELECT s FROM f WHERE t = '{FILE}'
  UNION SELECT a.file FROM g_edges e JOIN g_nodes a ON a.id = source_id JOIN g_nodes b ON b.id = target_id WHERE e.kind = 'imports' AND b.qualified_name LIKE 'Brand#23.%'""")
def sr05_write_set(spark: Spark, d: str) -> DataFrame:
    return P.write_set(_n(spark, d), V.edges(spark, d), FILE, "Brand#23.%")


@query("SELECT event_id, user_id, 'created' change FROM events WHERE event_type = 'signup'")
def sr07_pushed_deltas(spark: Spark, d: str) -> DataFrame:
    new = D.event_stream(spark, d).filter("event_type = 'signup'")
    return D.drain(new.select("event_id", "user_id", F.lit("created").alias("change")), "append")


@query("SELECT user_id, count(*) builds FROM events GROUP BY user_id")
def sr08_watch_and_build(spark: Spark, d: str) -> DataFrame:
    built = D.built(D.event_stream(spark, d).select("user_id", "event_id"), lambda batch: batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("builds")))
    return built.groupBy("user_id").agg(F.sum("builds").alias("builds"))


@query("SELECT user_id, count(*) n FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def sk07_fan_out(spark: Spark, d: str) -> DataFrame:
    sinks = D.fanned_out(D.event_stream(spark, d), {"purchases": "event_type = 'purchase'", "errors": "event_type = 'error'"})
    return sinks["purchases"].groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


_SIZES = CHANGES.replace(" change FROM", " change, coalesce(n.size, 0) - coalesce(o.size, 0) grown FROM")


@query(f"SELECT change, count(*) n, sum(grown)::BIGINT grown FROM ({_SIZES}) GROUP BY change")
def sr09_summary(spark: Spark, d: str) -> DataFrame:
    return C.summary(C.detect(V.manifest(spark, d, False), V.manifest(spark, d, True)))


@query(f"SELECT path FROM ({CHANGES}) WHERE change IN ('added', 'modified')")
def sr09_changed(spark: Spark, d: str) -> DataFrame:
    return C.changed(C.detect(V.manifest(spark, d, False), V.manifest(spark, d, True)))


@query(f"SELECT count(*) FILTER (change IN ('added', 'modified', 'removed')) n_changed, count(*) FILTER (change IN ('added', 'modified', 'removed')) > 500 rebuild FROM ({CHANGES})")
def sr09_rebuild(spark: Spark, d: str) -> DataFrame:
    return C.needs_rebuild(C.detect(V.manifest(spark, d, False), V.manifest(spark, d, True)))


@query("SELECT doc_id, len(l) - CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS \"equal\", CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS \"insert\", CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS \"delete\", CASE WHEN doc_id % 7 = 0 THEN '-' || l[len(l)] || chr(10) || '+' || l[len(l)] || '!' ELSE '' END hunks FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) l FROM documents)")
def fn26_line_diff(spark: Spark, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").withColumn("old", F.coalesce("text", F.lit(""))).withColumn("new", F.when(F.col("doc_id") % 7 == 0, F.concat("old", F.lit("!"))).otherwise(F.col("old")))
    return docs.select("doc_id", P.line_diff(F.col("old"), F.col("new")).alias("x")).select("doc_id", "x.*")


@query()
def fn26_document_diff(spark: Spark, d: str) -> DataFrame:
    """Each document against the one of the next id."""
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("new")), "doc_id")
    return pairs.select("doc_id", P.line_diff(F.col("text"), F.col("new")).alias("x")).select("doc_id", "x.*")


# exports and snapshots


@query("""SELECT '{"id":' || id || ',"name":"' || name || '","kind":"' || kind || '","file":"' || file || '","exported":' || exported || '}' AS line FROM g_nodes""")
def sk05_export_json(spark: Spark, d: str) -> DataFrame:
    return I.json_lines(_n(spark, d), ["id", "name", "kind", "file", "exported"])


@query("SELECT * FROM (VALUES ('a', 5), ('c', 25)) t(version, n)")
def sk06_snapshots(spark: Spark, d: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/snapshots/{uuid.uuid4().hex}"
    for name, table in (("a", "region"), ("b", "region"), ("c", "nation")):
        I.save_snapshot(V.table(spark, d, table), folder, name)
    I.delete_snapshot(spark, folder, "b")
    sizes = {name: I.load_snapshot(spark, folder, name).count() for name in I.snapshots(spark, folder)}
    return spark.createDataFrame(sorted(sizes.items()), "version string, n int")


# repository helpers

_COMMUNITY = "SELECT id, CASE WHEN id % 3 = 0 THEN id % 10 END community FROM g_nodes"


@query("SELECT n.id, coalesce(CASE WHEN n.id % 3 = 0 THEN n.id % 10 END, 0) community FROM g_nodes n WHERE kind IN ('class', 'method')")
def rm01_communities(spark: Spark, d: str) -> DataFrame:
    n = L.where(_n(spark, d), kind=["class", "method"]).select("id")
    known = _n(spark, d).filter("id % 3 = 0").select(F.col("id").alias("node"), (F.col("id") % 10).alias("c"))
    return J.left_default(n, known, "id", "node", "c", 0, "community").select("id", "community")


@query("SELECT w.id, name, CAST(size AS BIGINT) size FROM (SELECT unnest(range(0, 400, 7)) id) w LEFT JOIN (SELECT p_partkey id, p_name AS name, p_size size FROM part) USING (id)")
def rm02_by_keys(spark: Spark, d: str) -> DataFrame:
    parts = V.table(spark, d, "part").selectExpr("p_partkey AS id", "p_name AS name", "CAST(p_size AS BIGINT) AS size")
    return spark.range(0, 400, 7).join(parts, "id", "left")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'new' ELSE source END AS source FROM documents WHERE lang IS NOT NULL OR true")
def rm03_replaced(spark: Spark, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", "lang", "source")
    return D.replaced(docs, docs.filter("lang = 'en'").withColumn("source", F.lit("new")), "doc_id").select("doc_id", "source")


@query("SELECT label AS model, count(*) n FROM embeddings WHERE label <> 3 GROUP BY label")
def rm04_models(spark: Spark, d: str) -> DataFrame:
    kept = V.table(spark, d, "embeddings").filter("label <> 3")
    return kept.groupBy(F.col("label").alias("model")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH i AS (SELECT p_partkey id, 'src/' || p_brand || '/a.ts' f, CASE p_partkey % 5 WHEN 0 THEN '@app/x' || p_size WHEN 1 THEN './y' || p_size WHEN 2 THEN '../z/./w' WHEN 3 THEN 'pkg' || p_size ELSE 'lib' || p_size END p, p_brand b, p_size z FROM part)
  SELECT id, CASE id % 5 WHEN 0 THEN 'src/app/x' || z WHEN 1 THEN 'src/' || b || '/y' || z WHEN 2 THEN 'src/z/w' WHEN 3 THEN CASE WHEN z <= 25 THEN 'packages/pkg' || z ELSE p END ELSE p END resolved, CASE WHEN id % 5 < 3 THEN 1.0 WHEN id % 5 = 3 AND z <= 25 THEN 0.8 ELSE 0.5 END::DOUBLE confidence,
    CASE id % 5 WHEN 0 THEN 'src/app/x' || z WHEN 1 THEN 'src/' || b || '/y' || z WHEN 2 THEN 'src/z/w' WHEN 3 THEN CASE WHEN z <= 25 THEN 'packages/pkg' || z ELSE p END ELSE p END || '.ts' first_file FROM i""")
def rm06_resolved_imports(spark: Spark, d: str) -> DataFrame:
    path = "CASE p_partkey % 5 WHEN 0 THEN concat('@app/x', p_size) WHEN 1 THEN concat('./y', p_size) WHEN 2 THEN '../z/./w' WHEN 3 THEN concat('pkg', p_size) ELSE concat('lib', p_size) END"
    i = V.table(spark, d, "part").selectExpr("p_partkey AS id", "concat('src/', p_brand, '/a.ts') AS file", f"{path} AS path")
    known = lambda p: p.rlike(r"^packages/pkg([1-9]|1[0-9]|2[0-5])$")
    where, sure = P.resolved_import(F.col("path"), F.col("file"), [("^@app/(.*)$", "src/app")], ["packages/*"], known)
    return i.select("id", where.alias("resolved"), sure.alias("confidence")).withColumn("first_file", P.possible_files(F.col("resolved"))[0])


@query("""WITH j AS (SELECT event_id pos, user_id AS path, CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'added' WHEN 'purchase' THEN 'modified' END change FROM events), l AS (SELECT path, arg_max(change, pos) change FROM j WHERE change IS NOT NULL GROUP BY path)
  SELECT l.path, change, CASE WHEN change <> 'added' THEN hash END old_hash FROM l LEFT JOIN manifest_old o ON o.path = l.path""")
def rm07_replayed(spark: Spark, d: str) -> DataFrame:
    op = "CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'update' ELSE 'look' END AS operation"
    return P.replayed(V.table(spark, d, "events").selectExpr("event_id AS pos", "user_id AS path", op), V.manifest(spark, d, False))


@query("SELECT id, CASE WHEN exported THEN 'Entry point - high fan-out, initiates operations' WHEN kind = 'method' THEN 'Leaf node - low fan-out, terminal operations' ELSE 'Unknown role' END role_text, CASE WHEN exported THEN 'High risk - many components depend on this' ELSE 'Low risk - safe to modify' END risk_text FROM g_nodes")
def rm08_descriptions(spark: Spark, d: str) -> DataFrame:
    role = F.when(F.col("exported"), "entry").when(F.col("kind") == "method", "leaf").otherwise("other")
    risk = F.when(F.col("exported"), "high").otherwise("low")
    return _n(spark, d).select("id", P.described(role, P.ROLE_TEXTS, "Unknown role").alias("role_text"), P.described(risk, P.RISK_TEXTS, "Unknown risk level").alias("risk_text"))


@query(r"""WITH l AS (SELECT doc_id id, regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '^\s+|\s+$', '', 'g') s FROM documents)
  SELECT id, count(*) FILTER (regexp_matches(s, '^(if |if\(|for |for\(|while |while\(|switch |switch\(|try |try\{|catch |catch\(|except |except\(|loop |loop\{|select |select\{)')) opening, count(*) FILTER (regexp_matches(s, '^(else |else\{|else if|elif |elif\(|except |except\(|case |default )')) branches, count(*) FILTER (ends_with(s, '}')) closing FROM l GROUP BY id""")
def rm09_line_kinds(spark: Spark, d: str) -> DataFrame:
    lines = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("s")).withColumn("s", X.bare(F.col("s")))
    return lines.groupBy("id").agg(F.count_if(X.starts_with_any(F.col("s"), X.CONTROL)).alias("opening"), F.count_if(X.starts_with_any(F.col("s"), X.BRANCHES)).alias("branches"), F.count_if(F.col("s").endswith("}")).alias("closing"))


@query("SELECT l_orderkey process_id, count(*) steps, CAST(min(l_partkey) AS BIGINT) entry FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) k FROM lineitem) GROUP BY l_orderkey HAVING count(*) >= 3")
def rm12_processes(spark: Spark, d: str) -> DataFrame:
    steps = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("process_id"), F.col("l_partkey").alias("id"))
    return steps.groupBy("process_id").agg(F.count(F.lit(1)).alias("steps"), F.min("id").alias("entry")).filter("steps >= 3")


@query(f"SELECT id, (row_number() OVER (ORDER BY id) - 1) // 50 batch, {_NODE_TEXT} AS text FROM g_nodes WHERE kind IN ('class', 'interface')")
def rm14_text_batches(spark: Spark, d: str) -> DataFrame:
    wanted = _texts(spark, d).join(L.where(_n(spark, d), kind=["class", "interface"]).select("id"), "id", "left_semi")
    ranked = A.global_rank(wanted.withColumn("__range", F.expr("id div 10000")), ["__range", "id"], "place")
    return ranked.select("id", F.expr("(place - 1) div 50").alias("batch"), "text")


@query("SELECT user_id session, event_type AS file, min(event_id) first, count(*) - 1 skipped FROM events GROUP BY user_id, event_type HAVING event_type <> 'view'")
def rm15_backups(spark: Spark, d: str) -> DataFrame:
    e = V.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("file"), "event_id")
    n = e.groupBy("session", "file").agg((F.count(F.lit(1)) - 1).alias("skipped"))
    reverted = spark.createDataFrame([("view",)], "file string")
    kept = P.first_backups(e, ["session", "file"], ["event_id"]).join(reverted, "file", "left_anti")
    return kept.join(n, ["session", "file"]).select("session", "file", F.col("event_id").alias("first"), "skipped")
