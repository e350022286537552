"""Queries on search, text functions, mining, sources and sinks, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views as V
from ..functions import text as X
from ..functions import pieces as P
from ..functions import stem as S
from ..operators import assembly as A
from ..operators import fulltext as FT
from ..operators import mining as M
from ..operators import search as R
from ..sources import files as I
from ..streaming import changes as C
from ..streaming import streams as T
from ..operators.steps import fresh_dir
from .registry import query

Spark = SparkSession
_WORDS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
_TEXTS = "SELECT doc_id id, {0} w FROM documents".format(_WORDS.format("text"))


def _docs(spark: Spark, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark: Spark, d: str) -> DataFrame:
    return V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _vector_of(spark: Spark, d: str) -> list[float]:
    return [float(x) for x in _vectors(spark, d).filter("id = 7").first()["v"]]


_KEYWORD = "SELECT id, row_number() OVER (ORDER BY tier, name, id) AS rank FROM (SELECT id, name, CASE WHEN lower(name) = 'blue bolt' THEN 0 WHEN starts_with(lower(name), 'bolt') THEN 1 ELSE 2 END tier FROM g_nodes WHERE name ILIKE '%bolt%')"


@query("SELECT id, CAST(rank AS INTEGER) AS rank, round(1 - 0.01 * (rank - 1), 2)::DOUBLE score FROM (" + _KEYWORD.replace("= 'blue bolt'", "= 'bolt'") + ") WHERE rank <= 30")
def se01_keyword(spark: Spark, d: str) -> DataFrame:
    return R.keyword(V.nodes(spark, d), "bolt", 30)


@query("SELECT id, name, CASE WHEN lower(name) = 'blue' THEN 'exact' WHEN starts_with(lower(name), 'blue') THEN 'prefix' ELSE 'partial' END AS match, (CASE WHEN lower(name) = 'blue' THEN 3.0 WHEN starts_with(lower(name), 'blue') THEN 2.0 ELSE 1.0 END + CASE WHEN exported THEN 0.5 ELSE 0.0 END)::DOUBLE score FROM g_nodes WHERE name ILIKE '%blue%' ORDER BY score DESC, name, id LIMIT 40")
def se02_symbols(spark: Spark, d: str) -> DataFrame:
    return R.symbols(V.nodes(spark, d), "blue", 40)


def _bm25(terms: list[str]) -> str:
    terms = sorted(terms)
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}'))::DOUBLE t{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (t{i} > 0)::DOUBLE d{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6::DOUBLE) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(terms)))
    where = " AND ".join(f"t{i} > 0" for i in range(len(terms)))
    return f"SELECT id, round({score}, 8)::DOUBLE score FROM (SELECT id, len(w)::DOUBLE l, {tf} FROM ({_TEXTS})), (SELECT count(*)::DOUBLE n, avg(l) a, {df} FROM (SELECT len(w)::DOUBLE l, {tf} FROM ({_TEXTS}))) WHERE {where}"


@query(_bm25(["the", "was"]) + " ORDER BY score DESC, id LIMIT 50")
def se03_bm25(spark: Spark, d: str) -> DataFrame:
    return R.bm25(_docs(spark, d), "was the", 50)


@query(f"SELECT word, count(*) docs, sum(n)::BIGINT occurrences FROM (SELECT id, unnest(w) word, 1 n FROM ({_TEXTS})) GROUP BY word HAVING count(*) >= 50".replace("count(*) docs", "count(DISTINCT id) docs"))
def se04_word_index(spark: Spark, d: str) -> DataFrame:
    return _docs(spark, d).select("id", F.explode(X.words("text")).alias("word")).groupBy("word", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("occurrences")).filter("occurrences >= 50")


@query(f"SELECT id, len(w) n_words, CAST(len(list_distinct(w)) AS BIGINT) n_distinct FROM ({_TEXTS})")
def se05_tokenizer(spark: Spark, d: str) -> DataFrame:
    w = X.words(F.coalesce("text", F.lit("")))
    return _docs(spark, d).select("id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


def _phrased(docs: str) -> str:
    """BM25 over docs of the phrase `of the` and the word `and`, by word lists."""
    hits = {"t0": "len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))", "t1": "len(list_filter(w, lambda x: x = 'and'))"}
    tf = f"SELECT id, len(w)::DOUBLE l, {', '.join(f'{v}::DOUBLE {k}' for k, v in hits.items())} FROM ({docs})"
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6::DOUBLE) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(2))
    return f"WITH tf AS ({tf}) SELECT id, round({score}, 8)::DOUBLE score FROM tf, (SELECT count(*)::DOUBLE n, avg(l) a, count(*) FILTER (t0 > 0)::DOUBLE d0, count(*) FILTER (t1 > 0)::DOUBLE d1 FROM tf) WHERE t0 > 0 AND t1 > 0"


@query(_bm25(["the", "was"]) + " ORDER BY score DESC, id LIMIT 50")
def se03_index_top(spark: Spark, d: str) -> DataFrame:
    held = FT.Index(spark, fresh_dir(spark), S.plain)
    held.upsert(_docs(spark, d))
    return held.search("was the", 50)


@query(_phrased(_TEXTS))
def se03_index_phrases(spark: Spark, d: str) -> DataFrame:
    held = FT.Index(spark, fresh_dir(spark), S.plain)
    held.upsert(_docs(spark, d))
    return held.search('"of the" and')


def _changed_index(spark: Spark, d: str) -> FT.Index:
    """An index of documents that came to be what they are by two rounds of changes."""
    held, docs = FT.Index(spark, fresh_dir(spark), S.plain), _docs(spark, d)
    passing = docs.filter("id % 5 = 1").withColumn("id", -F.col("id"))
    held.upsert(docs.filter("id % 10 <> 9").withColumn("text", F.when(F.col("id") % 7 == 0, F.concat(F.lit("of the old and of the new "), "text")).otherwise(F.col("text"))).unionByName(passing))
    held.upsert(docs.filter("id % 7 = 0 or id % 10 = 9").withColumn("text", F.when(F.col("id") % 3 == 0, F.lit("and of the moment")).otherwise(F.col("text"))), removed=passing)
    held.upsert(docs.filter("id % 3 = 0"), removed=passing.withColumn("id", F.col("id") - 1))
    return held


@query(_phrased(_TEXTS))
def se04_index_synced(spark: Spark, d: str) -> DataFrame:
    return _changed_index(spark, d).search('"of the" and')


@query(_bm25(["the", "was"]) + " ORDER BY score DESC, id LIMIT 50")
def se04_index_compacted(spark: Spark, d: str) -> DataFrame:
    return _changed_index(spark, d).compact(fresh_dir(spark)).search("was the", 50)


@query()
def se05_stems(spark: Spark, d: str) -> DataFrame:
    return _docs(spark, d).mapInArrow(FT.tokenised(S.stems), "id long, n_tokens int, stems string")


_NEAR = "SELECT vec_id id, round(sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 8) distance FROM embeddings"


@query(f"SELECT id, distance, round(1 / (1 + distance), 8) score FROM ({_NEAR}) ORDER BY distance, id LIMIT 25")
def se06_nearest(spark: Spark, d: str) -> DataFrame:
    return R.nearest(_vectors(spark, d), _vector_of(spark, d), 25)


@query(f"SELECT id // 4 id, max(score) score FROM (SELECT id, round(1 / (1 + distance), 8) score FROM ({_NEAR}) ORDER BY distance, id LIMIT 60) GROUP BY 1 ORDER BY score DESC, id LIMIT 20")
def se07_best_chunks(spark: Spark, d: str) -> DataFrame:
    hits = R.nearest(_vectors(spark, d), _vector_of(spark, d), 60)
    return R.best_per_key(hits, F.expr("id div 4"), 20)


def _fused(sources: dict[str, str], k: int) -> str:
    union = " UNION ALL ".join(f"SELECT id, score, '{s}' source FROM ({q})" for s, q in sources.items())
    return f"SELECT id, round(sum(1.0::DOUBLE / ({k} + r)), 10) score, array_to_string(list_sort(list_distinct(list(source))), '+') source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) r FROM ({union})) GROUP BY id ORDER BY score DESC, id LIMIT 30"


_LIKE = "SELECT doc_id id, 1.0::DOUBLE score FROM documents WHERE text ILIKE '%was%' ORDER BY id LIMIT 50"
_KNN = f"SELECT id, round(1 / (1 + distance), 8) score FROM ({_NEAR}) ORDER BY distance, id LIMIT 50"
_BM = _bm25(["the", "was"]) + " ORDER BY score DESC, id LIMIT 50"


def _like(spark: Spark, d: str) -> DataFrame:
    return _docs(spark, d).filter(F.col("text").ilike("%was%")).select("id", F.lit(1.0).alias("score")).orderBy("id").limit(50)


@query(_fused({"keyword": _LIKE, "semantic": _KNN}, 60))
def se08_hybrid(spark: Spark, d: str) -> DataFrame:
    return R.fuse({"keyword": _like(spark, d), "semantic": R.nearest(_vectors(spark, d), _vector_of(spark, d), 50)}, limit=30)


@query(_fused({"bm25": _BM, "semantic": _KNN}, 20))
def se09_hybrid_bm25(spark: Spark, d: str) -> DataFrame:
    return R.fuse({"bm25": R.bm25(_docs(spark, d), "was the", 50), "semantic": R.nearest(_vectors(spark, d), _vector_of(spark, d), 50)}, k=20, limit=30)


_Q1, _Q2 = _bm25(["and", "with"]) + " ORDER BY score DESC, id LIMIT 50", _bm25(["for", "this"]) + " ORDER BY score DESC, id LIMIT 50"


@query(_fused({"q1": _BM, "q2": _Q1, "q3": _Q2}, 60))
def se10_multi_query(spark: Spark, d: str) -> DataFrame:
    lists = R.bm25_of_each(_docs(spark, d), ["was the", "and with", "for this"], 50)
    return R.fuse({f"q{k}": hits for k, hits in enumerate(lists, 1)}, limit=30)


@query(_fused({"bm25": _BM, "keyword": _LIKE, "semantic": _KNN}, 60))
def se11_context(spark: Spark, d: str) -> DataFrame:
    return R.fuse({"bm25": R.bm25(_docs(spark, d), "was the", 50), "keyword": _like(spark, d), "semantic": R.nearest(_vectors(spark, d), _vector_of(spark, d), 50)}, limit=30)


@query(f"WITH hits AS ({_BM}), t AS (SELECT id, score, CAST(floor(octet_length(encode(text)) * 0.25) AS INTEGER) tokens FROM hits JOIN documents ON doc_id = id) SELECT id, score, tokens, used FROM (SELECT *, sum(tokens) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)::BIGINT used FROM t) WHERE used <= 20000")
def se13_assembly(spark: Spark, d: str) -> DataFrame:
    docs = _docs(spark, d)
    hits = R.bm25(docs, "was the", 50).join(docs, "id").select("id", "score", X.tokens_of_bytes(F.col("text"), 4).alias("tokens"))
    return R.within_budget(hits, 20000)


@query("SELECT id, round(least(1.0, (contains(t, 'was')::INT + contains(t, 'the')::INT) / 2.0 + CASE WHEN contains(t, 'was the') THEN 0.3 ELSE 0.0 END), 8)::DOUBLE score FROM (SELECT doc_id id, lower(coalesce(text, '')) t FROM documents)")
def se14_rerank(spark: Spark, d: str) -> DataFrame:
    return R.rerank(_docs(spark, d), "was the").select("id", "score")


@query()
def fn08_structured_pieces(spark: Spark, d: str) -> DataFrame:
    rows = _docs(spark, d).select("id", F.explode(P.text_pieces(F.col("text"), F.concat(F.lit("doc "), "id"), 400)).alias("p"))
    return rows.select("id", "p.index", F.md5("p.text").alias("md5"), "p.is_original")


def _hits(spark: Spark, d: str) -> DataFrame:
    """For each scope as a query its symbols as hits, best first, with documents as their contents."""
    nodes = V.nodes(spark, d)
    source = F.when(F.col("id") % 4 == 0, "keyword").when(F.col("id") % 4 == 1, "graph:calls").when(F.col("id") % 4 == 2, "graph:called_by").otherwise("imports")
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.col("id") % 7, "id"))
    hits = nodes.select(F.col("scope").alias("query"), rank.alias("rank"), "file", (F.col("line") % 9).alias("line"), "name", "kind", source.alias("source"), (F.col("id") % 4).cast("int").alias("depth"), "id")
    return hits.filter("rank <= 25").join(_docs(spark, d).withColumnRenamed("text", "content"), "id", "left").drop("id")


@query()
def se13_sections(spark: Spark, d: str) -> DataFrame:
    return A.assembled(_hits(spark, d), "understand_function").withColumn("content", F.md5("content"))


@query()
def se13_sections_passed_on(spark: Spark, d: str) -> DataFrame:
    return A.assembled(_hits(spark, d), "change_impact", budget=3000, pass_on=True).withColumn("content", F.md5("content"))


@query(f"SELECT id, array_to_string(list_transform(string_split('0123456789abcdef', ''), lambda c: CAST(len(list_filter(w, lambda x: md5(x)[1] = c)) AS VARCHAR)), ',') AS counts FROM ({_TEXTS})")
def se15_hashed_embedding(spark: Spark, d: str) -> DataFrame:
    n = F.array(F.greatest(F.size(X.words(F.coalesce("text", F.lit("")))), F.lit(1)))
    counts = F.transform(n, lambda n: F.transform(R.hashed_embedding(F.col("text")), lambda x: F.round(x * n).cast("int").cast("string")))[0]
    return _docs(spark, d).select("id", F.array_join(counts, ",").alias("counts"))


@query("SELECT label, count(*) n, min(len(embedding))::INT dims FROM embeddings GROUP BY label")
def se16_embedding_admin(spark: Spark, d: str) -> DataFrame:
    return V.table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("dims"))


# scalar functions, over page sources as code

_CODE = "SELECT page_id id, coalesce(html, '') c FROM pages"


def _code(spark: Spark, d: str) -> DataFrame:
    return V.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.coalesce("html", F.lit("")).alias("c"))


_QUOTED = "array_to_string(list_transform(" + _WORDS.format("text") + ", lambda w: chr(34) || w || chr(34)), ' ')"
_PLAIN = r"trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, role, {_QUOTED} AS query, {_PLAIN} plain FROM conversations")
def fn04_query_words(spark: Spark, d: str) -> DataFrame:
    return V.table(spark, d, "conversations").select("conv_id", "turn", "role", X.quoted_query(F.col("text")).alias("query"), X.plain_query(F.col("text")).alias("plain"))


@query("SELECT doc_id, CAST(floor(octet_length(encode(text)) / 2.5) AS INTEGER) tokens, CASE WHEN length(text) <= 400 THEN text ELSE text[1:295] || chr(10) || '...' || chr(10) || text[-100:] END short FROM documents")
def fn06_tokens_and_truncation(spark: Spark, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", X.tokens_of_bytes(F.col("text")).alias("tokens"), X.truncated(F.col("text"), 400).alias("short"))


@query("SELECT id, concat_ws(' ', CASE WHEN kind IN ('function', 'method') THEN 'func' WHEN kind IN ('class', 'interface') THEN kind ELSE 'symbol' END, qualified_name) signature, concat_ws(' ', qualified_name, '(' || kind || ')', 'in ' || file, docstring) description FROM g_nodes")
def fn09_descriptions(spark: Spark, d: str) -> DataFrame:
    c = F.col
    return V.nodes(spark, d).select("id", X.signature(c("kind"), c("qualified_name"), c("name")).alias("signature"), X.description(c("qualified_name"), c("name"), c("kind"), c("file"), c("docstring")).alias("description"))


@query("SELECT doc_id, sha256(text) sha, md5(text) md, sha256(text)[1:16] short FROM documents")
def fn11_hashes(spark: Spark, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"), F.substring(F.sha2("text", 256), 1, 16).alias("short"))


@query(r"SELECT page_id, regexp_extract(url, '(?s)^(.*)/[^/]*$', 1) dir, regexp_extract(url, '([^/]*)$', 1) base, lower(regexp_extract(url, '(\.[^./]*)$', 1)) ext FROM pages")
def fn12_paths(spark: Spark, d: str) -> DataFrame:
    return V.table(spark, d, "pages").select("page_id", X.directory(F.col("url")).alias("dir"), X.basename(F.col("url")).alias("base"), X.extension(F.col("url")).alias("ext"))


_LANG = "CASE page_id % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'rust' WHEN 2 THEN 'python' ELSE 'java' END lang"


def _code_with_language(spark: Spark, d: str) -> DataFrame:
    return V.table(spark, d, "pages").selectExpr("page_id AS id", "coalesce(html, '') AS c", _LANG.replace(" END lang", " END AS lang"))


def _occ(parts, text: str = "c") -> str:
    return " + ".join(f"(length({text}) - length(replace({text}, '{p}', ''))) // {len(p)}" for p in parts)


# the checks' own word lists, kept apart from those of the functions
_DECIDING = ["if ", "if(", "else if", "elif ", "elif(", "for ", "for(", "while ", "while(", "switch ", "switch(", "case ", "catch ", "catch(", "except ", "except(", "&&", "||", "and ", "or ", "?"]


@query(f"""SELECT id, CAST(1 + {_occ(_DECIDING)} + CASE lang WHEN 'go' THEN {_occ(["select ", "select{"])} WHEN 'rust' THEN {_occ(["match ", "match{", "loop "])} WHEN 'python' THEN {_occ(["for ", "in "])} ELSE 0 END AS INTEGER) cyclomatic
  FROM (SELECT page_id id, coalesce(html, '') c, {_LANG} FROM pages)""")
def fn14_cyclomatic(spark: Spark, d: str) -> DataFrame:
    return _code_with_language(spark, d).select("id", X.cyclomatic(F.col("c"), F.col("lang")).alias("cyclomatic"))


_BARE = r"list_transform(string_split(c, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g'))"
_OPENS = r"'^(if |if\(|for |for\(|while |while\(|switch |switch\(|try |try\{|catch |catch\(|except |except\(|loop |loop\{|select |select\{)'"
_ELSES = r"'^(else |else\{|else if|elif |elif\(|except |except\(|case |default )'"


@query(rf"""WITH p AS (SELECT page_id id, coalesce(html, '') c, {_LANG} FROM pages), b AS (SELECT id, lang, {_BARE} l, list_filter(string_split(c, chr(10)), lambda s: NOT regexp_matches(s, '^\s*(//|#|/\*)')) o FROM p)
  SELECT id, list_reduce(list_transform(l, lambda s: {{'n': 0, 'open': starts_with(s, '/*'), 'close': contains(s, '*/'), 'plain': s <> '' AND NOT regexp_matches(s, '^(//|#|--)'), 'in': false}}), lambda a, x: {{'n': a.n + CASE WHEN NOT a.in AND NOT x.open AND x.plain THEN 1 ELSE 0 END, 'open': false, 'close': false, 'plain': false, 'in': (a.in OR x.open) AND NOT x.close}}, {{'n': 0, 'open': false, 'close': false, 'plain': false, 'in': false}}).n "lines",
    greatest(list_reduce(list_transform(regexp_extract_all(array_to_string(o, ''), '[{{}}]'), lambda s: {{'d': CASE s WHEN '{{' THEN 1 ELSE -1 END, 'm': 0}}), lambda a, x: {{'d': greatest(a.d + x.d, 0), 'm': greatest(a.m, a.d + x.d)}}, {{'d': 0, 'm': 0}}).m,
      CASE lang WHEN 'python' THEN coalesce(list_max(list_transform(o, lambda s: CAST(length(regexp_extract(s, '^[ \t]*')) // 4 AS INTEGER))), 0) ELSE 0 END) nesting,
    CAST(list_reduce(list_transform(l, lambda s: {{'s': 0::BIGINT, 'd': 0, 'st': regexp_matches(s, {_OPENS})::INTEGER, 'en': ends_with(s, '}}')::INTEGER, 'add': CAST(regexp_matches(s, {_ELSES})::INTEGER + {_occ(["&&", "||", "and ", "or "], "s")} AS BIGINT)}}),
      lambda a, x: {{'s': a.s + x.add + x.st * (1 + a.d), 'd': greatest(0, a.d + x.st - x.en), 'st': 0, 'en': 0, 'add': 0::BIGINT}}, {{'s': 0::BIGINT, 'd': 0, 'st': 0, 'en': 0, 'add': 0::BIGINT}}).s AS INTEGER) cognitive FROM b""")
def fn13_code_metrics(spark: Spark, d: str) -> DataFrame:
    c, lang = F.col("c"), F.col("lang")
    return _code_with_language(spark, d).select("id", X.code_lines(c).alias("lines"), X.nesting(c, lang).alias("nesting"), X.cognitive(c).alias("cognitive"))


# texts and comments first, then signs one by one with the next, then words; good for code without backslashes
_SKIPPED = r"""'"[^"]*(?:"|$)|''[^'']*(?:''|$)|`[^`]*(?:`|$)|//[^\n]*|/\*[^\n]*'"""
_SIGN = "'[-+*/%=!<>&|^~:()\\[\\]{},;]'"
_OPWORDS = "['.', 'if', 'else', 'for', 'while', 'do', 'switch', 'case', 'default', 'break', 'continue', 'return', 'throw', 'try', 'catch', 'finally', 'new', 'delete', 'typeof', 'instanceof', 'in', 'of', 'go', 'defer', 'chan', 'select', 'range', 'make', 'append', 'len', 'let', 'mut', 'match', 'loop', 'unsafe', 'async', 'await']"


@query(rf"""WITH p AS (SELECT page_id id, regexp_extract_all(c, {_SKIPPED}) q, regexp_replace(c, {_SKIPPED}, ' ', 'g') c FROM (SELECT page_id, coalesce(html, '') c FROM pages)),
  t AS (SELECT id, list_filter(q, lambda s: NOT starts_with(s, '/')) q, list_transform(list_filter(range(1, length(c) + 1), lambda i: regexp_matches(c[i], {_SIGN})), lambda i: CASE WHEN list_contains(['++', '--', '==', '!=', '<=', '>=', '&&', '||', '+=', '-=', '*=', '/=', '->', '=>', '::', '<<', '>>'], c[i:i + 1]) THEN c[i:i + 1] ELSE c[i] END) s,
    regexp_extract_all(c, '[^\s+\-*/%=!<>&|^~:()\[\]{{}},;]+') w FROM p),
  o AS (SELECT id, s || list_filter(w, lambda x: list_contains({_OPWORDS}, x)) o, q || list_filter(w, lambda x: NOT list_contains({_OPWORDS}, x) AND regexp_matches(x, '^[\p{{L}}_\p{{Nd}}]')) w FROM t),
  u AS (SELECT id, len(list_distinct(o)) u1, len(list_distinct(w)) u2, len(o) n1, len(w) n2 FROM o)
  SELECT id, round(CASE WHEN u1 + u2 > 0 THEN (n1 + n2) * log2(u1 + u2) ELSE 0 END, 6)::DOUBLE volume, round(CASE WHEN u2 > 0 THEN u1 / 2.0::DOUBLE * (n2 / u2::DOUBLE) ELSE 0 END, 6)::DOUBLE difficulty FROM u""")
def fn17_halstead(spark: Spark, d: str) -> DataFrame:
    h = X.halstead(F.col("c"))
    return _code(spark, d).select("id", h.alias("h")).select("id", F.round("h.volume", 6).alias("volume"), F.round("h.difficulty", 6).alias("difficulty"))


@query("SELECT id, CASE WHEN contains(c, '++') OR contains(c, '+=') THEN 'increment' WHEN contains(c, '--') OR contains(c, '-=') THEN 'decrement' WHEN contains(c, '*=') THEN 'multiply' WHEN contains(c, '/=') THEN 'divide' ELSE 'unknown' END mutation FROM (" + _CODE + ")")
def fn19_mutations(spark: Spark, d: str) -> DataFrame:
    return _code(spark, d).select("id", X.mutation(F.col("c")).alias("mutation"))


@query()
def fn08_chunks(spark: Spark, d: str) -> DataFrame:
    return _docs(spark, d).select("id", F.posexplode(X.chunks(F.col("text"), 100)).alias("index", "chunk"))


@query("SELECT a.vec_id id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 8) cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b")
def fn20_cosine(spark: Spark, d: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in _vector_of(spark, d)])
    return _vectors(spark, d).select("id", F.round(X.cosine(F.col("v").cast("array<double>"), q), 8).alias("cosine"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def fn24_json_and_times(spark: Spark, d: str) -> DataFrame:
    return V.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


# mining and checks

_SMALL = "s AS (SELECT * FROM commits WHERE sha IN (SELECT sha FROM commits GROUP BY sha HAVING count(*) <= 50))"


@query(f"WITH {_SMALL}, p AS (SELECT a.file file_a, b.file file_b, count(*) n, max(a.epoch) last_epoch FROM s a JOIN s b ON a.sha = b.sha AND a.file < b.file GROUP BY 1, 2 HAVING count(*) >= 3), c AS (SELECT file, count(*) c FROM s GROUP BY 1) SELECT file_a, file_b, n, round(n / (x.c + y.c - n)::DOUBLE, 8) jaccard, last_epoch FROM p JOIN c x ON x.file = file_a JOIN c y ON y.file = file_b")
def ag06_cochange(spark: Spark, d: str) -> DataFrame:
    return M.cochange(V.commits(spark, d))


@query("WITH own AS (SELECT sha FROM commits WHERE file = 5) SELECT file, count(*) n, round(count(*) / (SELECT count(*) FROM own)::DOUBLE, 8) share FROM commits WHERE sha IN (SELECT sha FROM own) AND file <> 5 GROUP BY file")
def ag07_partners(spark: Spark, d: str) -> DataFrame:
    return M.partners(V.commits(spark, d), 5)


@query(f"WITH {_SMALL}, p AS (SELECT a.file file_a, b.file file_b, count(*) n FROM s a JOIN s b ON a.sha = b.sha AND a.file < b.file GROUP BY 1, 2 HAVING count(*) >= 3), c AS (SELECT file, count(*) c FROM s GROUP BY 1) SELECT file_a, file_b, n, round(n / (x.c + y.c - n)::DOUBLE, 8) jaccard FROM p JOIN c x ON x.file = file_a JOIN c y ON y.file = file_b WHERE n / (x.c + y.c - n)::DOUBLE >= 0.01 ORDER BY jaccard DESC, file_a, file_b LIMIT 20")
def ag08_top_pairs(spark: Spark, d: str) -> DataFrame:
    return M.cochange(V.commits(spark, d)).drop("last_epoch").filter("jaccard >= 0.01").orderBy(F.desc("jaccard"), "file_a", "file_b").limit(20)


@query("""WITH f AS (SELECT count(*) symbols, count(*) FILTER (kind IN ('function', 'method') AND NOT exported AND id NOT IN (SELECT target_id FROM g_edges WHERE kind = 'calls')) dead, count(*) FILTER (kind IN ('function', 'method')) functions, count(*) FILTER (docstring IS NULL) undocumented FROM g_nodes)
  SELECT 'symbols' AS "check", symbols AS "value", symbols > 0 passed FROM f UNION ALL SELECT 'dead', dead, dead <= functions * 0.5 FROM f UNION ALL SELECT 'undocumented', undocumented, undocumented * 2 < symbols FROM f""")
def ag16_audit(spark: Spark, d: str) -> DataFrame:
    return M.audit(V.nodes(spark, d), V.edges(spark, d))


# sources and sinks


@query("SELECT id, array_to_string(string_split(c, chr(10))[2:4], chr(10)) code FROM (SELECT doc_id id, coalesce(text, '') c FROM documents)")
def sc21_source_lines(spark: Spark, d: str) -> DataFrame:
    return _docs(spark, d).select("id", I.lines_of(F.col("text"), F.lit(2), F.lit(4)).alias("code"))


def _outline(whole: int, most: int, first: int, last: int, brief: int) -> str:
    n, joined = "len(l)", "array_to_string({}, chr(10))"
    cases = f"WHEN {n} <= {whole} THEN {joined.format('l')} WHEN {n} <= {most} THEN {joined.format(f'l[1:{first}] || [' + chr(39) + '...' + chr(39) + f'] || l[{n} - {last - 1}:]')} ELSE {joined.format(f'l[1:{brief}]')}"
    return f"SELECT id, md5(CASE {cases} END) outline FROM (SELECT doc_id id, string_split(text, chr(10)) l FROM documents)"


@query(_outline(500, 2000, 300, 200, 100))
def sc22_outlined(spark: Spark, d: str) -> DataFrame:
    return _docs(spark, d).select("id", F.md5(I.outlined(F.col("text"))).alias("outline"))


@query(_outline(4, 9, 2, 1, 3))
def sc22_outlined_briefly(spark: Spark, d: str) -> DataFrame:
    return _docs(spark, d).select("id", F.md5(I.outlined(F.col("text"), 4, 9, 2, 1, 3)).alias("outline"))


@query("SELECT 'n' || id || ' [label=\"' || name || '\"]' line FROM g_nodes UNION ALL SELECT 'n' || source_id || ' -> n' || target_id || ' [label=' || kind || ']' FROM g_edges")
def sk05_export_dot(spark: Spark, d: str) -> DataFrame:
    return I.dot_lines(V.nodes(spark, d), V.edges(spark, d))


@query("""SELECT concat_ws(',', id, '"' || name || '"', kind, file, line, CAST(exported AS VARCHAR)) line FROM g_nodes""")
def sk05_export_csv(spark: Spark, d: str) -> DataFrame:
    return I.csv_lines(V.nodes(spark, d))


@query("WITH s AS (SELECT id, name FROM g_nodes ORDER BY id LIMIT 200) SELECT 'n' || id || '[' || name || ']' line FROM s UNION ALL SELECT 'n' || source_id || ' -->|' || kind || '| n' || target_id FROM g_edges WHERE source_id IN (SELECT id FROM s) AND target_id IN (SELECT id FROM s)")
def sk05_export_mermaid(spark: Spark, d: str) -> DataFrame:
    return I.mermaid_lines(V.nodes(spark, d), V.edges(spark, d))


# streams


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2")
def sr01_hourly_stream(spark: Spark, d: str) -> DataFrame:
    return T.drain(T.tumbling(T.event_stream(spark, d)))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6) * k AS start, event_type, count(*) n, round(sum(value), 4) total FROM events, range(2) r(k) GROUP BY 1, 2")
def sr01_sliding_stream(spark: Spark, d: str) -> DataFrame:
    return T.drain(T.tumbling(T.event_stream(spark, d), "12 hours", "6 hours"))


_SESSION = "SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) gap FROM events)"


@query(f"SELECT user_id, min(ts) AS start, count(*) n FROM ({_SESSION}) GROUP BY user_id, s")
def sr02_session_stream(spark: Spark, d: str) -> DataFrame:
    return T.drain(T.sessions(T.event_stream(spark, d)))


@query("""WITH e AS (SELECT ts, user_id AS path, CASE event_type WHEN 'purchase' THEN 'deleted' ELSE 'modified' END change FROM events), b AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 60 SECOND THEN 1 ELSE 0 END) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) k FROM (SELECT *, lag(ts) OVER (ORDER BY ts) p FROM e)),
  s AS (SELECT k, min(ts) batch_start FROM b GROUP BY k) SELECT batch_start, path, CASE WHEN bool_or(change = 'deleted') THEN 'deleted' ELSE 'modified' END change FROM b JOIN s USING (k) GROUP BY 1, 2""")
def sr02_debounced(spark: Spark, d: str) -> DataFrame:
    change = F.when(F.col("event_type") == "purchase", "deleted").otherwise("modified")
    return T.debounced(V.table(spark, d, "events").select("ts", F.col("user_id").alias("path"), change.alias("change")), "60 seconds")


@query("SELECT n.path FROM manifest_new n LEFT JOIN manifest_old o USING (path) WHERE o.path IS NULL OR o.mtime <> n.mtime OR o.size <> n.size")
def sr04_candidates(spark: Spark, d: str) -> DataFrame:
    return C.candidates(V.manifest(spark, d, False), V.manifest(spark, d, True))


@query("SELECT event_type, max_by(event_id, (ts, event_id)) event_id, max(ts) ts FROM events GROUP BY event_type")
def sr06_maintained(spark: Spark, d: str) -> DataFrame:
    stream = T.event_stream(spark, d).select("event_type", "ts", "event_id")
    empty = spark.createDataFrame([], stream.schema)

    def newest(table: DataFrame, batch: DataFrame) -> DataFrame:
        best = F.max(F.struct("ts", "event_id"))
        return table.unionByName(batch).groupBy("event_type").agg(best.alias("b")).select("event_type", "b.ts", "b.event_id")

    return T.maintained(spark, stream, empty, "event_type", newest).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
