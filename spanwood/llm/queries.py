"""The queries of this subpackage's operators, thin over their own interfaces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chunking, embeddings, lines, main_text, minhash, packing, ranked_search, resampling, secrets, sharding, toxicity, url_filter
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_pair")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fingerprints(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), detail=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text.extract(pages, main_text.fit(pages))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_embedding_dedup, op3_secrets, op4_byte_bpe, op5_fingerprints, op6_url_filter, op7_minhash, op8_sharding, op9_packing, op10_line_dedup, op11_main_text, op12_ranked_search, op13_resampling)}

_SPACED = r"""trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ')"""
SQL = {
    # as in lines.py: equal lines first; then templates of what stays, by different lines
    "op10_line_dedup": f"""
    WITH docs AS (SELECT doc_id, text, row_number() OVER () r FROM documents),
    lines AS (SELECT doc_id, r, pos, line FROM (SELECT doc_id, r, string_split(text, chr(10)) ls FROM docs),
      LATERAL (SELECT unnest(ls) line, unnest(range(len(ls))) pos)),
    toks AS (SELECT doc_id, r, pos, string_split_regex({_SPACED}, ' +') exact FROM lines WHERE {_SPACED} <> ''),
    stays AS (SELECT *, list_transform(exact, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '0' ELSE x END) t
      FROM (SELECT *, min(doc_id) OVER (PARTITION BY exact) first FROM toks) WHERE doc_id = first),
    sized AS (SELECT *, len(t) n, len(t) * {lines.OPEN_TENTHS} // 10 w, len(list_filter(t, lambda x: x <> '0')) l FROM stays),
    filed AS (
      SELECT doc_id, r, pos, exact, {{'k': -1, 'n': n, 'p': t}} key FROM sized WHERE n < {lines.OPEN_FROM} AND l < n AND l >= {lines.LITERALS} AND 2 * l >= n
      UNION ALL SELECT doc_id, r, pos, exact, {{'k': k, 'n': n, 'p': t[1:1 + k * w] || t[2 + (k + 1) * w:]}} key FROM (
        SELECT *, l - len(list_filter(t[2 + k * w:1 + (k + 1) * w], lambda x: x <> '0')) lk FROM sized, range({lines.FIELDS}) ks(k)
        WHERE n >= {lines.OPEN_FROM} AND k < ceil((n - 1) / w)) WHERE lk >= {lines.LITERALS} AND 2 * lk >= n),
    seen AS (SELECT key, min(doc_id) first FROM filed GROUP BY key HAVING min(doc_id) <> max(doc_id) AND count(DISTINCT exact) >= {lines.LINES}),
    drops AS (SELECT r, pos FROM (SELECT r, pos, doc_id, min(doc_id) OVER (PARTITION BY exact) first FROM toks) WHERE doc_id <> first
      UNION SELECT r, pos FROM filed JOIN seen USING (key) WHERE doc_id <> first),
    kept AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) text FROM lines ANTI JOIN drops USING (r, pos) GROUP BY r),
    n AS (SELECT r, count(*) n_dropped FROM drops GROUP BY r)
    SELECT doc_id, CAST(CASE WHEN docs.text IS NULL THEN 0 ELSE len(string_split(docs.text, chr(10))) END AS INTEGER) n_lines,
      CAST(coalesce(n_dropped, 0) AS INTEGER) n_dropped, md5(coalesce(kept.text, '')) text_md5
    FROM docs LEFT JOIN kept USING (r) LEFT JOIN n USING (r)""",
    "op12_ranked_search": """
    WITH docs AS (SELECT doc_id, text, row_number() OVER () r FROM documents),
    words AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term FROM docs),
    tf AS (SELECT r, doc_id, term, count(*) tf FROM words GROUP BY ALL),
    len AS (SELECT r, count(*) n FROM words GROUP BY r),
    corpus AS (SELECT count(*) n_docs, CAST(sum(n) AS BIGINT) n_terms FROM len),
    m AS (SELECT r, 10 + (90 * n * n_docs) // n_terms m FROM len, corpus),
    wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term FROM benchmark),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) w FROM tf, corpus GROUP BY term),
    scores AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) score
      FROM wanted JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) rank FROM scores WHERE score > 0) WHERE rank <= 10""",
}
