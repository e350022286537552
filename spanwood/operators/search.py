"""Search and retrieval: keyword, BM25, vector and fused ranking, reranking and context assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .steps import cut


def keyword(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, rank, score): names with the query in them, exact ones first, then prefixes; each rank costs a hundredth."""
    low, q = F.lower("name"), query.lower()
    tier = F.when(low == q, 0).when(low.startswith(q), 1).otherwise(2)
    best = nodes.filter(F.col("name").ilike(f"%{query}%")).select("id", "name", tier.alias("tier")).orderBy("tier", "name", "id").limit(limit)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy("tier", "name", "id")))  # at most `limit` rows
    return ranked.select("id", "rank", F.round(1 - 0.01 * (F.col("rank") - 1), 2).alias("score"))


def symbols(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """keyword() with the kind of match and its score."""
    kind, score = X.match_score(F.col("name"), query, F.col("exported"))
    return nodes.filter(F.col("name").ilike(f"%{query}%")).select("id", "name", kind.alias("match"), score.alias("score")).orderBy(F.desc("score"), "name", "id").limit(limit)


def bm25(docs: DataFrame, query: str, limit: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of docs(id, text) that hold all words of the query, by Okapi BM25 with the IDF floored at 1e-6."""
    return bm25_of_each(docs, [query], limit, k1, b)[0]


def bm25_of_each(docs: DataFrame, queries: list[str], limit: int | None = None, k1: float = 1.2, b: float = 0.75) -> list[DataFrame]:
    """bm25 of each query, after one pass over the texts for all of them.

    Term counts are columns, so nothing is shuffled; numbers of a document are written once to the shared folder, and one
    row of statistics comes from there.
    """
    asked = [sorted(set(_split(q))) for q in queries]
    terms = sorted({t for some in asked for t in some})
    if not terms:
        return [docs.select("id", F.lit(0.0).alias("score")).limit(0) for _ in queries]
    counted = docs.select("id", X.words(F.coalesce("text", F.lit(""))).alias("w"))
    counted = cut(counted.select("id", F.size("w").alias("len"), *[_count(t).alias(f"tf{i}") for i, t in enumerate(terms)]))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    out = []
    for some in asked:
        score, places = F.lit(0.0), [terms.index(t) for t in some]
        for i in places:
            idf = F.greatest(F.log((F.lit(float(stats["n"])) - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)), F.lit(1e-6))
            tf = F.col(f"tf{i}")
            score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / (stats["avg"] or 1.0)))
        holds = reduce(lambda x, y: x & y, [F.col(f"tf{i}") > 0 for i in places], F.lit(bool(places)))
        hits = counted.filter(holds).select("id", F.round(score, 8).alias("score"))
        out.append(hits.orderBy(F.desc("score"), "id").limit(limit) if limit else hits)
    return out


def _count(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == term))


def _split(query: str) -> list[str]:
    return [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in query.lower()).split() if w]


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, distance, score) of the k vectors(id, v) nearest to the query by L2; score is 1 / (1 + distance)."""
    d = X.distance(F.col("v").cast("array<double>"), F.array(*[F.lit(float(x)) for x in query]))
    best = vectors.select("id", F.round(d, 8).alias("distance")).orderBy("distance", "id").limit(k)
    return best.withColumn("score", F.round(1 / (1 + F.col("distance")), 8))


def best_per_key(hits: DataFrame, key: Column, k: int) -> DataFrame:
    """(id, score): the best score of each key among hits(id, score), the k best."""
    return hits.groupBy(key.alias("id")).agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def fuse(sources: dict[str, DataFrame], k: int = 60, limit: int | None = None) -> DataFrame:
    """(id, score, source) by reciprocal ranks over sources of (id, score): ids met in several add up, labels joined by +.

    Sources are top-k lists already, so a rank passes a window of at most that many rows.
    """
    rows = reduce(DataFrame.unionByName, [df.select("id", "score", F.lit(name).alias("source")) for name, df in sources.items()])
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "id")))
    out = ranked.groupBy("id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 10).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"))
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def rerank(hits: DataFrame, query: str) -> DataFrame:
    """hits(id, text) with score: share of the query's words in the text, 0.3 more for the whole phrase, at most 1."""
    ws = _split(query)
    low = F.lower(F.coalesce("text", F.lit("")))
    share = sum((low.contains(w).cast("double") for w in ws), F.lit(0.0)) / max(len(ws), 1)
    return hits.withColumn("score", F.round(F.least(F.lit(1.0), share + F.when(low.contains(query.lower()), 0.3).otherwise(0.0)), 8))


def within_budget(hits: DataFrame, budget: int) -> DataFrame:
    """The leading hits(id, score, tokens), best first, whose tokens add up to at most the budget; hits are a top-k list."""
    run = F.sum("tokens").over(Window.orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("used", run).filter(F.col("used") <= budget)


def hashed_embedding(text: Column) -> Column:
    """A deterministic vector of 16 numbers: the text's words counted by the first hex digit of their MD5, over their number."""
    ws = X.words(F.coalesce(text, F.lit("")))
    # as one string under a name, lest each of the 16 counts hashes all words again
    digits = F.array(F.array_join(F.transform(ws, lambda w: F.substring(F.md5(w), 1, 1)), ""))
    counted = lambda s: F.transform(F.array(*[F.lit(c) for c in "0123456789abcdef"]), lambda c: (F.length(s) - F.length(F.replace(s, c))) / F.greatest(F.length(s), F.lit(1)))
    return F.transform(digits, counted)[0]
