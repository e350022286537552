"""URL filters: fixed rules first, then the ratio of two character language models.

Both models are variable-order Markov models over a small alphabet, with Witten-Bell interpolation from order 0 up to
ORDER. URLs that rules allow or block are their training rows, all of them. The threshold on the mean log-likelihood
difference for a character is the one that parts these rows best, each scored by models that left out its fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed rules (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

ORDER = 3
#: Letters, one digit, other signs of URLs, the rest, and the border before a URL.
_SIGNS = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#:%+~"
SIZE = len(_SIGNS) + 2
OTHER, BORDER = len(_SIGNS), len(_SIGNS) + 1
_CODES = np.full(256, OTHER, np.int64)
for _k, _c in enumerate(_SIGNS):
    _CODES[ord(_c)] = _CODES[ord(_c.upper())] = _k
for _c in "123456789":
    _CODES[ord(_c)] = _SIGNS.index("0")
BINS = 2_000
#: Folds of URLs (equal ones fall in one) that the threshold is set across.
FOLDS = 2
SPAN = 8.0


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty for null or without ://."""
    rest = F.substring_index(url, "://", 1)
    rest = F.substr(url, F.length(rest) + F.lit(4))
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (like net/) and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def grams(url: str | None) -> np.ndarray:
    """For each character of the URL, the number of its (ORDER + 1)-gram."""
    codes = _CODES[np.frombuffer((url or "").encode("utf-8", "replace"), np.uint8)]
    padded = np.concatenate([np.full(ORDER, BORDER), codes])
    out = np.zeros(len(codes), np.int64)
    for k in range(ORDER + 1):
        out = out * SIZE + padded[k : k + len(codes)]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls, groups = batch.column(0).to_pylist(), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        for allow, fold in sorted(set(groups)):
            gram, n = np.unique(np.concatenate([grams(u) for u, g in zip(urls, groups, strict=True) if g == (allow, fold)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([allow] * len(gram)), pa.array([fold] * len(gram), pa.int32()), pa.array(gram), pa.array(n)], ["allow", "fold", "gram", "n"])


def _log_model(counts: np.ndarray) -> np.ndarray:
    """log P(character | up to ORDER before it) for each (ORDER + 1)-gram, from its counts."""
    p = np.full(SIZE, 1.0 / SIZE)
    for k in range(ORDER + 1):
        own = counts.reshape(-1, SIZE ** (k + 1)).sum(axis=0).reshape(-1, SIZE)
        total, kinds = own.sum(axis=1, keepdims=True), (own > 0).sum(axis=1, keepdims=True)
        below = np.tile(p.reshape(-1, SIZE), (own.shape[0] // max(1, p.size // SIZE), 1))
        p = np.where(total > 0, (own + kinds * below) / np.maximum(total + kinds, 1), below)
    return np.log(p).ravel()


def fit(urls: DataFrame) -> list[np.ndarray]:
    """Tables of log-likelihood differences, allowed less blocked, for each gram of urls(url, allow, fold).

    One table for each fold, made without its rows, and then one of all rows. Counts cover every row. There are at most
    SIZE ** (ORDER + 1) grams (3 million), whatever the input, so the counts and the tables (float16, 6 MB each) have a
    bound.
    """
    counted = urls.select("url", "allow", "fold").mapInArrow(_counted, "allow boolean, fold int, gram long, n long")
    got = counted.groupBy("allow", "fold", "gram").agg(F.sum("n").alias("n")).toPandas()
    tables = []
    for left_out in (*range(FOLDS), None):
        models = []
        for allow in (True, False):
            own = got[(got["allow"] == allow) & (got["fold"] != left_out)]
            dense = np.zeros(SIZE ** (ORDER + 1), np.float32)
            np.add.at(dense, own["gram"].to_numpy(dtype=np.int64), own["n"].to_numpy(dtype=np.float32))
            models.append(_log_model(dense))
        tables.append((models[0] - models[1]).astype(np.float16))
    return tables


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Return page_id, host, path, rule, verdict, score of each row.

    A rule's verdict stands; other URLs are allowed if their score, the mean log-likelihood difference of a character,
    reaches the threshold. Null and empty URLs score 0; long ones are read whole. Without rows of both verdicts the
    threshold is 0. Rows are judged one by one, repeated ones alike; other columns are not read. An empty table gives an
    empty one.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})
    ruled = rows.filter("by_rule is not null").select("url", (F.col("by_rule") == "allow").alias("allow"), F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int").alias("fold"))
    tables = spark.sparkContext.broadcast(fit(ruled))

    def score(urls: pd.Series, folds: pd.Series) -> pd.Series:
        own = [(tables.value[k], grams(u)) for u, k in zip(urls, folds, strict=True)]
        return pd.Series([float(ratio[g].astype(np.float32).mean()) if len(g) else 0.0 for ratio, g in own], dtype="float64")

    scored = F.pandas_udf(score, "double")
    bins = F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS)
    spread = ruled.withColumn("score", scored("url", "fold")).groupBy("allow", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    threshold = _threshold(spread)
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return rows.withColumn("score", scored("url", F.lit(FOLDS))).select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "score")


def _threshold(spread: pd.DataFrame) -> float:
    """The score with the best mean of both classes' rates of right verdicts; 0 without both classes."""
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for allow, into in ((True, good), (False, bad)):
        own = spread[spread["allow"] == allow]
        np.add.at(into, np.clip(own["bin"].to_numpy(dtype=np.int64), 0, BINS - 1), own["n"].to_numpy())
    if not good.sum() or not bad.sum():
        return 0.0
    right = good[::-1].cumsum()[::-1] / good.sum() + (np.concatenate([[0], bad.cumsum()[:-1]])) / bad.sum()
    best = np.flatnonzero(right == right.max())
    return float((best[0] + best[-1] + 1) / 2 / BINS * 2 * SPAN - SPAN) if len(best) > 1 else float(best[0] / BINS * 2 * SPAN - SPAN)
