"""A convolutional text classifier: hashed word embeddings, filters of several widths and max pooling, in numpy.

A word's embedding is the sum of three hashed rows: of the word, of its first four and of its first five letters, so
that unseen forms of a known stem are near it. Filters of one, two and three words run over the whole text; their
maxima feed a logistic output. Thresholds are calibrated for each language as the text's own function words tell it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, tidy

#: Rows of each hashed table, size of an embedding, filters of each width, widths.
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 8, (1, 2, 3)
PARTS = sum(WIDTHS)
#: At most so many labelled rows of each class train the model.
TRAIN_TOXIC, TRAIN_CLEAN = 1_500, 2_500
#: Folds of ids that models are calibrated across.
FOLDS = 2
#: Least steps and epochs of training, most rows of a step, most words of a step of several texts, step size.
STEPS, EPOCHS, MINIBATCH, STEP_WORDS, RATE = 400, 3, 48, 60_000, 0.15
#: Bins of a logit's unit and the largest logit told apart; all languages' rows weigh in a language as so many toxic ones.
BINS, FAR, SHARED_TOXIC = 50, 40, 5.0
#: The score that a text at its language's threshold gets, and words whose filters a worker remembers.
CUT, MEMO = 0.3, 50_000

#: Fixed lists: frequent function words of each language.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine mit von zu den auf für im dem sich des",
    "en": "the of and to in is that it for was on with as be by this are at from or",
    "es": "el la de que y en los se del las por un una con no para es lo al su",
    "fr": "le la les de et des en un une du que qui est dans pour pas au sur avec ce",
}
LANGUAGES = (*sorted(FUNCTION_WORDS), "")
_LANGUAGE = {w: sum(1 << k for k, lang in enumerate(LANGUAGES[:-1]) if w in FUNCTION_WORDS[lang].split()) for ws in FUNCTION_WORDS.values() for w in ws.split()}
_EDGES = re.compile(r"^\W+|\W+$")


def _hashes(word: str) -> tuple[int, int, int]:
    data = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) % BUCKETS, BUCKETS + zlib.crc32(word[:4].encode("utf-8", "surrogatepass"), 1) % BUCKETS, 2 * BUCKETS + zlib.crc32(word[:5].encode("utf-8", "surrogatepass"), 2) % BUCKETS


class Words:
    """Numbers for the words of texts, with their hashed rows and language marks; number 0 is the gap between texts."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.rows: list[tuple[int, int, int]] = [(-1, -1, -1)]
        self.marks: list[int] = [0]

    def __call__(self, text: str) -> list[int]:
        number = self.number
        out = []
        for chunk in text.lower().split():
            k = number.get(chunk)
            if k is None:
                word = _EDGES.sub("", chunk)
                k = 0 if not word else len(self.rows)
                if word:
                    self.rows.append(_hashes(word))
                    self.marks.append(_LANGUAGE.get(word, 0))
                if len(chunk) < 64 or word:
                    number[chunk] = k
            out.append(k)
        return out


@dataclass
class Model:
    embed: np.ndarray  # (3 * BUCKETS, DIM)
    conv: np.ndarray  # (DIM, PARTS * FILTERS): for each width, the filters of its first, second, ... word
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float]
    slope: float
    #: Toxic rows of its own that each language's threshold was set on.
    calibrated: dict[str, int] = field(default_factory=dict)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """What each word, given by its hashed rows, adds to each filter at each of its places."""
        return (self.embed[rows].astype(np.float32).sum(axis=1)) @ self.conv

    def logit(self, added: np.ndarray) -> float:
        """The output for a text whose words add `added`; block by block, so that memory stays bounded."""
        return float(np.maximum(_pooled(added) + self.bias, 0) @ self.out + self.out_bias)

    def score(self, logit: float, language: str) -> float:
        """0 to 1; CUT at the threshold of the language."""
        x = self.slope * (logit - self.thresholds.get(language, self.thresholds[""])) + np.log(CUT / (1 - CUT))
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _windows(added: np.ndarray) -> list[np.ndarray]:
    """For each width, the filters' values at each place; a width's windows all lie inside."""
    out, at = [], 0
    for width in WIDTHS:
        n = max(0, len(added) - width + 1)
        v = added[:n, at * FILTERS : (at + 1) * FILTERS].copy()
        for j in range(1, width):
            v += added[j : j + n, (at + j) * FILTERS : (at + j + 1) * FILTERS]
        out.append(v)
        at += width
    return out


def _pooled(added: np.ndarray) -> np.ndarray:
    best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
    for a in range(0, max(1, len(added)), 8192):
        part = [v.max(axis=0) if len(v) else np.full(FILTERS, -np.inf, np.float32) for v in _windows(added[a : a + 8192 + max(WIDTHS) - 1])]
        best = np.maximum(best, np.concatenate(part))
    return best


def language_of(marks: np.ndarray) -> str:
    """The language most of whose function words come up; '' without any or in a tie."""
    counts = [int(((marks >> k) & 1).sum()) for k in range(len(LANGUAGES) - 1)]
    top = max(counts)
    return LANGUAGES[counts.index(top)] if top and counts.count(top) == 1 else ""


def train(texts: list[str], toxic: list[int], seed: int = 3) -> Model | None:
    """Fit the model; None without both classes."""
    y = np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    words = Words()
    docs = [np.array(words(t), np.int64) for t in texts]
    rows = np.array(words.rows)
    rows[0] = 0
    m = Model(rng.normal(0, 0.05, (3 * BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, PARTS * FILTERS)).astype(np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0, {"": 0.0}, 1.0)
    sums = [np.full(x.shape, 1e-3, np.float32) for x in (m.embed, m.conv, m.bias, m.out, np.zeros(1))]
    gap = np.zeros(max(WIDTHS) - 1, np.int64)
    learn = np.arange(len(y))
    size = max(8, min(MINIBATCH, len(learn) // 8))
    for _ in range(max(EPOCHS, -(-STEPS * size // len(learn)))):
        order = rng.permutation(learn)
        for a in range(0, len(order), size):
            own = order[a : a + size]
            # long texts make steps of their own, so that memory stays bounded
            cuts = np.cumsum([len(docs[i]) for i in own]) // STEP_WORDS
            for part in np.split(own, np.flatnonzero(np.diff(cuts)) + 1):
                _step(m, sums, [docs[i] for i in part], y[part], rows, gap)
    m.embed = m.embed.astype(np.float16)
    return m


def _step(m: Model, sums: list, docs: list, y: np.ndarray, rows: np.ndarray, gap: np.ndarray) -> None:
    """One step of Adagrad on the logistic loss of a minibatch."""
    flat = np.concatenate([np.concatenate([d, gap]) for d in docs])
    starts = np.cumsum([0, *[len(d) + len(gap) for d in docs[:-1]]])
    vec = m.embed[rows[flat]].sum(axis=1)
    vec[flat == 0] = 0
    added = np.vstack([vec @ m.conv, np.zeros((len(gap), PARTS * FILTERS), np.float32)])
    n = len(docs)
    pooled, place = [], []
    # words that each place has left in its text: windows lie inside, as they do when a text is scored
    left = np.concatenate([np.r_[np.arange(len(d), 0, -1), np.zeros(len(gap), np.int64)] for d in docs])
    for width, v in zip(WIDTHS, _windows(added), strict=True):
        v = np.where((left >= width)[:, None], v[: len(flat)], -np.inf)
        top = np.maximum.reduceat(v, starts, axis=0)
        hit = v == np.repeat(top, np.diff([*starts, len(flat)]), axis=0)
        at = np.where(hit, np.arange(len(flat))[:, None], len(flat))
        pooled.append(top)
        place.append(np.minimum.reduceat(at, starts, axis=0))
    z = np.hstack(pooled) + m.bias
    hidden = np.maximum(z, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ m.out + m.out_bias, -30, 30)))
    d = ((p - y) * np.where(y > 0, 1.5, 1.0) / n).astype(np.float32)
    d_hidden = np.outer(d, m.out) * (z > 0)
    d_conv, d_vec = np.zeros_like(m.conv), np.zeros((len(flat) + len(gap), DIM), np.float32)
    padded = np.vstack([vec, np.zeros((len(gap), DIM), np.float32)])
    at = 0
    for k, width in enumerate(WIDTHS):
        g = d_hidden[:, k * FILTERS : (k + 1) * FILTERS]
        for j in range(width):
            cols = slice((at + j) * FILTERS, (at + j + 1) * FILTERS)
            where = place[k] + j
            d_conv[:, cols] = np.einsum("nfd,nf->df", padded[where], g)
            np.add.at(d_vec, where, g[:, :, None] * m.conv[:, cols].T[None])
        at += width
    touched = np.flatnonzero(np.abs(d_vec[: len(flat)]).sum(axis=1) * (flat != 0))
    own, inverse = np.unique(rows[flat[touched]].ravel(), return_inverse=True)
    d_embed = np.zeros((len(own), DIM), np.float32)
    np.add.at(d_embed, inverse.ravel(), np.repeat(d_vec[touched], 3, axis=0))
    sums[0][own] += d_embed**2
    m.embed[own] -= RATE * d_embed / np.sqrt(sums[0][own])
    for x, g, s in ((m.conv, d_conv, sums[1]), (m.bias, d_hidden.sum(axis=0), sums[2]), (m.out, hidden.T @ d, sums[3])):
        s += g**2
        x -= RATE / 3 * g / np.sqrt(s)
    sums[4] += d.sum() ** 2
    m.out_bias -= float(RATE / 3 * d.sum() / np.sqrt(sums[4][0]))


def thresholds(bins: list[tuple[str, int, int, int]]) -> dict[str, float]:
    """The threshold of each language and of all ('') from rows (language, label, bin of the logit, count).

    All rows weigh in each language as SHARED_TOXIC toxic ones do, so that few rows of its own move a threshold little
    and many move it wholly, without a size at which it switches.
    """
    counts = {lang: np.zeros((2, 2 * FAR * BINS + 1)) for lang in LANGUAGES}
    shared = np.zeros((2, 2 * FAR * BINS + 1))
    for lang, y, k, n in bins:
        counts[lang][y, k + FAR * BINS] += n
        shared[y, k + FAR * BINS] += n
    prior = shared * (SHARED_TOXIC / max(shared[1].sum(), 1.0))
    return {lang: _threshold(own + prior) for lang, own in counts.items() if lang} | {"": _threshold(shared)}


def _threshold(counts: np.ndarray) -> float:
    """The middle of the range of cuts with the best F1, of counts of clean and toxic rows by bin."""
    at = np.flatnonzero(counts.sum(axis=0))
    if not len(at):
        return 0.0
    logits, clean, toxic = (at - FAR * BINS) / BINS, counts[0, at], counts[1, at]
    if not toxic.sum() or not clean.sum():
        return float(logits.max() + 1 if not toxic.sum() else logits.min() - 1)
    edges = np.concatenate([[logits[0] - 1], (logits[1:] + logits[:-1]) / 2])
    right, said = (np.cumsum(x[::-1])[::-1] for x in (toxic, clean + toxic))
    f1 = 2 * right / (toxic.sum() + said)
    return float(np.median(edges[f1 >= f1.max() - 1e-12]))


class Scorer:
    """Scores texts; a worker remembers what words add."""

    def __init__(self, model: Model, memo: int = MEMO):
        self.model, self.memo = model, memo
        self._forget()

    def _forget(self) -> None:
        self.words = Words()
        self.added = np.zeros((1, PARTS * FILTERS), np.float32)
        self.marks = np.zeros(1, np.int64)
        self.filled = 1

    def __call__(self, text: str) -> float:
        return self.model.score(*self.judged(text))

    def judged(self, text: str) -> tuple[float, str]:
        """The logit and the language of a text."""
        if len(self.words.number) >= self.memo:
            self._forget()
        ids = np.array(self.words(text), np.int64)
        known = len(self.words.rows)
        if known > self.filled:
            self._fill(known)
        return self.model.logit(self.added[ids]) if len(ids) else -np.inf, language_of(self.marks[ids])

    def _fill(self, known: int) -> None:
        if known > len(self.added):
            size = max(2 * len(self.added), known, 4096)
            self.added = np.vstack([self.added, np.zeros((size - len(self.added), PARTS * FILTERS), np.float32)])
            self.marks = np.concatenate([self.marks, np.zeros(size - len(self.marks), np.int64)])
        self.added[self.filled : known] = self.model.vectors(np.array(self.words.rows[self.filled : known]))
        self.marks[self.filled : known] = self.words.marks[self.filled : known]
        self.filled = known


def held_out(id_col: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "utf-8")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Train on a bounded sample of the labelled rows that are not held out, then set thresholds on all of these rows.

    The sample is the rows of the smallest hashes of each class, at most TRAIN_TOXIC and TRAIN_CLEAN of any length (their
    ids are broadcast, their texts come to the driver). For thresholds, FOLDS more models each leave out a fold of ids;
    every labelled row is scored by the model that never saw its fold, and counts of binned logits by language and label
    set the cuts. A fold whose rest has no row of one class uses the whole model. The result's `calibrated` says how many
    toxic rows of its own each language had. Rows with null ids, labels or texts and empty texts do not train; an id that
    is labelled twice counts by its larger label, and of an id with several texts the smallest text trains.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    known = known.withColumns({"__h": F.xxhash64("__id"), "__fold": F.pmod(F.xxhash64("__id", F.lit(2)), F.lit(FOLDS)).cast("int")})
    plain = docs.filter(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    least = [known.filter(F.col("__y") == y).orderBy("__h", "__id").limit(most) for y, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    sample = plain.join(F.broadcast(least[0].unionByName(least[1])), "__id").groupBy("__h", "__id", "__y", "__fold").agg(F.min("__text").alias("__text"))
    rows = sorted(tuple(r) for r in sample.collect())
    model = train([r[4] for r in rows], [r[2] for r in rows])
    if model:
        others = [train([r[4] for r in rows if r[3] != k], [r[2] for r in rows if r[3] != k]) or model for k in range(FOLDS)]
        # labels may be any share of the rows: they are never broadcast, at no size
        bins = _logit_counts(plain.join(known.hint("merge"), "__id"), others)
        model.thresholds = thresholds(bins)
        model.calibrated = {lang: sum(n for own, y, _, n in bins if y and own == lang) for lang in LANGUAGES}
    return model


def _logit_counts(labelled: DataFrame, models: list[Model]) -> list[tuple[str, int, int, int]]:
    """Rows (language, label, bin, count) of labelled(__text, __y, __fold), each scored by its fold's model."""
    shared = labelled.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m, MEMO // FOLDS) for m in shared.value]
        for batch in batches:
            judged = [scorers[k].judged(t.as_py()) for t, k in zip(batch.column(0), batch.column(2).to_pylist(), strict=True)]
            bins = [round(min(max(logit, -FAR), FAR) * BINS) for logit, _ in judged]
            yield pa.RecordBatch.from_arrays([pa.array([lang for _, lang in judged], pa.string()), batch.column(1), pa.array(bins, pa.int32())], ["__lang", "__y", "__bin"])
        scorers.clear()
        tidy()

    binned = labelled.select("__text", "__y", "__fold").mapInArrow(run, "__lang string, __y int, __bin int")
    return [tuple(r) for r in binned.groupBy("__lang", "__y", "__bin").count().collect()]


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each whole text.

    Null texts are empty; an empty text scores the lowest there is. Without a model (no labels of both classes) every
    score is 0. Rows are scored one by one from their texts alone; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else lambda _: 0.0
        for batch in batches:
            score = [scorer(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array([int(s >= CUT) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), blank(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns.

    Null texts stay, as empty and blank ones do unless such were labelled toxic; rows are judged one by one, repeated ones
    alike; an empty table gives an empty one. Without a model all stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value) if shared.value else lambda _: 0.0
        for texts in batches:
            yield texts.map(lambda t: t is None or scorer(t) < CUT).astype(bool)
        del scorer
        tidy()

    return docs.filter(F.pandas_udf(clean, "boolean")(text_col))
