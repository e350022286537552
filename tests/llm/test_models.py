"""Toxicity, URL filter and sharding against plain versions of what they compute, and on odd rows with fitted models."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("spanwood.llm")
from spanwood.llm import sharding, toxicity, url_filter  # noqa: E402

TEXTS = ["you are a foul beast and i mean it", "kind words for all of you today", "the foul one came back again and again", "a calm sea and a warm wind", "foul foul foul", "good day to the calm people of the land"] * 4
TOXIC = [1, 0, 1, 0, 1, 0] * 4


@pytest.fixture(scope="module")
def model():
    return toxicity.train(TEXTS, TOXIC)


def _plain_logit(m, text):
    """The forward pass word by word and filter by filter."""
    words = toxicity.Words()
    vec = [m.embed[list(words.rows[k])].astype(np.float64).sum(axis=0) if k else np.zeros(toxicity.DIM) for k in words(text)]
    out, at, unit = float(m.out_bias), 0, 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best = max((sum(float(vec[i + j] @ m.conv[:, (at + j) * toxicity.FILTERS + f]) for j in range(width)) for i in range(len(vec) - width + 1)), default=-math.inf)
            out += max(best + float(m.bias[unit]), 0.0) * float(m.out[unit])
            unit += 1
        at += width
    return out


def test_forward_pass_is_the_plain_one(model):
    for text in [*TEXTS[:6], "one", "foul " * 9000]:
        assert toxicity.Scorer(model).judged(text)[0] == pytest.approx(_plain_logit(model, text), abs=2e-3)


def test_training_lowers_the_loss_and_parts_the_classes(model):
    logits = [toxicity.Scorer(model).judged(t)[0] for t in TEXTS]
    assert min(z for z, y in zip(logits, TOXIC, strict=True) if y) > max(z for z, y in zip(logits, TOXIC, strict=True) if not y)


def test_gradients_are_those_of_the_loss():
    """One Adagrad step from sums of zero moves each parameter by its rate against the sign of the numeric gradient."""
    rng = np.random.default_rng(0)
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    m = toxicity.Model(rng.normal(0, 0.5, (3 * toxicity.BUCKETS, toxicity.DIM)), rng.normal(0, 0.5, (toxicity.DIM, toxicity.PARTS * toxicity.FILTERS)), rng.normal(0, 0.1, n), rng.normal(0, 0.5, n), 0.1, {"": 0.0}, 1.0)
    words = toxicity.Words()
    docs = [np.array(words(t)) for t in TEXTS[:6]]
    rows = np.array(words.rows)
    rows[0] = 0
    y = np.array(TOXIC[:6], float)

    def loss():
        z = np.array([_plain_logit(m, t) for t in TEXTS[:6]])
        return float(np.mean(np.where(y > 0, 1.5, 1.0) * np.where(y > 0, np.log1p(np.exp(-z)), np.log1p(np.exp(z)))))

    numeric = []
    for k in range(n):
        was = m.out[k]
        m.out[k] = was + 1e-5
        up = loss()
        m.out[k] = was - 1e-5
        numeric.append((up - loss()) / 2e-5)
        m.out[k] = was
    before, sums = m.out.copy(), [np.full(x.shape, 1e-12) for x in (m.embed, m.conv, m.bias, m.out, np.zeros(1))]
    toxicity._step(m, sums, docs, y, rows, np.zeros(max(toxicity.WIDTHS) - 1, np.int64))
    clear = np.abs(numeric) > 1e-4
    assert clear.sum() > 10 and (np.sign(before - m.out)[clear] == np.sign(numeric)[clear]).all()
    assert np.sqrt(sums[3])[clear] == pytest.approx(np.abs(numeric)[clear], rel=1e-2)


def test_odd_rows_with_a_fitted_model(spark, model):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "foul"), (5, "calm " * 60_000), (6, TEXTS[0]), (6, TEXTS[0]), (None, TEXTS[0]), (8, "ünï 世界")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("score", "held_out", "__y", "predicted", "__id"):
        docs = docs.withColumn(c, F.lit("x"))
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] == by[2] == by[3] == min(by.values()) and by[6] == by[None]
    assert toxicity.scored(docs.limit(0), model).count() == 0
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["predicted"]}
    assert toxicity.without_toxic(docs.limit(0), model).count() == 0


def test_all_languages_are_calibrated_across_folds_and_training_repeats(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" x"))).limit(200))  # ids with two texts
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(7), labels)
    assert set(a.thresholds) == set(toxicity.LANGUAGES) and a.thresholds == b.thresholds and (a.conv == b.conv).all()
    assert sum(a.calibrated.values()) > 20 and len({a.thresholds[x] for x in ("de", "en", "es", "fr")}) > 1


def _plain_model(urls):
    """Counts of each context by dictionary; P of a code after a context by Witten-Bell, recursively."""
    follow = [defaultdict(Counter) for _ in range(url_filter.ORDER + 1)]
    for u in urls:
        codes = [url_filter.BORDER] * url_filter.ORDER + [int(url_filter._CODES[b]) for b in u.encode()]
        for i in range(url_filter.ORDER, len(codes)):
            for k in range(url_filter.ORDER + 1):
                follow[k][tuple(codes[i - k : i])][codes[i]] += 1

    def p(code, context):
        below = p(code, context[1:]) if context else 1 / url_filter.SIZE
        seen = follow[len(context)].get(tuple(context))
        if not seen:
            return below
        return (seen[code] + len(seen) * below) / (sum(seen.values()) + len(seen))

    return p


def test_url_scores_are_the_plain_models(spark):
    good = [f"http://a{k}.org/page/{k % 7}" for k in range(60)]
    bad = [f"http://b.com/de/x{k}?id={k % 5}" for k in range(40)]
    free = ["http://other.net/page/3", "http://z.net/de/x?id=9", "HTTP://Q.net/é", "x" * 50_000, None, ""]
    pages = spark.createDataFrame(list(enumerate(good + bad + free)), "page_id long, url string").withColumns({"score": F.lit("x"), "fold": F.lit(1)})
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    yes, no = _plain_model(good), _plain_model(bad)
    for k, u in enumerate(free, start=100):
        codes = [url_filter.BORDER] * url_filter.ORDER + [int(url_filter._CODES[b]) for b in (u or "").encode()]
        steps = [(codes[i], codes[i - url_filter.ORDER : i]) for i in range(url_filter.ORDER, len(codes))]
        want = sum(math.log(yes(*s)) - math.log(no(*s)) for s in steps) / len(steps) if steps else 0.0
        assert got[k]["score"] == pytest.approx(want, abs=5e-3)
    assert got[100]["verdict"] == "allow" and got[101]["verdict"] == "block"


def test_url_threshold_is_set_on_left_out_folds(spark):
    """URLs of one kind with verdicts at random tell nothing: in-sample scores would part them, left-out ones don't."""
    rng = np.random.default_rng(1)
    urls = ["".join(rng.choice(list("abcdefgh"), 12)) for _ in range(400)]
    pages = spark.createDataFrame([(k, f"http://h.{'org' if k % 2 else 'com'}/{'' if k % 2 else 'de/'}{u}") for k, u in enumerate(urls)], "page_id long, url string")
    rules = (("h.org", "/", "allow"), ("h.com", "/de/", "block"))
    assert {r["verdict"] for r in url_filter.judge(pages, rules=rules).collect()} == {"allow", "block"}
    assert url_filter.judge(pages.limit(0)).count() == 0
    none = url_filter.judge(pages, rules=()).collect()  # an empty model
    assert len(none) == 400 and {r["score"] for r in none} == {0.0} and {r["verdict"] for r in none} == {"allow"}


def _jump(key, shards):
    at, jump = -1, 0
    while jump < shards:
        at = jump
        key = (key * 2862933555777941757 + 1) % 2**64
        jump = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_hash_is_the_scalar_one(spark):
    keys = np.random.default_rng(5).integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for shards in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, shards).tolist() == [_jump(int(k), shards) for k in keys]


def test_sharding_sizes_and_checksums(spark):
    import zlib

    rows = [(1, None), (2, ""), (3, "é世🎉"), (3, "é世🎉"), (None, "x" * 10_000)]
    got = sorted(((r["doc_id"] or 0), r["size"], r["text_crc32"]) for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
