"""The quality classifier: held-out accuracy, scores by brute force, prior, risk, odd tables."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice.llm import quality_classifier as own
from skylattice.llm import queries
from skylattice.llm.common import text_buffer

MARKS = 0xFFFFFFFFFFFFFFFF


def _features(texts):
    return own.features(*text_buffer(pa.array(texts, pa.string())))


def test_held_out_accuracy(spark):
    """Rows whose labels weren't learned, at sf0.01, and none learned from them."""
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.op12_quality_classifier(spark, sf_dir).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 80 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert {r["predicted"] for r in rows} == {0, 1}


def test_what_is_not_learned(spark, sf_dir):
    """Labels of held-out rows turned round, languages and sources lost: same scores."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(own.bucket() == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    bare = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x"))
    scores = lambda d, q: {r["doc_id"]: r["score"] for r in own.quality_classifier(d, q).collect()}
    assert scores(docs, labels) == scores(bare, turned)
    # negative labels are of no use either: positives and unlabelled text are what is learned from
    assert scores(docs, labels) == scores(docs, labels.filter("quality = 1"))


def _by_hand(text):
    """Features of a text within one segment, a character at a time."""
    kinds = {c: k for k, chars in enumerate(own._KINDS) for c in chars}
    points = [kinds.get(c, len(own._KINDS) + (ord(c) > 127)) for c in text]
    runs = []
    for k in points:
        if runs and runs[-1][0] == k:
            runs[-1][1] += 1
        else:
            runs.append([k, 1])
    codes = [2 * k + (n > 1 and k not in own._LETTERS) for k, n in runs]
    grams = [0] * (1 << own.GRAM_BITS)
    for i in range(len(codes)):
        h = 0
        for n in range(1, min(own.LONGEST, len(codes) - i) + 1):
            h = (h + codes[i + n - 1] + (n << 8)) * 0x9E3779B97F4A7C15 & MARKS
            h ^= h >> 29
            grams[h >> (64 - own.GRAM_BITS)] += 1
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
    like = sum(a == b for a, b in zip(words, words[1:]))
    again = sum(len(words[i : i + own.WINDOW]) - len(set(words[i : i + own.WINDOW])) for i in range(0, len(words), own.WINDOW))
    some = max(1, len(words))
    return [math.sqrt(g / max(1, len(codes))) for g in grams] + [like / some, again / some, math.log1p(len(words)) / 10, sum(len(w.encode()) for w in words) / some / 10]


def test_scores_by_brute_force(spark):
    rng = random.Random(4)
    texts = ["", " ", "a", "Same same same. Same!!", "é漢字 \U0001f600 x\u0000y", "A | B | C\n\n- 12.5%"] + ["".join(rng.choice("abC  1.,!|\n\té漢") for _ in range(rng.randint(1, 300))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = own.Model(np.random.default_rng(0).normal(size=own.WIDTH), -0.3, 0.5)
    got = {r["doc_id"]: r["score"] for r in own.quality_classifier(docs, None, model).collect()}
    for i, t in enumerate(texts):
        x = _by_hand(t)
        assert _features([t])[0] == pytest.approx(x, abs=1e-6)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, model.weights)) + model.bias))), abs=1e-5)


def test_segments(monkeypatch):
    """A text over one segment is the sum of its segments; texts beside it change nothing."""
    text = "Some words, and some More words!! " * 60
    alone = _features([text])
    assert np.array_equal(_features(["x", text, "", text])[[1, 3]], np.concatenate([alone, alone]))
    monkeypatch.setattr(own, "SEGMENT", 34 * 20)
    parts, cut = _features([text[:680]]), _features([text, "y"])[0]
    # all segments of this one are alike, so shares are a segment's
    assert cut[:-2] == pytest.approx(parts[0][:-2], abs=1e-6) and cut[-2] == pytest.approx(math.log1p(6 * 60) / 10)


def test_prior_and_boundary():
    rng = np.random.default_rng(1)
    for prior in (0.2, 0.5, 0.85):
        sp = rng.normal(2, 1, 3000)
        su = np.where(rng.random(4000) < prior, rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000))
        assert own.best_bin(sp, su) == pytest.approx(prior, abs=0.06)
        assert own.boundary(sp, su, prior) == pytest.approx(0.5 * math.log((1 - prior) / prior) / 2, abs=0.9)


def test_non_negative_risk():
    """Gradients are those of the risk; where negatives' risk is under zero they raise it."""
    zp, zu, prior = np.array([0.3, -1.2, 2.0]), np.array([0.1, -0.4, 1.5, -2.0]), 0.3
    plus, minus = lambda z: np.logaddexp(0, -z), lambda z: np.logaddexp(0, z)
    negative = lambda p, u, c: minus(u).mean() - c * minus(p).mean()
    risk = lambda p, u: prior * plus(p).mean() + negative(p, u, prior)
    gp, gu, at = own.non_negative_step(zp, zu, prior)
    assert at == pytest.approx(negative(zp, zu, prior)) and at > 0
    e = 1e-6
    for i in range(3):
        d = np.eye(3)[i] * e
        assert gp[i] == pytest.approx((risk(zp + d, zu) - risk(zp - d, zu)) / 2 / e, abs=1e-6)
    for i in range(4):
        d = np.eye(4)[i] * e
        assert gu[i] == pytest.approx((risk(zp, zu + d) - risk(zp, zu - d)) / 2 / e, abs=1e-6)
    gp, gu, at = own.non_negative_step(zp + 5, zu - 5, 0.9)
    assert at < 0 and negative(zp + 5 - e * gp, zu - 5 - e * gu, 0.9) > at


def test_odd_tables(spark):
    more = "doc_id long, text string, lang string, source string, score double, held_out int, quality int, x binary"
    rows = [(1, "a b", "en", "w", 1.0, 1, 1, b""), (1, "a b", "en", "w", 1.0, 1, 1, b""), (2, None, None, None, None, None, None, None), (None, "no id", "en", "w", 1.0, 1, 1, b""), (3, "", "en", "w", 1.0, 1, 1, b""), (5, "long words " * 40000, "en", "w", 1.0, 1, 1, b"")]
    docs = spark.createDataFrame(rows, more)
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 0, "x"), (2, None, None, "x"), (None, 1, 0, "x"), (99, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = own.quality_classifier(docs, labels).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 1, 2, 3, 5] and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert own.quality_classifier(docs, labels.limit(0)).count() == 6 and own.quality_classifier(docs.limit(0), labels).count() == 0
    assert own.fit(docs, labels).prior is None
