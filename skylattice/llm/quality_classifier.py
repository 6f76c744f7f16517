"""Quality classifier learned from positives and unlabelled text.

Trusted positives are documents that labels call good; everything else is unlabelled, whatever
it is. The class prior (the share of good ones among the unlabelled) is estimated by the best
bin: of the scores that tell positives from unlabelled text, the top bin whose share among the
unlabelled, over that among positives, has the least upper bound. Then a linear model minimises
the non-negative unbiased risk: with prior p, loss of positives as positives p * R+, plus that
of the unlabelled as negatives less p times that of positives as negatives, which, being the
risk of the negatives, can't be under zero; where a batch's estimate is, the step undoes it.

Features are of form, not of words, so that a language counts for nothing: n-grams of runs of
character kinds (letters, capitals, digits, spaces, kinds of marks), repeated words, lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import NOT_SPACE, arrow_map, drawn, pieces, span_hashes, text_buffer, whole, word_bounds

#: Bounds of the training sample: trusted positives and unlabelled documents.
POSITIVES, UNLABELLED = 2_000, 3_000
#: Hashed n-grams of kinds (powers of two), their greatest length, and words of a window.
GRAM_BITS, LONGEST, WINDOW = 11, 4, 64
#: Bytes of a text that are read at once; n-grams and windows lie within such a segment.
SEGMENT = 1 << 20
STEPS, RATE, BATCH, DECAY = 3_000, 0.05, 64, 1e-5
#: Confidence of the prior's bound: that it fails, and its slack.
DELTA, GAMMA = 0.1, 0.01
_GRAMS = 1 << GRAM_BITS
WIDTH = _GRAMS + 4

#: Kinds of bytes in this order; bytes within a character are of none.
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\v\f", "\n\r", ".", ",", ";:", "!?", "'\"()[]{}", "-_/", "|", "#$%&*+<=>@\\^`~")
_WITHIN = 255


def _kinds() -> np.ndarray:
    kinds = np.full(256, len(_KINDS), np.uint8)  # control characters
    for k, chars in enumerate(_KINDS):
        kinds[[ord(c) for c in chars]] = k
    kinds[0x80:0xC0] = _WITHIN
    kinds[0xC0:] = len(_KINDS) + 1  # other letters and signs
    return kinds


_KIND = _kinds()
#: Kinds whose runs count alike whatever their length.
_LETTERS = (0, len(_KINDS) + 1)


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the counts of its n-grams, and: runs, words like the one before, words
    that repeat within their window, words, bytes of words."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kind = _KIND[data]
    seen = kind != _WITHIN
    kind, owner = kind[seen], owner[seen]
    first = np.ones(len(kind), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    several = (np.diff(np.append(at, len(kind))) > 1) & ~np.isin(kind[at], _LETTERS)
    runs, owner = kind[at].astype(np.uint64) * np.uint64(2) + several, owner[at]
    grams = np.zeros(n * _GRAMS, np.int64)
    h = np.zeros(len(runs), np.uint64)
    for k in range(1, min(LONGEST, len(runs)) + 1):
        end = runs[k - 1 :]
        h = (h[: len(end)] + end + np.uint64(k << 8)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        inside = owner[k - 1 :] == owner[: len(end)]
        grams += np.bincount((owner[: len(end)] * _GRAMS + (h >> np.uint64(64 - GRAM_BITS)).astype(np.int64))[inside], minlength=n * _GRAMS)
    starts, ends, begin = word_bounds(data, offsets, NOT_SPACE)
    words = span_hashes(data, starts, ends)
    owner_of = np.repeat(np.arange(n), np.diff(begin))
    like = np.zeros(len(words), bool)
    like[1:] = (words[1:] == words[:-1]) & (owner_of[1:] == owner_of[:-1])
    window = (np.arange(len(words)) - begin[:-1][owner_of]) // WINDOW
    order = np.lexsort((words, window, owner_of))
    a, b, c = owner_of[order], window[order], words[order]
    again = np.zeros(len(words), bool)
    again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1])
    total = lambda of, weight=None: np.bincount(of, weight, minlength=n)
    return grams.reshape(n, _GRAMS), np.stack([total(owner), total(owner_of, like), total(a, again), total(owner_of), total(owner_of, ends - starts)], axis=1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """WIDTH features of each text (UTF-8 bytes and offsets), whole texts a segment at a time."""
    n = len(offsets) - 1
    grams, sums = np.zeros((n, _GRAMS)), np.zeros((n, 5))
    cuts = [(i, a, min(a + SEGMENT, offsets[i + 1])) for i in range(n) for a in range(offsets[i], offsets[i + 1], SEGMENT)]
    at = 0
    while at < len(cuts):
        to = at + 1
        while to < len(cuts) and cuts[to][2] - cuts[at][1] <= SEGMENT:
            to += 1
        part = cuts[at:to]
        g, s = _counted(data[part[0][1] : part[-1][2]], np.array([a for _, a, _ in part] + [part[-1][2]]) - part[0][1])
        own = [i for i, _, _ in part]
        np.add.at(grams, own, g)
        np.add.at(sums, own, s)
        at = to
    runs, like, again, words, size = sums.T
    some = np.maximum(words, 1)
    return np.concatenate([np.sqrt(grams / np.maximum(runs, 1)[:, None]), np.stack([like / some, again / some, np.log1p(words) / 10, size / some / 10], axis=1)], axis=1).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Model:
    """Weights and bias of the linear model; prior is what it was trained with."""

    def __init__(self, weights: np.ndarray, bias: float, prior: float | None):
        self.weights, self.bias, self.prior = weights, bias, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(x @ self.weights + self.bias)


def non_negative_step(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of a step by the scores of positives and of unlabelled texts (logistic loss), and
    the estimated risk of the negatives. If that is under zero the step raises it instead."""
    negatives = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    as_negative, unlabelled = prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
    if negatives < 0:
        return as_negative, -unlabelled, negatives
    return prior * (_sigmoid(zp) - 1) / len(zp) - as_negative, unlabelled, negatives


def _descend(p: np.ndarray, u: np.ndarray, step, steps: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Weights and bias after so many steps, each of a batch of positives and one of unlabelled
    rows; steps are scaled by the gradients so far."""
    w, b = np.zeros(WIDTH), 0.0
    past, past_b = np.full(WIDTH, 1e-8), 1e-8

    def batches(rows: np.ndarray) -> Iterator[np.ndarray]:
        size = min(BATCH, len(rows))
        while True:
            order = rng.permutation(len(rows))
            for k in range(0, len(rows) - size + 1, size):
                yield rows[order[k : k + size]]

    for _, xp, xu in zip(range(steps), batches(p), batches(u)):
        gp, gu = step(xp @ w + b, xu @ w + b)
        g, gb = xp.T @ gp + xu.T @ gu + DECAY * w, gp.sum() + gu.sum()
        past += g * g
        past_b += gb * gb
        w -= RATE * g / np.sqrt(past)
        b -= RATE * gb / np.sqrt(past_b)
    return w, b


def best_bin(sp: np.ndarray, su: np.ndarray) -> float:
    """The prior by the scores of positives and of unlabelled texts that weren't learned."""
    at = np.unique(sp)
    qp = 1 - np.searchsorted(np.sort(sp), at) / len(sp)
    qu = 1 - np.searchsorted(np.sort(su), at) / len(su)
    slack = (1 + GAMMA) * sum(np.sqrt(np.log(4 / DELTA) / 2 / len(s)) for s in (sp, su))
    best = np.argmin((qu + slack) / qp)
    return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


def boundary(sp: np.ndarray, su: np.ndarray, prior: float) -> float:
    """Where the non-negative risk of the zero-one loss is least: the middle of the range, or of
    the highest one, since a lower one takes more unlabelled texts for good ones unasked."""
    at = np.unique(np.concatenate([sp, su]))
    mid = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2])
    missed = np.searchsorted(np.sort(sp), mid) / len(sp)
    taken = 1 - np.searchsorted(np.sort(su), mid) / len(su)
    risk = prior * missed + np.maximum(0, taken - prior * (1 - missed))
    return float(mid[np.flatnonzero(risk <= risk.min() + 1e-12)[-1]])


def train(p: np.ndarray, u: np.ndarray, seed: int = 7) -> Model:
    """A model by the features of positives and of unlabelled texts; every third row is held
    back for the prior and the boundary. Without either there is nothing to learn: all score a
    half."""
    if len(p) < 3 or len(u) < 3:
        return Model(np.zeros(WIDTH), 0.0, None)
    rng = np.random.default_rng(seed)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    (p, p_back), (u, u_back) = [(x[np.arange(len(x)) % 3 > 0], x[::3]) for x in (p, u)]
    w, b = _descend(p, u, lambda zp, zu: ((_sigmoid(zp) - 1) / len(zp), _sigmoid(zu) / len(zu)), STEPS // 3, rng)
    prior = best_bin(p_back @ w + b, u_back @ w + b)
    w, b = _descend(p, u, lambda zp, zu: non_negative_step(zp, zu, prior)[:2], STEPS, rng)
    return Model(w, b - boundary(p_back @ w + b, u_back @ w + b, prior), prior)


def bucket(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def _sampled(docs: DataFrame) -> np.ndarray:
    """Features of a bounded frame's texts, in the order of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, most=SEGMENT, rows=256):
                x = features(*text_buffer(part.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    rows = sorted(bytes(r["x"]) for r in arrow_map(docs.select(whole()), run, "x binary").collect())
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), WIDTH)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of documents that aren't held out: about POSITIVES of those whose labels all say 1,
    and about UNLABELLED of all of them, drawn by hash; texts are read whole, in the tasks."""
    good = labels.filter(bucket() != 1).groupBy("doc_id").agg(F.min("quality").alias("least")).filter("least = 1").select("doc_id")
    usable = docs.select("doc_id", "text").filter(bucket() != 1)
    chosen = F.broadcast(drawn(good, POSITIVES, "doc_id"))
    return train(_sampled(usable.join(chosen, "doc_id", "left_semi").limit(2 * POSITIVES)), _sampled(drawn(usable, UNLABELLED, "doc_id", "text")))


def quality_classifier(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Without a model one is fitted (see fit). score is above a half where the text is taken for a
    good one, and predicted is 1 from a half on. A null text counts as empty, and empty texts have
    a score like others. Labels, lang, source and doc_id take no part in scores; labels of held-out
    rows, of null quality or of no document aren't learned, nor are documents whose labels differ.
    A null doc_id isn't held out and isn't learned from. Repeated rows get the same values; an
    empty table gives an empty result; without positives all score a half.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, most=SEGMENT, rows=256):
                score = sent.value.scores(features(*text_buffer(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    asked = docs.select("doc_id", whole(), F.coalesce(bucket() == 1, F.lit(False)).alias("held_out"))
    return arrow_map(asked, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
