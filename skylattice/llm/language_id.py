"""Language identification: averaged hashed subword embeddings and a linear softmax.

Character n-grams of words are hashed to rows of an embedding table; a text is the mean of
its rows, and a linear softmax over it gives the languages. Both are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled documents, whole and in
snippets. A temperature fitted on held-back documents calibrates the scores, and a threshold
on them rejects what the model can't place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import arrow_map, pieces, whole, with_text

#: Rows of the embedding table, its width, and the n-gram lengths.
ROWS, WIDTH, GRAMS = 1 << 15, 12, (1, 2, 3)
#: Bounds of the training sample: documents of a language, and of all of them (but at least
#: EACH of a language); and characters learned of a document, from a place drawn by its hash.
SAMPLE, DOCUMENTS, EACH, CHARACTERS = 6_000, 500, 20, 10_000
EPOCHS, RATE, BATCH = 6, 4.0, 32
#: Characters whose n-grams are held at once.
BLOCK = 1 << 18
#: Share of held-back documents that the threshold may reject.
REJECTED = 0.001
UNKNOWN = "und"


def _lowered(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of the texts' letters (words framed by a mark), and for each
    text where its rows begin, the total last."""
    points = [_lowered(" " + t + " ") for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
    # ASCII other than letters stands for one mark, and so do most marks above
    letter = (flat >= 0x61) & (flat <= 0x7A) | (flat >= 0xAA) & ~((flat >= 0x2000) & (flat < 0x2C00) | (flat >= 0x3000) & (flat < 0x3041))
    keep = letter | np.concatenate(([True], letter[:-1]))
    owner = np.repeat(np.arange(len(texts)), sizes)[keep]
    flat = np.where(letter, flat, 0x20)[keep].astype(np.uint64)
    rows, owners, h = [], [], np.zeros(len(flat), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        k = len(flat) - n + 1
        if k <= 0:
            break
        h = (h[:k] * np.uint64(0x100000001B3) + flat[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in GRAMS:
            # a gram lies in one text and, past its first mark, in one word
            good = owner[n - 1 :] == owner[:k]
            for i in range(1, n - 1):
                good &= flat[i : k + i] != 0x20
            if n == 1:
                good &= flat != 0x20
            rows.append((h >> np.uint64(65 - ROWS.bit_length()))[good].astype(np.int64))
            owners.append(owner[:k][good])
    rows, owners = np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
    order = np.argsort(owners, kind="stable")
    return rows[order], np.searchsorted(owners[order], np.arange(len(texts) + 1))


def blocks(texts: list[str]) -> Iterator[slice]:
    """Runs of texts with about BLOCK characters together, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > BLOCK:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def shares(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its different table rows and their shares of its n-grams."""
    out = []
    for block in blocks(texts):
        rows, begin = subwords(texts[block])
        for a, b in zip(begin[:-1], begin[1:]):
            r, n = np.unique(rows[a:b], return_counts=True)
            out.append((r.astype(np.int32), (n / max(1, b - a)).astype(np.float32)))
    return out


class Model:
    """languages, the product of embeddings and weights, biases, temperature, threshold."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.languages, self.table, self.bias, self.temperature, self.threshold = languages, table, bias, temperature, threshold

    def logits(self, texts: list[str]) -> np.ndarray:
        """Of all texts, a block at a time."""
        parts = [self._logits(texts[block]) for block in blocks(texts)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)))

    def _logits(self, texts: list[str]) -> np.ndarray:
        rows, begin = subwords(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(np.diff(begin))
        if len(full):
            for c in range(len(self.languages)):
                sums[full, c] = np.add.reduceat(self.table[:, c][rows], begin[full], dtype=np.float64)
        return sums / np.maximum(np.diff(begin), 1)[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages and calibrated scores; ``und`` and zero for texts without letters."""
        p = _softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        named = [any(map(str.isalpha, t)) for t in texts]
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, named)], np.where(named, p[np.arange(len(texts)), best], 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 5) -> Model:
    """A model of the labelled texts; one in five, chosen by the seed, is held back for the
    temperature and the threshold."""
    languages = sorted(set(labels))
    if not languages:
        return Model([UNKNOWN], np.zeros((ROWS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    target = np.searchsorted(languages, labels)
    held = rng.random(len(texts)) < 0.2

    def snippets(chosen: np.ndarray) -> tuple[list[str], np.ndarray]:
        out, y = [], []
        for i in chosen:
            words = texts[i].split()
            out.append(texts[i])
            y.append(target[i])
            for _ in range(3):
                n = int(rng.integers(1, 25))
                a = int(rng.integers(0, max(1, len(words) - n + 1)))
                out.append(" ".join(words[a : a + n]))
                y.append(target[i])
        return out, np.array(y, np.int64)

    x, y = snippets(np.flatnonzero(~held) if (~held).any() else np.arange(len(texts)))
    parts = shares(x)
    emb = rng.uniform(-1, 1, (ROWS, WIDTH)).astype(np.float32) / WIDTH
    out = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    full = np.array([i for i, (r, _) in enumerate(parts) if len(r)], np.int64)
    parts = [parts[i] for i in full]
    steps, step = EPOCHS * -(-len(full) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(full))
        for a in range(0, len(order), BATCH):
            rate, step = RATE * (1 - step / steps), step + 1
            own = order[a : a + BATCH]
            r = np.concatenate([parts[j][0] for j in own])
            w = np.concatenate([parts[j][1] for j in own])
            at = np.concatenate(([0], np.cumsum([len(parts[j][0]) for j in own])))[:-1]
            hidden = np.add.reduceat(emb[r] * w[:, None], at, axis=0)
            error = _softmax(hidden @ out + bias)
            error[np.arange(len(own)), y[full[own]]] -= 1
            error /= len(own)
            back = (error @ out.T).astype(np.float32)
            out -= np.float32(rate) * (hidden.T @ error).astype(np.float32)
            bias -= np.float32(rate * 0.1) * error.sum(axis=0).astype(np.float32)
            grad = np.repeat(back, [len(parts[j][0]) for j in own], axis=0) * w[:, None]
            np.subtract.at(emb, r, np.float32(rate * len(own)) * grad)
    seen = np.zeros(ROWS, bool)
    for r, _ in parts:
        seen[r] = True
    model = Model(languages, np.where(seen[:, None], emb @ out, 0).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    back = np.flatnonzero(held)
    if len(back) >= 20:
        x, y = snippets(back)
        z = model.logits(x)
        grid = np.geomspace(0.05, 20, 120)
        model.temperature = float(grid[np.argmin([-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid])])
        score = _softmax(z / model.temperature).max(axis=1)
        # what the held-back texts reach; never more than a coin's toss
        model.threshold = float(min(0.5, np.quantile(score, REJECTED)))
    return model


def bucket(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fit(docs: DataFrame) -> Model:
    """A model of the labelled documents that aren't held out, of every language. Language counts
    are over all of them; the sample is the share of each language, by hash of the row, that
    gives about DOCUMENTS of them (fewer where there are many languages); of a longer document
    CHARACTERS at one place are learned."""
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (bucket() != 2) & F.col("text").isNotNull())
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return train([], [])
    most = max(EACH, min(DOCUMENTS, SAMPLE // len(counts)))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, most / r["count"])))])
    place = F.xxhash64(F.col("doc_id").cast("string"), "text")
    drawn = F.pmod(place, F.lit(1 << 30)) / float(1 << 30)
    start = F.pmod(F.shiftright(place, 30), F.greatest(F.length("text") - CHARACTERS + 1, F.lit(1))) + 1
    excerpt = F.when(F.length("text") > CHARACTERS, F.substring("text", start.cast("int"), F.lit(CHARACTERS))).otherwise(F.col("text")).alias("text")
    sample = usable.filter(drawn < share[F.col("lang")]).select(excerpt, "lang").limit(2 * max(SAMPLE, EACH * len(counts)))
    rows = sorted((r["lang"], r["text"]) for r in sample.collect())
    return train([t for _, t in rows], [lang for lang, _ in rows])


def language_id(docs: DataFrame, model: Model | None = None, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every whole text; with ``carry`` also
    row, the document's columns as a struct.

    Without a model one is fitted on ``docs`` (see fit). lang_pred is a learned language, or
    ``und`` (score 0) for null and texts without a letter. rejected: ``und``, or a score under
    the calibrated threshold. A null doc_id isn't held out and isn't learned from. lang, source
    and doc_id take no part in predictions; other columns aren't read. Repeated rows get the
    same values; an empty table gives an empty result; without labels all is ``und``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches):
        m = sent.value
        for batch in with_text(batches) if carry else batches:
            for part in pieces(batch, most=1 << 20):
                names, scores = m.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores), pa.array([n == UNKNOWN or s < m.threshold for n, s in zip(names, scores)]), part.column("row")], ["doc_id", "held_out", "lang_pred", "score", "rejected", "row"])

    row = (F.struct("*") if carry else F.lit(None).cast("boolean")).alias("row")
    kinds = [docs.schema["doc_id"].dataType.simpleString(), docs.select(row).schema["row"].dataType.simpleString()]
    asked = docs.select("doc_id", *([] if carry else [whole()]), F.coalesce(bucket() == 2, F.lit(False)).alias("held_out"), row)
    out = arrow_map(asked, run, "doc_id %s, held_out boolean, lang_pred string, score double, rejected boolean, row %s" % tuple(kinds))
    return out if carry else out.drop("row")
