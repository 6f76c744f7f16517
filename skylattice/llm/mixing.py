"""Mixing sources to target weights by iterative proportional fitting.

Documents get a topic (spherical k-means over hashed words, fitted on all of them) and a
token weight (their words). The table of (source, language, topic) cells is raked until its
margins meet the targets; a document is then kept with its cell's raked weight over its
weight in the corpus, scaled so that the expected tokens meet the budget.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.common import NOT_SPACE, TO_LOWER, arrow_map, drawn, pieces, span_hashes, stash, text_buffer, whole, with_text, word_bounds

#: Topics, hashed word dimensions, texts that centroids start from, and rounds over all texts.
TOPICS, DIMENSIONS, SAMPLE, ROUNDS = 8, 1 << 11, 2_000, 3
#: Parts of one that vectors are added up in.
FIXED = 1 << 20
#: Texts whose counts are held at once.
ROWS = 500
#: Sweeps over the margins in one job, jobs at most, and the relative error that ends them.
SWEEPS, JOBS, ERROR = 4, 12, 1e-3
#: Cells up to this number are raked in one array; more of them as a table.
ARRAY_CELLS = 200_000
MARGINS = ("source", "lang", "topic")
#: Default targets: a margin's share is in proportion to its tokens to this power.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: Candidate scales tried in one pass, passes at most, and the relative width that ends them.
SCALES, PASSES, TOLERANCE = 64, 8, 1e-9


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed words (texts by dimensions) and each text's words."""
    lower = TO_LOWER[data]
    starts, ends, firsts = word_bounds(lower, offsets, NOT_SPACE)
    n, sizes = len(offsets) - 1, np.diff(firsts)
    dims = (span_hashes(lower, starts, ends) & np.uint64(DIMENSIONS - 1)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(n), sizes) * DIMENSIONS + dims, minlength=n * DIMENSIONS)
    return counts.reshape(n, DIMENSIONS).astype(np.float32), sizes


class Topics:
    """Weights of the dimensions, from document frequencies, and unit centroids."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray, k: int = TOPICS, seed: int = 11):
        n = len(counts)
        self.weights = weights.astype(np.float32)
        x, rng = self.vectors(counts), np.random.default_rng(seed)
        centroids = x[rng.integers(0, n, 1)] if n else np.zeros((1, DIMENSIONS), np.float32)
        while len(centroids) < min(k, n):
            gap = np.maximum(1 - (x @ centroids.T).max(axis=1), 0)
            if gap.sum() <= 0:
                break
            centroids = np.vstack([centroids, x[rng.choice(n, p=gap / gap.sum())]])
        self.centroids = centroids.astype(np.float32)
        del x
        for _ in range(15 if n else 0):
            self.moved(self.sums(counts))

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.weights
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def assign(self, counts: np.ndarray) -> np.ndarray:
        return (self.vectors(counts) @ self.centroids.T).argmax(axis=1)

    def sums(self, counts: np.ndarray) -> np.ndarray:
        """Sums of the vectors of each centroid's texts in units of 1 / FIXED, which add up to the
        same in any order."""
        sums = np.zeros(self.centroids.shape, np.int64)
        for a in range(0, len(counts), ROWS):
            x = self.vectors(counts[a : a + ROWS])
            own, fixed = (x @ self.centroids.T).argmax(axis=1), np.rint(x * FIXED).astype(np.int64)
            sums += np.stack([fixed[own == j].sum(axis=0) for j in range(len(self.centroids))])
        return sums

    def moved(self, sums: np.ndarray) -> None:
        """Centroids put at these sums; one without texts stays."""
        norms = np.linalg.norm(sums.astype(np.float64), axis=1, keepdims=True)
        self.centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-9), self.centroids).astype(np.float32)


def added(docs: DataFrame, size: int, measure) -> np.ndarray:
    """The sum over all texts of ``measure`` (``size`` whole numbers for the counts of some texts)."""

    def run(batches):
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for part in pieces(batch, rows=ROWS):
                sums += measure(hashed_words(*text_buffer(part.column("text")))[0])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["place", "n"])

    total = np.zeros(size, np.int64)
    for r in arrow_map(docs.select(whole()), run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        total[r["place"]] = r["n"]
    return total


def _start(docs: DataFrame) -> np.ndarray:
    """Counts of about SAMPLE texts drawn by hash, which centroids start from."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, rows=ROWS):
                counts = hashed_words(*text_buffer(part.column("text")))[0]
                at = [np.flatnonzero(x) for x in counts]
                yield pa.RecordBatch.from_arrays([pa.array([i.astype(np.int32).tobytes() for i in at], pa.binary()), pa.array([x[i].tobytes() for x, i in zip(counts, at)], pa.binary())], ["dims", "counts"])

    chosen = drawn(docs.select("doc_id", whole()), SAMPLE, "doc_id", "text").select("text")
    rows = sorted((bytes(r["dims"]), bytes(r["counts"])) for r in arrow_map(chosen, run, "dims binary, counts binary").collect())
    counts = np.zeros((len(rows), DIMENSIONS), np.float32)
    for x, (dims, own) in zip(counts, rows):
        x[np.frombuffer(dims, np.int32)] = np.frombuffer(own, np.float32)
    return counts


def fit_topics(docs: DataFrame) -> Topics:
    """Topics of all documents: document frequencies are counted over all of them, and centroids,
    after a start on a sample, are moved by rounds over all of them."""
    spark = docs.sparkSession
    found = added(docs, DIMENSIONS + 1, lambda counts: np.append((counts > 0).sum(axis=0), len(counts)))
    topics = Topics(_start(docs), np.log((1 + found[-1]) / (1 + found[:-1])))
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(topics)
        shape = topics.centroids.shape
        topics.moved(added(docs, shape[0] * shape[1], lambda counts: sent.value.sums(counts).ravel()).reshape(shape))  # noqa: B023
    return topics


def described(docs: DataFrame, topics) -> DataFrame:
    """row (the document's columns), source and lang (null as empty), topic, n_tokens, draw."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")]
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(20_011)), F.lit(1 << 40)) / float(1 << 40)

    def run(batches):
        for batch in with_text(batches):
            for part in pieces(batch, rows=ROWS):
                counts, sizes = hashed_words(*text_buffer(part.column("text")))
                named = pa.array([f"t{i}" for i in topics.value.assign(counts).tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("source"), part.column("lang"), named, pa.array(sizes, pa.int64()), part.column("draw")], ["row", "source", "lang", "topic", "n_tokens", "draw"])

    kind = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    return arrow_map(docs.select(F.struct("*").alias("row"), *key, draw.alias("draw")), run, f"row {kind}, source string, lang string, topic string, n_tokens long, draw double")


def rake(cells: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """cells with ``raked``: token weights whose margins are the targets' shares of all tokens.

    A margin without given targets aims at shares in proportion to its tokens to the power in
    POWERS. Values without a share get none; targets of values without tokens can't be met and
    their share goes to the others. Where the margins aren't met within ERROR the remaining
    relative error is logged as a warning.
    """
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    for m in MARGINS:
        if m in targets:
            share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in targets[m].items() for x in (kv[0], float(kv[1]))]), F.col(m)), F.lit(0.0))
        else:
            share = F.pow(F.sum("tokens").over(Window.partitionBy(m)).cast("double"), F.lit(POWERS[m]))
        cells = cells.withColumn(f"want_{m}", share)
    cells = stash(spark, cells.withColumn("raked", F.col("tokens").cast("double")), "cells")
    # each margin's wanted shares, scaled to the tokens there are
    for m in MARGINS:
        sums = cells.filter("tokens > 0").groupBy(m).agg(F.first(f"want_{m}").alias("w")).agg(F.sum("w")).first()[0] or 1.0
        cells = cells.withColumn(f"want_{m}", F.col(f"want_{m}") * (total / sums))
    return _rake_array(cells) if cells.count() <= ARRAY_CELLS else _rake_table(cells)


def _unmet(off: float) -> None:
    """Tells of margins that the cells' support can't meet, or not within the sweeps."""
    logging.getLogger(__name__).warning("raking ended with a relative margin error of %.3g", off)


def _rake_array(cells: DataFrame) -> DataFrame:
    rows = cells.toPandas()
    raked = rows["raked"].to_numpy(np.float64).copy()
    codes = {m: np.unique(rows[m].to_numpy(str), return_inverse=True)[1] for m in MARGINS}
    for _ in range(SWEEPS * JOBS):
        off = 0.0
        for m in MARGINS:
            sums, want = np.bincount(codes[m], raked), rows[f"want_{m}"].to_numpy(np.float64)
            has = sums[codes[m]]
            off = max(off, float((np.abs(has - want) / np.maximum(want, 1e-9))[has > 0].max(initial=0)))
            raked = np.where(has > 0, raked * want / np.where(has > 0, has, 1), 0.0)
        if off < ERROR:
            break
    else:
        _unmet(off)
    return cells.sparkSession.createDataFrame(rows.assign(raked=raked), cells.schema)


def _rake_table(cells: DataFrame) -> DataFrame:
    spark, margin = cells.sparkSession, {m: F.sum("raked").over(Window.partitionBy(m)) for m in MARGINS}
    for _ in range(JOBS):
        for _ in range(SWEEPS):
            for m in MARGINS:
                cells = cells.withColumn("raked", F.when(margin[m] > 0, F.col("raked") * F.col(f"want_{m}") / margin[m]).otherwise(0.0))
        cells = stash(spark, cells, "cells")
        off = max(cells.groupBy(m).agg((F.abs(F.sum("raked") - F.first(f"want_{m}")) / F.greatest(F.first(f"want_{m}"), F.lit(1e-9))).alias("off"), F.sum("raked").alias("t")).filter("t > 0").agg(F.max("off")).first()[0] or 0.0 for m in MARGINS)
        if off < ERROR:
            break
    else:
        _unmet(off)
    return cells


def calibrated(cells: DataFrame, budget: float) -> DataFrame:
    """cells with ``probability`` and ``weight``: min(1, scale * raked / tokens), for the scale at
    which the expected tokens are the budget, and what a kept document then stands for.

    A cell is kept whole from the scale tokens / raked on. These scales lie many orders of
    magnitude apart where raking drives cells towards zero, so they are narrowed on a log scale."""
    rate = F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(0.0)
    least, most = cells.filter(rate > 0).agg(F.min(1 / rate), F.max(1 / rate)).first()
    scale = 0.0
    if least is not None and budget > 0:
        # at the lowest no cell is kept whole and no more than the budget is kept
        total = float(cells.agg(F.sum("raked")).first()[0])
        low, high = min(math.log(least), math.log(budget / total)), math.log(most)
        for _ in range(PASSES):
            if high - low <= TOLERANCE:
                break
            grid = [low + (high - low) * i / SCALES for i in range(SCALES + 1)]
            # scales as rows: as many sums in one row are much code, compiled anew in each pass
            tried = cells.select("tokens", rate.alias("rate"), F.posexplode(F.lit(np.array([math.exp(c) for c in grid]))).alias("i", "scale"))
            kept = dict(tried.groupBy("i").agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("rate") * F.col("scale")))).collect())
            i = next((i for i in range(SCALES, -1, -1) if kept[i] <= budget), 0)
            low, high = grid[i], grid[min(i + 1, SCALES)]
        scale = math.exp(low)
    p = F.least(F.lit(1.0), rate * scale)
    return cells.withColumn("probability", p).withColumn("weight", F.when(p > 0, rate * scale / p).otherwise(0.0))


def mixing(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = 0.5) -> DataFrame:
    """row (the document's columns as a struct), source, lang, topic, n_tokens, probability,
    weight and kept of every document.

    n_tokens are words (runs without space and control white space; null and empty texts have
    none and are never kept). Margins are raked to ``targets`` ({"source": {...}, "lang": {...},
    "topic": {...}}, shares of the tokens; see rake for those not given), and about ``fraction``
    of all tokens is kept. A null source or language is a value of its own, written as an empty
    string. Draws are hashes of doc_id and text, so repeated rows share their fate and a rerun
    keeps the same rows. An empty table gives an empty result. docs needs doc_id, text, source
    and lang; further columns stay in row, whatever their names.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(fit_topics(docs))
    cells = stash(spark, described(docs.select("doc_id", "text", "source", "lang"), sent).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    cells = stash(spark, calibrated(rake(cells, targets or {}), fraction * total).select(*MARGINS, "probability", "weight"), "cells")
    out = described(docs, sent).join(cells, [*MARGINS])
    return out.select("row", *MARGINS, "n_tokens", "probability", "weight", (F.col("draw") < F.col("probability")).alias("kept"))
