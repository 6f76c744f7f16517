"""Scales of mixing where margins don't fit the cells, and topics of all documents."""

import logging

import numpy as np
import pyarrow as pa
import pytest

from skylattice.llm import mixing
from skylattice.llm.common import text_buffer
from skylattice.llm.mixing import calibrated, fit_topics, hashed_words, rake


def test_scale_of_starved_cells(spark, caplog):
    """Raking drives cells towards zero, yet about half of the tokens is kept."""
    rows = [("a", "en", "t0", 900_000), ("a", "en", "t1", 900_000), ("b", "fr", "t2", 50_000), ("b", "fr", "t0", 10), ("b", "en", "t1", 100_000)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    total = sum(r[-1] for r in rows)
    with caplog.at_level(logging.WARNING):
        out = calibrated(rake(cells, {}), total / 2).collect()
    assert sum(r["tokens"] * r["probability"] for r in out) == pytest.approx(total / 2, rel=1e-6)
    assert "margin error" in caplog.text


def test_scale_over_many_magnitudes(spark):
    cells = spark.createDataFrame([("a", 1000, 2000.0), ("b", 1000, 1e-9), ("c", 0, 0.0)], "source string, tokens long, raked double")
    for budget in (10.0, 1000.0, 1999.0, 2000.0):
        out = calibrated(cells, budget).collect()
        assert sum(r["tokens"] * r["probability"] for r in out) == pytest.approx(budget, rel=1e-6)
    assert all(r["probability"] == 0 for r in calibrated(cells, 0.0).collect())


def test_topics_of_all_documents(spark):
    """More documents than the start has, and words that stand in very long texts only."""
    texts = [f"common words of text {i}" for i in range(4000)] + ["rareword othername " * 2000] * 3
    topics = fit_topics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    counts = hashed_words(*text_buffer(pa.array(texts)))[0]
    assert np.allclose(topics.weights, np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))), rtol=1e-5)
    assert (topics.centroids[:, np.flatnonzero(counts[-1])].max(axis=0) > 0).all()


def test_both_ways_of_raking_agree(spark):
    """Cells raked in one array and as a table."""
    rows = [(s, lang, t, 10 + 7 * i * j + k) for i, s in enumerate("abc") for j, lang in enumerate(("en", "fr")) for k, t in enumerate(("t0", "t1", "t2"))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    key = lambda df: {(r["source"], r["lang"], r["topic"]): r["raked"] for r in df.collect()}
    one, before = key(rake(cells, {})), mixing.ARRAY_CELLS
    mixing.ARRAY_CELLS = 0
    try:
        two = key(rake(cells, {}))
    finally:
        mixing.ARRAY_CELLS = before
    assert one.keys() == two.keys() and all(two[c] == pytest.approx(v, rel=2e-3) for c, v in one.items())
