"""Stages of the pipeline on odd rows, and against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from skylattice.llm.common import flagged, without
from skylattice.llm.exact_dedup import first_copies

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, locator string, digest string, place string, hit string, topic string, probability string"
MORE = ("r", "l", "d", "p", "h", "t", "q")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, repeated ids and rows, empty and long texts, clashing columns."""
    plain = "it was a bright cold day and all the clocks were striking thirteen times in a row"
    rows = [(1, plain, "en", "a", 5), (2, plain, "en", "a", 5), (2, "another text of some length that nobody else has got", "en", "b", 5), (3, "ein anderer Text auf Deutsch ist auch da und bleibt", "de", None, None), (None, "no id but a text of its own and letters", "en", "b", 1), (None, None, None, None, None), (4, "", "en", "a", 0), (4, "", "en", "a", 0), (5, "many words " * 30_000, None, "b", 1)]
    return spark.createDataFrame([(*r, *MORE) for r in rows], SCHEMA)


def _key(rows):
    return sorted((r["doc_id"] or 0, r["text"] or "") for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_odd_rows(name, spark, sf_dir, odd):
    stage = dict(pipeline.STAGES)[name]
    out = stage(spark, odd, sf_dir)
    assert set(odd.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert name == "mixed" or out.columns == odd.columns
    got, came = _key(out.collect()), _key(odd.collect())
    assert all(came.count(k) >= got.count(k) for k in set(got))
    assert stage(spark, odd.limit(0), sf_dir).count() == 0
    if name == "exact":
        assert len(got) == len(set(came)) - 2  # of the twins 1 and 2 one, of the empty texts one
    if name == "near":
        assert {k for k in set(came) if k[1]} - set(got) == {k for k in came if k[0] == 2 and k[1].startswith("it was")} and len(got) == 6
    if name == "clean":
        assert got == came
    if name == "language":
        assert all(t for _, t in got) and len(got) >= 4


def test_repeated_ids(spark):
    """An id of a near copy that another text has too."""
    a, b = "some words that stand in two rows of this table", "quite different ones with nothing in common at all"
    docs = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    assert _key(pipeline.near(spark, docs, "").collect()) == [(1, a), (2, b)]
    docs = spark.createDataFrame([(5, a), (2, b), (9, a), (5, b)], "doc_id long, text string")
    assert _key(pipeline.near(spark, docs, "").collect()) == [(2, b), (5, a)]
    assert _key(first_copies(docs).collect()) == [(2, b), (5, a)]


def test_frame_without_places(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a "), (3, "a"), (3, "b")], "doc_id long, text string")
    assert _key(first_copies(docs.unionByName(docs)).collect()) == [(1, "a"), (2, "a "), (3, "b")]


def test_near_by_brute_force(spark, sf_dir):
    """Groups of fingerprints linked within the stage's bits; near copies go, others stay."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    texts = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(30)]
    copies = []
    for t in texts[:10]:
        for _ in range(3):
            c = list(t)
            for _ in range(3):
                c[rng.randrange(200)] = rng.choice(vocabulary)
            copies.append(c)
    words = texts + copies
    order = rng.sample(range(len(words)), len(words))
    docs = spark.createDataFrame([(i, " ".join(words[j])) for i, j in enumerate(order)], "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in pipeline.near(spark, docs, sf_dir).collect()}
    prints = []
    for j in order:
        grams = [xxhash.xxh64_intdigest(" ".join(words[j][k : k + pipeline.NEAR_SHINGLE]), 42) for k in range(200 - pipeline.NEAR_SHINGLE + 1)]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in grams) > len(grams)))
    want, left = set(), set(range(len(order)))
    while left:
        todo = [min(left)]
        want.add(todo[0])
        while todo:
            x = todo.pop()
            left.discard(x)
            todo.extend(y for y in left if (prints[x] ^ prints[y]).bit_count() <= pipeline.NEAR_BITS)
    assert kept == want and {order[i] for i in kept} >= set(range(10, 30)) and len(kept) <= 45


def test_clean_by_brute_force(spark, sf_dir):
    """The contamination rule on made documents, in plain Python."""
    tests = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r["text"]]
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    windows = set()
    for t in tests:
        w = find(lower(t))
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}
    rng = random.Random(2)
    docs = []
    for i in range(60):
        own = [f"w{rng.randrange(9999)}" for _ in range(rng.randint(0, 400))]
        piece = rng.choice(tests).split()
        at, n = rng.randint(0, len(own)), rng.choice([0, 10, 13, 20, len(piece)])
        docs.append((i, " ".join(own[:at] + piece[:n] + own[at:]).upper() if i % 2 else " ".join(own[:at] + piece[:n] + own[at:])))
    want = set()
    for i, t in docs:
        w = find(lower(t))
        hit = {j + k for n in sizes for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in windows for k in range(n)}
        if not (hit and 20 * len(hit) >= len(w)):
            want.add(i)
    got = {r["doc_id"] for r in pipeline.clean(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf_dir).collect()}
    assert got == want and 0 < len(want) < 60


def test_bitmaps(spark):
    """A flag is never false for a key that is there, and without() is exact."""
    df = spark.range(50_000).withColumnRenamed("id", "k")
    some = spark.range(0, 50_000, 7).withColumnRenamed("id", "x")
    marked = flagged(df, F.col("k"), some, "f")
    assert marked.filter("k % 7 = 0 and not f").count() == 0 and marked.filter("k % 7 <> 0 and f").count() < 0.1 * 50_000
    assert without(df, F.col("k"), some).count() == 50_000 - some.count() and without(df, F.col("k"), some.limit(0)).count() == 50_000
