"""Memory of a task's vectorised step."""

import tracemalloc

import numpy as np

from skylattice.llm import common, simhash_dedup


def test_fingerprints_of_a_chunk():
    """One step over CHUNK_BYTES of short words takes some 40 bytes for each byte of text (with the
    sums of all bits made at once, 126)."""
    data = np.frombuffer(b" ".join(b"w%d" % (i * 7919 % 5003) for i in range(350_000)), np.uint8)[: common.CHUNK_BYTES]
    offsets = np.unique(np.append(np.arange(0, len(data), 4000), len(data)))
    tracemalloc.start()
    try:
        simhash_dedup.fingerprints_of(data, offsets, 2)
        assert tracemalloc.get_traced_memory()[1] < 60 * len(data)
    finally:
        tracemalloc.stop()


def test_batches_of_a_stash(spark):
    """A stash can bound the Arrow batches of its functions; the session's setting comes back."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["bytes"])

    before = spark.conf.get(common.BATCH_SETTING)
    texts = spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 1000) as text")
    told = lambda **how: common.stash(spark, common.arrow_map(texts, sizes, "bytes long"), "sizes", **how).agg({"bytes": "max"}).first()[0]
    assert told() > 1_500_000 and told(batch_bytes=100_000) < 200_000 and spark.conf.get(common.BATCH_SETTING) == before


def test_chunks_of_small_rows(spark, monkeypatch):
    """op5's chunks are written a text a row; read in two parts of one chunk, the same words go."""
    from skylattice.llm import substring_dedup as op5

    docs = spark.createDataFrame([(i, " ".join(f"w{(i % 7) * 1000 + j}" for j in range(40 + i))) for i in range(60)] + [(60, None), (61, "")], "doc_id long, text string").coalesce(1)
    chunks = common.stash(spark, op5.pack(docs), "chunks")
    assert chunks.count() == 62 and chunks.select("chunk").distinct().count() == 1
    told = lambda: {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in op5.substring_dedup(docs).collect()}
    whole = told()
    assert sum(r[1] for r in whole.values()) > 1000 and len(whole) == 62
    before = spark.conf.get(common.BATCH_SETTING)
    monkeypatch.setattr(op5, "runs", lambda batches, f=op5.runs: (x for b in batches for half in (b.slice(0, b.num_rows // 2), b.slice(b.num_rows // 2)) for x in f([half])))
    assert told() == whole and spark.conf.get(common.BATCH_SETTING) == before


def test_packed_texts(monkeypatch):
    """A chunk ends with the text that fills it; places count the words of a chunk."""
    import pyarrow as pa

    from skylattice.llm import substring_dedup as op5

    monkeypatch.setattr(op5, "PACK_BYTES", 8)
    batch = pa.record_batch({"doc_id": pa.array([1, 2, 3, 4, 5]), "text": pa.array(["a b", "", "c d e f", "g", "h"])})
    rows = pa.Table.from_batches(list(op5.packed([batch.slice(0, 2), batch.slice(2)]))).to_pylist()
    assert [r["first"] for r in rows] == [0, 2, 2, 0, 1] and [r["doc_id"] for r in rows] == [1, 2, 3, 4, 5]
    assert len({r["chunk"] for r in rows[:3]}) == len({r["chunk"] for r in rows[3:]}) == 1 and rows[0]["chunk"] != rows[3]["chunk"]


def test_keys_of_fingerprints_in_one_scan(spark):
    """The driver plans one branch for all keys, and they are those of each group."""
    from itertools import combinations

    fps = spark.createDataFrame([(x,) for x in (0, -1, 12345, -(1 << 63))], "fp long")
    groups = [(list(range(0, 30)), 1), (list(range(30, 64)), 0), (list(range(50, 64)), 2)]
    asked = simhash_dedup.probes(fps, groups)
    assert asked._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    want = sorted((i, ((x[0] & (1 << 64) - 1) ^ sum(1 << b for b in bits)) & sum(1 << b for b in g), x[0]) for x in fps.collect() for i, (g, t) in enumerate(groups) for k in range(t + 1) for bits in combinations(g, k))
    assert sorted((r["part"], r["key"] & (1 << 64) - 1, r["fp"]) for r in asked.collect()) == want


def test_sums_of_topics():
    """Vectors of the driver's texts are made some at a time; the sums are the same."""
    from skylattice.llm import mixing

    counts = np.random.default_rng(3).poisson(0.02, (2000, mixing.DIMENSIONS)).astype(np.float32)
    topics = mixing.Topics(counts[:300], np.ones(mixing.DIMENSIONS))
    tracemalloc.start()
    try:
        sums = topics.sums(counts)
        assert tracemalloc.get_traced_memory()[1] < 2 * counts.nbytes
    finally:
        tracemalloc.stop()
    x = topics.vectors(counts)
    own, fixed = (x @ topics.centroids.T).argmax(axis=1), np.rint(x * mixing.FIXED).astype(np.int64)
    assert (sums == np.stack([fixed[own == j].sum(axis=0) for j in range(len(topics.centroids))])).all()
