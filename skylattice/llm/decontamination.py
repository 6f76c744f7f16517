"""Benchmark decontamination with a distributed positional inverted index.

Test texts are cut in windows of consecutive words. The training texts are indexed in shards
of whole documents: for every test term the positions where it stands, stored as a table. A
window is looked up in a shard by its terms from the rarest to the most frequent there: the
positions of the rarest, less its offset, are the first candidates, and each further term's
list, adjusted by its own offset, cuts them down. What is left is an exact phrase, or with a
slop a proximity match.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import LOWER_WORD, TO_LOWER, arrow_map, span_hashes, stash, text_buffer, whole, word_bounds

#: Words in the test windows of one block. A block's windows go to the tasks as a broadcast
#: (some 40 MB at most); more windows are looked up block by block over a kept copy of the texts.
BLOCK_WORDS = 2_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Text bytes of a shard; a longer text is one of its own.
PACK_BYTES = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def packed(batches):
    """Batches of doc_id and text as one-row batches of chunk, doc_ids, texts."""
    ids, texts, size, kind = [], [], 0, None

    def close():
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(kind)), pa.array([texts], pa.list_(pa.string()))], ["chunk", "doc_ids", "texts"])

    for batch in batches:
        kind = batch.column("doc_id").type
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= PACK_BYTES:
                yield close()
                ids, texts, size = [], [], 0
    if ids:
        yield close()


def pack(docs: DataFrame) -> DataFrame:
    """Chunks of whole texts: chunk, doc_ids, texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", whole()), packed, f"chunk string, doc_ids array<{kind}>, texts array<string>")


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """Each different window (array of words) and the items that hold it."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(WORD), 0)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1))), lambda i: F.slice("words", i, window))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words")).filter(F.size("words") > 0)
    return items.select("item", F.explode(cut).alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))


class Windows:
    """The test windows of one block as arrays."""

    def __init__(self, rows):
        width = max((len(r["window"]) for r in rows), default=1)
        vocabulary = sorted({w for r in rows for w in r["window"]})
        raw = [w.encode() for w in vocabulary]
        ends = np.cumsum([len(w) for w in raw]).astype(np.int64)
        hashes = span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], ends[:-1])).astype(np.int64), ends)
        order = np.argsort(hashes)
        self.vocabulary = hashes[order]
        number = {vocabulary[j]: i for i, j in enumerate(order)}
        self.sizes = np.array([len(r["window"]) for r in rows], np.int64)
        self.terms = np.full((len(rows), width), -1, np.int64)
        for i, r in enumerate(rows):
            self.terms[i, : len(r["window"])] = [number[w] for w in r["window"]]
        self.items = [sorted(r["items"]) for r in rows]


def index_texts(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each text (total last); term number and position of every test term,
    by term and then by position."""
    lower = TO_LOWER[data]
    starts, ends, firsts = word_bounds(lower, offsets, LOWER_WORD)
    hashes = span_hashes(lower, starts, ends)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    found = np.flatnonzero(vocabulary[at] == hashes)
    order = np.argsort(at[found], kind="stable")
    return firsts, at[found][order], found[order]


def build_index(docs: DataFrame, windows) -> DataFrame:
    """The index of texts (or of packed ones): a row for each shard with its texts' first words,
    and its terms with the ends of their lists in the joined positions."""
    ready = "texts" in docs.columns
    kind = docs.schema["doc_ids"].dataType.simpleString() if ready else f"array<{docs.schema['doc_id'].dataType.simpleString()}>"

    def run(batches):
        vocabulary = windows.value.vocabulary
        for batch in batches if ready else packed(batches):
            for row in range(batch.num_rows):
                firsts, terms, places = index_texts(*text_buffer(batch.column("texts").slice(row, 1).flatten()), vocabulary)
                unique, begin = np.unique(terms, return_index=True)
                ends = np.append(begin[1:], len(terms))[: len(unique)]
                blobs = [firsts.astype(np.int64), unique.astype(np.uint32), ends.astype(np.uint32), places.astype(np.uint32)]
                yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(row, 1), batch.column("doc_ids").slice(row, 1), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], ["shard", "doc_ids", "firsts", "terms", "ends", "positions"])

    return arrow_map(docs if ready else docs.select("doc_id", whole()), run, f"shard string, doc_ids {kind}, firsts binary, terms binary, ends binary, positions binary")


#: Candidate places that are looked at in one step.
CANDIDATES = 1 << 20


def find(windows: Windows, firsts: np.ndarray, terms: np.ndarray, places: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches in a shard: window number, first position, end."""
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(windows.sizes):
        return none, none, none
    span = int(firsts[-1]) + 4 * (windows.terms.shape[1] + slop)
    keys = terms * span + places  # sorted
    lengths = np.bincount(terms, minlength=len(windows.vocabulary))
    frequency = np.where(windows.terms >= 0, lengths[windows.terms], np.iinfo(np.int64).max)
    live = np.flatnonzero(frequency.min(axis=1) > 0)
    rarest = np.argsort(frequency[live], axis=1, kind="stable")
    begin = np.concatenate(([0], np.cumsum(lengths)))
    first = windows.terms[live, rarest[:, 0]]
    many = lengths[first]
    total, parts = np.cumsum(many), [(none, none, none)]
    for a in range(0, int(many.sum()), CANDIDATES):
        # places a to b of the joined lists of all windows' rarest terms
        at = np.arange(a, min(a + CANDIDATES, int(total[-1])))
        which = np.searchsorted(total, at, "right")
        parts.append(_matched(windows, live, rarest, which, places[begin[first[which]] + at - (total[which] - many[which])], keys, span, firsts, slop))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _matched(windows: Windows, live, rarest, which, low, keys, span: int, firsts, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places of windows' rarest terms, those where the other terms' lists agree."""
    high, start = low, low - rarest[which, 0]
    for r in range(1, windows.terms.shape[1]):
        offset = rarest[which, r]
        asked = offset < windows.sizes[live[which]]
        wanted = start + offset
        key = windows.terms[live[which], offset] * span
        found = np.searchsorted(keys, key + np.maximum(wanted - slop, 0))
        got = keys[np.minimum(found, len(keys) - 1)] - key
        good = ~asked | ((found < len(keys)) & (got >= 0) & (got <= wanted + slop))
        low = np.where(asked, np.minimum(low, got), low)[good]
        high = np.where(asked, np.maximum(high, got), high)[good]
        which, start = which[good], start[good]
    inside = np.searchsorted(firsts, low, "right") == np.searchsorted(firsts, high, "right")
    if slop == 0:
        inside &= start >= 0
    return live[which][inside], low[inside], high[inside] + 1


def query_index(index: DataFrame, windows, slop: int) -> DataFrame:
    """Per document: its number of words, the spans of matches (disjoint) and their items."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        test = windows.value
        for batch in batches:
            for row in range(batch.num_rows):
                firsts, terms, ends, places = (np.frombuffer(batch.column(c)[row].as_py(), t).astype(np.int64) for c, t in (("firsts", np.int64), ("terms", np.uint32), ("ends", np.uint32), ("positions", np.uint32)))
                terms = np.repeat(terms, np.diff(ends, prepend=0))
                which, low, high = find(test, firsts, terms, places, slop)
                owner = np.searchsorted(firsts, low, "right") - 1
                spans: list[list] = [[] for _ in range(len(firsts) - 1)]
                items: list[set] = [set() for _ in range(len(firsts) - 1)]
                for i in np.argsort(low, kind="stable").tolist():
                    d = int(owner[i])
                    a, b = int(low[i] - firsts[d]), int(high[i] - firsts[d])
                    items[d].update(test.items[which[i]])
                    if spans[d] and a <= spans[d][-1]["end"]:
                        spans[d][-1]["end"] = max(b, spans[d][-1]["end"])
                    else:
                        spans[d].append({"start": a, "end": b})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("shard")[row].as_py()] * len(spans), pa.string()), pa.array(range(len(spans)), pa.int32()), batch.column("doc_ids").slice(row, 1).flatten(), pa.array(np.diff(firsts), pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    ["shard", "place", "doc_id", "n_words", "spans", "items"],
                )

    return arrow_map(index, run, f"shard string, place int, doc_id {kind}, n_words long, spans array<struct<start: long, end: long>>, items array<string>")


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and spans of every
    document.

    Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII characters. A window
    is ``window`` consecutive words of a test item, or all words of a shorter one. A word
    inside any occurrence of a window is hit; a document with hits on a twentieth of its words
    or more is contaminated. With ``slop`` each term may stand that many words off its place,
    and a match spans from its first word to its last. Null and empty texts have no words,
    items without words no windows; a null item_id counts as an empty string. Repeated rows
    are judged each. Other columns don't matter. Terms count as equal when their 64-bit hashes
    are. Without test items nothing is hit; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tests = stash(spark, windows_of(benchmark, window), "test-windows")
    blocks = -(-(tests.agg(F.sum(F.size("window"))).first()[0] or 1) // BLOCK_WORDS)
    texts = docs.select("doc_id", "text") if blocks == 1 else stash(spark, pack(docs), "chunks")
    found = None
    for block in range(blocks):
        rows = tests.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect()  # BLOCK_WORDS words, about
        windows = spark.sparkContext.broadcast(Windows(rows or [{"window": [" "], "items": []}]))
        part = query_index(stash(spark, build_index(texts, windows), "postings"), windows, slop)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    length = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["end"]).alias("to")),
        lambda acc: acc["n"],
    )
    items = F.array_sort(F.array_distinct("items"))
    judged = found.select("doc_id", "n_words", length.alias("n_hit"), items.alias("items"), "spans")
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "spans")
