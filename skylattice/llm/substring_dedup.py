"""Substring deduplication by fixed-block anchors.

Documents are packed into chunks of whole texts. The words at every block-th position of a
document start a reference block; two equal windows of 2 * block - 1 words always hold one
aligned block of either side at the same place. So: (1) index the hashes of the aligned
blocks, probe them with the hash of every rolling window of a block's length; (2) extend
each hit to the windows around it and keep those whose hash occurs twice; runs of them are
the maximal exact repeats. Hashes equal within a chunk are sent once, and hash space is
dealt into buckets whose number follows the input, so no key gathers more than a bounded
part of the corpus.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import CHUNK_BYTES, NOT_SPACE, arrow_cogroups, arrow_groups, arrow_map, gram_hashes, pieces, span_hashes, stash, text_buffer, whole, word_bounds

#: Text bytes of a chunk (a longer text is a chunk of its own) and of a bucket's share.
PACK_BYTES, BUCKET_BYTES = 1 << 20, 12 << 20


def packed(batches):
    """Batches of doc_id and text with each text's chunk, and the place of its first word there."""
    chunk, size, words = uuid.uuid4().hex, 0, 0
    for batch in batches:
        for part in pieces(batch):
            data, offsets = text_buffer(part.column("text"))
            chunks, firsts = [], []
            for many, n in zip(np.diff(offsets).tolist(), np.diff(word_bounds(data, offsets, NOT_SPACE)[2]).tolist()):
                if size >= PACK_BYTES:
                    chunk, size, words = uuid.uuid4().hex, 0, 0
                chunks.append(chunk)
                firsts.append(words)
                size, words = size + many, words + n
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.string()), pa.array(firsts, pa.int64()), part.column("doc_id"), part.column("text")], ["chunk", "first", "doc_id", "text"])


def pack(docs: DataFrame) -> DataFrame:
    """Chunks of whole texts, a row for each text: chunk, first, doc_id, text. The rows stay as
    small as the documents are, so neither Spark's nor a task's copies of them are large."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", whole()), packed, f"chunk string, first long, doc_id {kind}, text string")


def runs(batches):
    """Chunks of consecutive rows: chunk, the place of the first word, texts. What one task reads of a
    chunk comes at once; a chunk that two tasks read comes in two parts, whose places are its own."""

    def joined(held):
        rows = pa.Table.from_batches(held)
        return rows.column("chunk")[0].as_py(), rows.column("first")[0].as_py(), rows.column("text").combine_chunks()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        chunks = batch.column("chunk").to_pylist()
        cut = [i for i in range(len(chunks)) if i == 0 or chunks[i] != chunks[i - 1]]
        for a, b in zip(cut, [*cut[1:], len(chunks)]):
            if held and held[-1].column("chunk")[0].as_py() != chunks[a]:
                yield joined(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield joined(held)


class Chunk:
    """The words of a chunk's texts, and their hashes."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = text_buffer(texts)
        self.starts, self.ends, self.firsts = word_bounds(self.data, offsets, NOT_SPACE)
        self.words = span_hashes(self.data, self.starts, self.ends)

    def windows(self, n: int, kind: str = "word") -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words, and which of them lie within one text."""
        hashes = gram_hashes(self.words if kind == "word" else self.others(), n, kind)
        sizes = np.diff(self.firsts)
        last = np.repeat(self.firsts[1:], sizes)[: len(hashes)]
        return hashes, np.arange(len(hashes)) + n <= last

    def wide(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """As windows(), of 128 bits."""
        one, inside = self.windows(n)
        out = np.empty(len(one), WIDE)
        out["one"], out["two"] = one, self.windows(n, "other")[0]
        return out, inside

    def others(self) -> np.ndarray:
        """Second hashes of the words, which don't depend on the first."""
        return span_hashes(self.data, self.starts, self.ends, "other")

    def aligned(self, block: int, count: int) -> np.ndarray:
        return (np.arange(count) - np.repeat(self.firsts[:-1], np.diff(self.firsts))[:count]) % block == 0


#: A window's hashes, 128 bits together.
WIDE = np.dtype([("one", np.uint64), ("two", np.uint64)])


def same(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group number of each hash (of 64 or 128 bits), the first place of each group, and the
    groups' sizes."""
    if hashes.dtype == WIDE:
        order = np.lexsort((hashes["two"], hashes["one"]))
        ordered = hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = (ordered["one"][1:] != ordered["one"][:-1]) | (ordered["two"][1:] != ordered["two"][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return group, order[new], np.bincount(group, minlength=int(new.sum()))
    _, first, group, sizes = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    return group, first, sizes


def dealt(chunk: str, at: np.ndarray, hashes: np.ndarray, flags: np.ndarray, buckets: int, hash_type) -> pa.RecordBatch:
    """One row for each bucket: the entries it gets, as steps between places (two bytes where
    they fit), hashes as hash_type, and flags as bits."""
    bucket = ((hashes["one"] if hashes.dtype == WIDE else hashes) >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, at, hashes, flags = bucket[order], at[order], hashes[order].astype(hash_type), flags[order]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))[: len(bucket)])
    to = np.append(cut[1:], len(bucket))
    steps = [np.diff(at[a:b], prepend=0) for a, b in zip(cut, to)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cut].astype(np.int32)),
            pa.array([chunk] * len(cut), pa.string()),
            pa.array([s.astype(np.uint16 if s.max() < 1 << 16 else np.uint32).tobytes() for s in steps], pa.binary()),
            pa.array([hashes[a:b].tobytes() for a, b in zip(cut, to)], pa.binary()),
            pa.array([np.packbits(flags[a:b]).tobytes() for a, b in zip(cut, to)], pa.binary()),
        ],
        ["bucket", "chunk", "places", "hashes", "flags"],
    )


DEALT = "bucket int, chunk string, places binary, hashes binary, flags binary"
REPLY = "chunk string, places binary"


def gathered(rows: pa.Table, hash_type) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's chunks, and for each entry: the chunk's number, place, hash and flag."""
    hashes = [np.frombuffer(x, hash_type) for x in rows.column("hashes").to_pylist()]
    sizes = [len(h) for h in hashes]
    places = [np.cumsum(np.frombuffer(x, np.uint16 if len(x) == 2 * n else np.uint32), dtype=np.uint32) for x, n in zip(rows.column("places").to_pylist(), sizes)]
    flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows.column("flags").to_pylist(), sizes)]
    return rows.column("chunk").to_pylist(), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.concatenate(places), np.concatenate(hashes), np.concatenate(flags)


def replies(chunks: list[str], owner: np.ndarray, places: np.ndarray, hit: np.ndarray) -> pa.Table:
    found = np.flatnonzero(hit)
    cut = np.flatnonzero(np.concatenate(([True], owner[found][1:] != owner[found][:-1]))) if len(found) else found
    to = np.append(cut[1:], len(found)).astype(int)
    return pa.table({"chunk": pa.array([chunks[owner[found[a]]] for a in cut], pa.string()), "places": pa.array([places[found[a:b]].tobytes() for a, b in zip(cut, to)], pa.binary())})


def probes(chunks: DataFrame, block: int, buckets: int) -> DataFrame:
    """Every rolling window of block words, aligned blocks flagged as index entries. Equal
    ones of a chunk are sent once, with 32 bits of their hash besides the bucket."""

    def run(batches):
        for chunk, begin, texts in runs(batches):
            c = Chunk(texts)
            hashes, inside = c.windows(block)
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            group, first, sizes = same(hashes[at])
            held = np.bincount(group, c.aligned(block, len(hashes))[at], len(first)) > 0
            # in-chunk twins are found again in anchored(); others learn of them here
            order = np.argsort(first)
            first, held = at[first[order]], held[order]
            yield dealt(chunk, begin + first, hashes[first], held, buckets, np.uint32)

    return arrow_map(chunks.select("chunk", "first", "text"), run, DEALT)


def match_anchors(rows: pa.Table) -> pa.Table:
    """Entries whose hash is an index block of another chunk."""
    chunks, owner, places, hashes, flags = gathered(rows, np.uint32)
    blocks = hashes[flags > 0]
    order = np.sort(blocks)
    others = np.searchsorted(order, hashes, "right") - np.searchsorted(order, hashes, "left") - (flags > 0)
    return replies(chunks, owner, places, others > 0)


def match_windows(rows: pa.Table) -> pa.Table:
    """Entries whose hash another chunk has too."""
    chunks, owner, places, hashes, _ = gathered(rows, WIDE)
    group, _, sizes = same(hashes)
    return replies(chunks, owner, places, sizes[group] > 1)


def with_replies(chunks: DataFrame, found: DataFrame, fn, schema: str) -> DataFrame:
    """fn for each chunk: of its rows, in their order, and the places found for it."""

    def run(rows: pa.Table, replied: pa.Table) -> pa.Table:
        places = np.frombuffer(b"".join(replied.column("places").to_pylist()), np.uint32).astype(np.int64)
        return fn(rows.sort_by("first"), places)

    return arrow_cogroups(chunks, found, ["chunk"], run, schema)


def texts_of(rows: pa.Table) -> pa.Array:
    return rows.column("text").combine_chunks()


def twins(hashes: np.ndarray, at: np.ndarray, seeds: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Which of the windows ``at`` share a hash with a seed place, or (own: which entries the
    chunk's index holds) repeat within the chunk."""
    group, first, sizes = same(hashes[at])
    hit = np.zeros(len(first), bool)
    hit[group[np.searchsorted(at, seeds)]] = True
    hit |= (sizes > 1) if own is None else (sizes > 1) & (np.bincount(group, own, len(first)) > 0)
    return hit[group]


def anchored(chunks: DataFrame, hits: DataFrame, block: int, window: int, buckets: int) -> DataFrame:
    """Windows around the hits of a chunk, equal ones once."""

    def found(c: Chunk, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64), np.zeros(0, WIDE)
        hashes, inside = c.windows(block)
        at = np.flatnonzero(inside)
        if not len(at):
            return none
        hit = np.zeros(len(hashes) + 1, np.int64)
        hit[at[twins(hashes, at, places, c.aligned(block, len(hashes))[at])]] = 1
        wide, inside = c.wide(window)
        if not len(wide):
            return none
        sums = np.concatenate(([0], np.cumsum(hit)))
        start = np.arange(len(wide))
        at = np.flatnonzero(inside & (sums[np.minimum(start + window - block + 1, len(hit))] > sums[start]))
        if not len(at):
            return none
        first = at[np.sort(same(wide[at])[1])]
        return first, wide[first]

    def run(rows: pa.Table, places: np.ndarray) -> pa.Table:
        first, wide = found(Chunk(texts_of(rows)), places)
        return pa.Table.from_batches([dealt(rows.column("chunk")[0].as_py(), first, wide, np.zeros(len(first), bool), buckets, WIDE)])

    return with_replies(chunks.select("chunk", "first", "text"), hits, run, DEALT)


def removal(chunks: DataFrame, repeats: DataFrame, window: int, kind: str) -> DataFrame:
    """Per document the words that no repeated window covers."""

    def run(rows: pa.Table, places: np.ndarray) -> pa.Table:
        c = Chunk(texts_of(rows))
        wide, inside = c.wide(window)
        covered = np.zeros(len(c.words) + 1, np.int64)
        at = np.flatnonzero(inside)
        if len(at):
            start = at[twins(wide, at, places)]
            np.add.at(covered, start, 1)
            np.add.at(covered, start + window, -1)
        keep = np.cumsum(covered)[:-1] == 0
        kept = np.concatenate(([0], np.cumsum(keep)))[c.firsts]
        raw, sizes = c.data.tobytes(), np.diff(c.firsts)
        texts = []
        for a, b in zip(c.firsts[:-1], c.firsts[1:]):
            own = np.flatnonzero(keep[a:b]) + a
            texts.append(b" ".join([raw[i:j] for i, j in zip(c.starts[own].tolist(), c.ends[own].tolist())]))
        return pa.table(
            [rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sizes - np.diff(kept), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([t.decode() for t in texts], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )

    return with_replies(chunks, repeats, run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def substring_dedup(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every document: words covered
    by a run of ``window`` words (odd) that also starts anywhere else are removed; the rest is
    joined by one space. Words are runs without space and the controls from tab to carriage
    return; null and empty texts have none. Windows are judged on the input.

    Windows count as equal when two 64-bit hashes of theirs are, which don't depend on each other:
    of 10^15 windows (100 TB) a wrong pair is found with a chance of some 10^-9. Ties don't arise: every place of a
    repeated window is removed, in repeated rows too. Only doc_id and text are read. An empty
    table gives an empty result.
    """
    if window % 2 == 0 or window < 3:
        raise ValueError("window must be odd and at least 3")
    spark, block, kind = docs.sparkSession, (window + 1) // 2, docs.schema["doc_id"].dataType.simpleString()
    chunks = stash(spark, pack(docs), "chunks", batch_bytes=2 * CHUNK_BYTES)
    size = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, -(-size // BUCKET_BYTES))
    dealt_out = lambda rows: rows.repartition(buckets, "bucket")  # noqa: E731 (partitions follow the input)
    hits = stash(spark, arrow_groups(dealt_out(probes(chunks, block, buckets)), "bucket", match_anchors, REPLY), "anchors", batch_bytes=2 * CHUNK_BYTES)
    repeats = stash(spark, arrow_groups(dealt_out(anchored(chunks, hits, block, window, buckets)), "bucket", match_windows, REPLY), "windows", batch_bytes=2 * CHUNK_BYTES)
    return removal(chunks, repeats, window, kind)
