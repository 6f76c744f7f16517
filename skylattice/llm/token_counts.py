"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged array of symbols with segment numbers. In
each round every segment finds its lowest-ranked pair and merges all its occurrences (left
to right where they overlap); a segment without a known pair is done, and its surviving
symbols are its count. Counts of pre-tokens seen before are looked up.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import arrow_map, pieces, text_buffer, whole

#: Pre-tokens whose counts a worker remembers before it starts over.
REMEMBERED = 400_000
_NONE = np.iinfo(np.int64).max


class MergeTable:
    """Merge ranks of a byte-level BPE vocabulary as sorted arrays."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.width = np.int64(len(vocab) + len(spec["added_tokens"]) + 1)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.byte_ids = np.array([vocab[c] for c in _byte_letters()], np.int64)
        self.pattern = pattern
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        #: Open-addressing table over the pairs: slot -> index in ``keys``.
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        left = np.arange(len(keys))
        slot = self._slot(self.keys)
        while len(left):
            free = self.slots[slot[left]] < 0
            self.slots[slot[left[free]]] = left[free]
            left = left[self.slots[slot[left]] != left]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key in ``self.keys``, -1 where it isn't there."""
        slot = self._slot(keys)
        at = self.slots[slot]
        left = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            at[left] = self.slots[slot[left]]
            left = left[(at[left] >= 0) & (self.keys[at[left]] != keys[left])]
        return at


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


def count_symbols(words: list[bytes], table: MergeTable) -> np.ndarray:
    """How many symbols each non-empty byte string ends with."""
    lengths = np.array([len(w) for w in words], np.int64)
    counts = np.zeros(len(words), np.int64)
    ids = table.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    seg = np.repeat(np.arange(len(words)), lengths)
    while len(ids):
        first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        at = np.full(len(ids), -1, np.int64)
        within = np.flatnonzero(seg[1:] == seg[:-1])
        at[within] = table.find(ids[within] * table.width + ids[within + 1])
        rank = np.where(at >= 0, table.ranks[at], _NONE)
        best = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.append(first, len(ids)))
        over = best == _NONE
        counts[seg[first[over]]] = sizes[over]
        chosen = (rank == np.repeat(best, sizes)) & (rank != _NONE)
        # of overlapping occurrences (one symbol repeated) every second one merges
        start = chosen & ~np.concatenate(([False], chosen[:-1]))
        place = np.arange(len(ids))
        since = place - np.maximum.accumulate(np.where(start, place, 0))
        take = np.flatnonzero(chosen & (since % 2 == 0))
        ids[take] = table.made[at[take]]
        stay = np.repeat(~over, sizes)
        stay[take + 1] = False
        ids, seg = ids[stay], seg[stay]
    return counts


class Counter:
    """Counts tokens of texts; remembers pre-tokens."""

    def __init__(self, table: MergeTable):
        self.table, self.known = table, {}
        self.find = regex.compile(table.pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(table.special, key=len, reverse=True)))) if table.special else None

    def counts(self, texts: list[str]) -> list[int]:
        split, extra = [], []
        for t in texts:
            n = 0
            if self.special and self.special.search(t):
                parts = self.special.split(t)
                n = len(parts) - 1
                split.append([w for p in parts for w in self.find(p)])
            else:
                split.append(self.find(t))
            extra.append(n)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*split) - self.known.keys())
        if new:
            self.known.update(zip(new, count_symbols([w.encode() for w in new], self.table).tolist()))
        known = self.known.__getitem__
        return [n + sum(map(known, words)) for n, words in zip(extra, split)]


_COUNTERS: dict[tuple[str, str], Counter] = {}


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    ``tokenizer`` is the path of a byte-level BPE file on the driver; its merge table (about
    2 MB, fixed by the file) goes to the tasks as a broadcast. Null and empty texts have no
    tokens. Only doc_id and text are read, so other columns and their names don't matter;
    repeated rows are counted each. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(MergeTable(tokenizer, pattern))
    name = (tokenizer, pattern)

    def run(batches):
        counter = _COUNTERS.get(name) or _COUNTERS.setdefault(name, Counter(sent.value))
        for batch in batches:
            for part in pieces(batch):
                sizes = np.diff(text_buffer(part.column("text"))[1])
                counts = counter.counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = arrow_map(docs.select("doc_id", whole()), run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
