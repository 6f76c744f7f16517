"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits are grouped so that correlated ones stand together. For m groups, thresholds t_i (-1: a
group that isn't looked at) with a sum of distance - m + 1 lose no pair within the distance.
Group count and thresholds are chosen by dynamic programming over estimated costs: keys
probed, and candidates that share a key. Fingerprints are probed by group key, and every
candidate is verified with all 64 bits. Within a key only a spanning forest of the links is
kept, so a large group of near copies costs edges in proportion to its size.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import CHUNK_BYTES, HOT_SHARE, NOT_SPACE, TO_LOWER, arrow_groups, arrow_map, drawn, pieces, split_join, stash, text_buffer, whole, word_bounds

SEED = 42
#: Fingerprints (drawn by hash) from which costs are estimated, and pairs drawn of them.
SAMPLE, PAIRS = 20_000, 400_000
#: Nanoseconds of one probed key (a shuffled row) and of one verified candidate.
PROBE_NS, VERIFY_NS = 500.0, 2.0
#: Rows of a bucket of keys, and rows of one key beyond which it is dealt out as block pairs.
BUCKET_ROWS, HEAVY = 250_000, 100_000
#: Within a key of up to so many rows all pairs are compared at once.
SMALL = 48


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Signed 64-bit fingerprints of lower-cased texts."""
    starts, ends, firsts = word_bounds(data, offsets, NOT_SPACE)
    sizes = np.diff(firsts)
    out = np.zeros(len(sizes), np.int64)
    if not len(starts):
        return out
    # words joined by one space: keep words and the first byte after each
    keep = NOT_SPACE[data]
    gap = ends[ends < len(data)]
    gap = gap[~NOT_SPACE[data[gap]]]
    joined = data.copy()
    joined[gap] = 0x20
    keep[gap] = True
    place = np.cumsum(keep) - 1
    text, begin = joined[keep].tobytes(), place[starts]
    finish = begin + (ends - starts)
    word = np.arange(len(starts))
    last = np.repeat(firsts[1:], sizes)
    at = np.flatnonzero((word + shingle <= last) | ((word == np.repeat(firsts[:-1], sizes)) & (np.repeat(sizes, sizes) < shingle)))
    to = np.minimum(at + shingle, last[at]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(begin[at], finish[to])), np.uint64, len(at))
    full = np.flatnonzero(sizes > 0)
    own = np.searchsorted(at, firsts[:-1][full])
    counts = np.diff(np.append(own, len(at)))
    # a byte of the hashes at a time: sums of bits work on copies of eight bytes each
    ones = [np.add.reduceat(np.unpackbits((h >> np.uint64(s)).astype(np.uint8)[:, None], axis=1), own, axis=0, dtype=np.int64) for s in range(56, -8, -8)]
    set_ = (2 * np.concatenate(ones, axis=1) > counts[:, None]).astype(np.uint8)
    out[full] = np.packbits(set_, axis=1).view(">u8").reshape(-1).astype(np.uint64).view(np.int64)
    return out


def simhash(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (long) of every whole text; without words it is zero."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                data, offsets = text_buffer(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints_of(TO_LOWER[data], offsets, shingle))], ["doc_id", "fp"])

    return arrow_map(docs.select("doc_id", whole()), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def grouped_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m groups of near-equal size, each grown by the bit that correlates most."""
    spread = bits.std(axis=0)
    x = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    near = np.abs(x.T @ x) / max(1, len(bits))
    near[:, spread == 0] = near[spread == 0, :] = 1.0
    left, groups = list(range(64)), []
    for i in range(m):
        group = [left.pop(0)]
        while len(group) < 64 * (i + 1) // m - 64 * i // m:
            best = max(left, key=lambda b: (near[b, group].mean(), -b))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def plan(sample: np.ndarray, total: int, distance: int) -> list[tuple[list[int], int]]:
    """Groups of bits and their thresholds, of least estimated cost."""
    bits = np.unpackbits(sample.view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float64)
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, max(1, len(sample)), (2, PAIRS))
    apart = (sample[a] ^ sample[b])[a != b].view(np.uint64)
    best = (np.inf, [])
    for m in range(1, distance + 2):
        groups, budget = grouped_bits(bits, m), distance - m + 1
        cost = []
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            d = np.bitwise_count(apart & mask)
            row = [0.0]
            for t in range(distance + 1):
                keys = sum(comb(len(g), k) for k in range(t + 1))
                share = max((d <= t).mean() if len(d) else 0.0, keys / 2.0 ** len(g))
                row.append(total * keys * PROBE_NS + float(total) ** 2 / 2 * share * VERIFY_NS)
            cost.append(row)
        # least cost of the first i groups with thresholds of a given sum
        table = {0: (0.0, ())}
        for row in cost:
            after: dict[int, tuple[float, tuple]] = {}
            for s, (c, ts) in table.items():
                for t in range(-1, distance + 1):
                    if (s + t not in after) or c + row[t + 1] < after[s + t][0]:
                        after[s + t] = (c + row[t + 1], (*ts, t))
            table = after
        c, ts = table.get(budget, (np.inf, ()))
        if c < best[0]:
            best = (c, [(g, t) for g, t in zip(groups, ts) if t >= 0])
    return best[1]


def probes(fps: DataFrame, groups: list[tuple[list[int], int]]) -> DataFrame:
    """part, key and fp: each fingerprint under every key that its thresholds reach."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = [(i, signed(sum(1 << b for b in bits)), signed(sum(1 << b for b in g))) for i, (g, t) in enumerate(groups) for k in range(t + 1) for bits in combinations(g, k)]
    part, flip, mask = (np.array(x, kind) for x, kind in zip(zip(*keys), (np.int32, np.int64, np.int64)))
    # all keys by one scan: a branch for each group would make the driver plan as many
    asked = fps.select("fp", F.posexplode(F.lit(flip)).alias("i", "flip"))
    return asked.select(F.get(F.lit(part), F.col("i")).alias("part"), F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.get(F.lit(mask), F.col("i"))).alias("key"), "fp")


def forest(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, int]]:
    """Links that connect what is connected within the distance: (members, root) each."""
    links, left = [], np.sort(fps)
    while len(left):
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            near = np.bitwise_count((left ^ todo.pop()).view(np.uint64)) <= distance
            if near.any():
                links.append((left[near], root))
                todo.extend(left[near])
                left = left[~near]
    return links


def links_of(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal keys; as forests in long runs."""
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(cut, len(keys)))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    short = np.repeat(sizes <= SMALL, sizes)
    k, f = keys[short], fps[short]
    for step in range(1, int(min(SMALL, sizes.max(initial=1)))):
        at = np.flatnonzero(k[step:] == k[:-step])
        if not len(at):
            break
        at = at[np.bitwise_count((f[at + step] ^ f[at]).view(np.uint64)) <= distance]
        a.append(f[at])
        b.append(f[at + step])
    for i in np.flatnonzero(sizes > SMALL):
        for members, root in forest(fps[cut[i] : cut[i] + sizes[i]], distance):
            a.append(members)
            b.append(np.full(len(members), root))
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame, distance: int) -> DataFrame:
    """u < v: enough links between different fingerprints to connect all within the distance."""
    spark, total = fps.sparkSession, fps.count()
    sample = np.sort(drawn(fps, SAMPLE, "fp").toPandas()["fp"].to_numpy(np.int64)) if total > 1 else np.zeros(1, np.int64)
    groups = plan(sample, max(1, total), distance)
    rows = probes(fps, groups).withColumn("block", F.lit(0).cast("long"))
    keys = sum(sum(comb(len(g), k) for k in range(t + 1)) for g, t in groups)
    heavy = stash(spark, rows.groupBy("part", "key").count().filter(F.col("count") > HEAVY), "heavy")
    if not heavy.isEmpty():
        # a heavy key's rows are cut in k blocks; every pair of blocks is a key of its own
        k = F.ceil(F.col("count") * 2 / HEAVY)
        own = F.pmod(F.xxhash64("fp"), k)
        pair = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.least(j, own) * k + F.greatest(j, own) + 1)
        dealt = rows.drop("block").join(heavy, ["part", "key"]).withColumn("block", F.explode(F.array_distinct(pair))).drop("count")
        rows = rows.join(heavy.drop("count"), ["part", "key"], "left_anti").unionByName(dealt)
    buckets = max(24, -(-total * keys // BUCKET_ROWS))
    rows = rows.select(F.pmod(F.xxhash64("part", "key", "block"), F.lit(buckets)).alias("bucket"), F.xxhash64("part", "key", "block").alias("run"), "fp")

    def run(table: pa.Table) -> pa.Table:
        a, b = links_of(table.column("run").to_numpy(), table.column("fp").to_numpy(), distance)
        return pa.table({"u": np.minimum(a, b), "v": np.maximum(a, b)})

    return arrow_groups(rows, "bucket", run, "u long, v long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node) of every node of the edges (u < v), by turns of
    linking larger and smaller neighbours to the smallest; each round is written."""
    spark = edges.sparkSession

    def star(edges: DataFrame, large: bool) -> DataFrame:
        around = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = around if large else edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = around.join(least, "u")
        if large:
            moved = moved.filter("v > u").select(F.col("m").alias("u"), "v")
        else:
            moved = moved.select(F.col("m").alias("u"), "v").unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
        return moved.filter("u <> v").distinct()

    def mark(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30)))).first()

    edges = stash(spark, edges, "links")
    before = mark(edges)
    while before[0]:
        # the first turn is written too: the second reads it three times, and would plan it as often
        edges = stash(spark, star(stash(spark, star(edges, True), "links"), False), "links")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def simhash_dedup(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Texts are lower-cased (A-Z), cut in words at space and the controls from tab to carriage
    return, and hashed by runs of ``shingle`` words, repeats included (a shorter text is one
    run; one without words, or null, has fingerprint zero and is linked like any other).
    Fingerprints link at ``distance`` or fewer differing bits; component_id is the smallest
    doc_id that links reach (null doc_ids don't count; null if there is no other). doc_id may be
    of any type that has an order. Repeated rows get the same values. Only doc_id and text are
    read. Empty tables give empty results.
    """
    spark = docs.sparkSession
    marked = stash(spark, simhash(docs, shingle), "simhash", batch_bytes=2 * CHUNK_BYTES)
    fps = stash(spark, marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")), "fingerprints")
    total = fps.agg(F.sum("rows")).first()[0] or 0
    roots = connected(links(fps.select("fp"), distance))
    nodes = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "rows", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stash(spark, nodes.join(least, "root").select("fp", "rows", "component_id"), "components")
    return split_join(marked, named, "fp", F.col("rows") > max(1, total * HOT_SHARE)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
