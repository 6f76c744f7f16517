"""Merkle manifest of a dataset by fractal traversal.

Rows become leaves, each source a tree of 16 children a node, and the trees' roots one more
tree. A tree is cut into aligned blocks of 16**3 nodes; a task holds one block at a time. Roots
of blocks are the nodes that the next round cuts into blocks, until one is left. Then, from the
top down, each block is walked once: a fractal traversal emits the authentication path of every
node in it, to which the path of the block's own root is appended.

The traversal keeps, for each level of a block, the existing subtree (the children of the node
above the current one) and the desired one that follows it, grown by one leaf a step. So a walk
holds 2 * 16 digests a level beside unfinished runs, whatever lies below.

Places in a source are found without a task for the source: rows are dealt by ranges of
(source, doc_id, leaf), and the sizes of the parts give each part its first place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.common import arrow_cogroups, arrow_groups, stash
from skylattice.llm.exact_dedup import located

#: Children of a node, levels of a block, and so its nodes.
ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def joined(digests: Sequence[bytes]) -> bytes:
    """The digest, as hex text, of digests that are hex texts."""
    return hashlib.sha256(b"".join(digests)).hexdigest().encode()


def levels(total: int) -> int:
    """Levels above the nodes of a tree of ``total`` nodes; runs are joined while there are
    several."""
    n = 0
    while total > 1:
        total = -(-total // ARITY)
        n += 1
    return n


class Growing:
    """Nodes of one level made from leaves that come one by one (a treehash): runs are joined as
    soon as they are full; ``finish`` joins what is left, runs of one node too."""

    def __init__(self, level: int):
        self.runs: list[list[bytes]] = [[] for _ in range(level + 1)]

    def add(self, leaf: bytes) -> None:
        self.runs[0].append(leaf)
        for k in range(len(self.runs) - 1):
            if len(self.runs[k]) < ARITY:
                break
            self.runs[k + 1].append(joined(self.runs[k]))
            self.runs[k] = []

    def finish(self) -> list[bytes]:
        """The level's nodes."""
        for k in range(len(self.runs) - 1):
            if self.runs[k]:
                self.runs[k + 1].append(joined(self.runs[k]))
                self.runs[k] = []
        return self.runs[-1]


class Traversal:
    """Authentication paths of the leaves of a block of ``height`` levels, in order. Iterating
    gives for each leaf its level's (siblings before, siblings after) from below."""

    def __init__(self, leaves: Sequence[bytes], height: int):
        self.leaves, self.height = leaves, height

    def _first(self) -> tuple[list[list[bytes]], bytes]:
        """For each level the subtree above the first leaf, and the block's root."""
        grown = [Growing(k) for k in range(self.height)]
        for k, g in enumerate(grown):
            for i in range(min(len(self.leaves), ARITY ** (k + 1))):
                g.add(self.leaves[i])
        subtrees = [g.finish() for g in grown]
        return subtrees, joined(subtrees[-1]) if subtrees else self.leaves[0]

    def root(self) -> bytes:
        return self._first()[1]

    def __iter__(self) -> Iterator[list[tuple[list[bytes], list[bytes]]]]:
        existing, _ = self._first()
        desired = [Growing(k) for k in range(self.height)]
        for i in range(len(self.leaves)):
            path = []
            for k in range(self.height):
                width = ARITY**k
                if i and i % (width * ARITY) == 0:
                    # the subtree is used up; the desired one takes its place
                    existing[k], desired[k] = desired[k].finish(), Growing(k)
                at = i // width % ARITY
                path.append((existing[k][:at], existing[k][at + 1 :]))
                ahead = i + width * ARITY
                if ahead < len(self.leaves):
                    desired[k].add(self.leaves[ahead])
            yield path


def folded(leaf: bytes, before: Sequence[bytes], after: Sequence[bytes]) -> bytes:
    """The root that a leaf and its siblings, level by level, give."""
    for a, b in zip(before, after):
        leaf = hashlib.sha256(a + leaf + b).hexdigest().encode()
    return leaf


def field(value: Column) -> Column:
    """A value as a leaf has it: its UTF-8 bytes after their count and a colon; null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def lowered_fifth() -> tuple[Column, Column]:
    """Tampering: texts of rows whose crc32(doc_id) is divisible by 5 lose their capitals."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", UPPER, LOWER)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``pos``, the place in their tree by ``order``, and ``total``, the tree's rows."""
    dealt = stash(rows.sparkSession, rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), "merkle-dealt")
    tree = Window.partitionBy("tree")
    sizes = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select("tree", "part", (F.sum("size").over(tree.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(tree).alias("total"))
    own = dealt.withColumn("pos", F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1)
    return own.join(sizes, ["tree", "part"]).withColumn("pos", F.col("pos") + F.col("before")).drop("part", "before")


def _block(table: pa.Table) -> tuple[np.ndarray, list[bytes], int]:
    """Order of a block's rows by place, their digests as hex text in that order, its height."""
    order = np.argsort(table.column("pos").to_numpy())
    digests = table.column("digest").take(pa.array(order)).to_pylist()
    return order, [d.hex().encode() for d in digests], min(LEVELS, levels(table.column("total")[0].as_py()))


def _roots(blocks: DataFrame) -> DataFrame:
    """Roots of blocks as the nodes of the next round: tree, pos, total, digest."""

    def run(table: pa.Table) -> pa.Table:
        _, leaves, height = _block(table)
        total = -(-table.column("total")[0].as_py() // BLOCK)
        root = bytes.fromhex(Traversal(leaves, height).root().decode())
        return pa.table([table.column("tree").slice(0, 1), table.column("block").slice(0, 1), pa.array([total]), pa.array([root])], ["tree", "pos", "total", "digest"])

    return arrow_groups(blocks, ["tree", "block"], run, "tree string, pos long, total long, digest binary")


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes and, round by round, the roots of their blocks, until each tree has one."""
    found = [nodes]
    while (found[-1].agg(F.max("total")).first()[0] or 0) > 1:
        blocks = _in_blocks(found[-1].select("tree", "pos", "total", "digest"))
        found.append(stash(nodes.sparkSession, _roots(blocks), "merkle-round"))
    return found


#: What is known of a node's path: its siblings on both sides for each level, joined, from below,
#: and the root of its own tree.
PATH = "before array<binary>, after array<binary>, top binary"


def _ends(roots: DataFrame) -> DataFrame:
    """The path of each tree's root, which is empty."""
    none = F.array().cast("array<binary>")
    return roots.select("tree", "pos", none.alias("before"), none.alias("after"), F.col("digest").alias("top"))


def _walked(nodes: DataFrame, above: DataFrame, columns: str, emit: Callable) -> DataFrame:
    """What ``emit`` makes of the blocks of ``nodes``: it gets the block's rows in order, their
    digests, their paths (pairs of siblings before and after, by level, joined), and the row
    ``above`` that has the path of the block's root."""

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        order, leaves, height = _block(table)
        paths = ([(b"".join(a), b"".join(b)) for a, b in path] for path in Traversal(leaves, height))
        return emit(table.take(pa.array(order)), leaves, paths, upper.to_pylist()[0])

    return arrow_cogroups(_in_blocks(nodes), above.withColumnRenamed("pos", "block"), ["tree", "block"], run, columns)


def _down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of the first round's nodes, from those of the last one's."""

    def emit(table, leaves, paths, up):
        both = [list(zip(*path)) or [(), ()] for path in paths]
        sides = [pa.array([[*pair[side], *up[name]] for pair in both], pa.list_(pa.binary())) for side, name in ((0, "before"), (1, "after"))]
        return pa.table([table.column("tree"), table.column("pos"), *sides, pa.array([up["top"]] * len(both), pa.binary())], ["tree", "pos", "before", "after", "top"])

    for nodes in reversed(rounds[:-1]):
        above = stash(nodes.sparkSession, _walked(nodes.select("tree", "pos", "total", "digest"), above, f"tree string, pos long, {PATH}", emit), "merkle-paths")
    return above


def merkle_manifest(docs: DataFrame, tampered: tuple[Column, Column] | None = None, proofs: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; with
    ``proofs`` also before and after, the siblings on both sides for each level, joined.

    A leaf is the SHA-256 of doc_id, source, lang, n_chars and text, nulls as ``-``. Leaves of a
    source ascend by doc_id (nulls first), then by leaf; so rows with one id are told apart, and
    rows that repeat altogether have places of their own beside each other. A null source is a
    source, the first. ``tampered`` is a condition and a text: where it holds, the
    root is folded from the leaf with that text. An empty table gives an empty result; texts are
    whole; columns other than the five aren't read.
    """
    spark = docs.sparkSession
    docs, place = located(docs, *FIELDS)
    values = [F.col(c) for c in FIELDS]
    digest = lambda parts: F.unhex(F.sha2(F.concat(*[field(v) for v in parts]), 256))
    when, text = tampered or (F.lit(False), F.col("text"))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("tree"),
        "doc_id",
        digest(values).alias("digest"),
        F.when(when, digest([*values[:-1], text])).alias("tampered"),
        F.xxhash64(place).alias("tie"),
    )
    # dealing by ranges reads its rows twice: they are digests by then, not texts
    leaves = stash(spark, leaves, "merkle-hashed")
    nodes = stash(spark, _placed(leaves, ["doc_id", "digest", "tie"]).drop("tie"), "merkle-leaves")
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", before array<binary>, after array<binary>" if proofs else "")
    if nodes.isEmpty():
        return spark.createDataFrame([], columns)
    rounds = _rounds(nodes)
    # the sources' roots are the leaves of one more tree
    sources = stash(spark, _placed(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]), "merkle-sources")
    upper = _rounds(sources)
    root = bytes(upper[-1].first()["digest"]).hex()
    found = _down(upper, _ends(upper[-1])).join(sources.select("pos", "name", "digest"), "pos")
    found = found.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "before", "after", F.col("digest").alias("top"))
    above = _down(rounds[1:] or rounds, found)

    def emit(table, digests, paths, up):
        subroot = up["top"].hex()
        above = b"".join(a + b for a, b in zip(up["before"], up["after"]))
        out = {"proof_sha256": [], "folded_root": [], "before": [], "after": []}
        for digest, other, path in zip(digests, table.column("tampered").to_pylist(), paths):
            out["proof_sha256"].append(hashlib.sha256(b"".join(a + b for a, b in path) + above).hexdigest())
            before, after = [*(a for a, _ in path), *up["before"]], [*(b for _, b in path), *up["after"]]
            out["folded_root"].append(folded(other.hex().encode() if other is not None else digest, before, after).decode())
            if proofs:
                out["before"].append(before)
                out["after"].append(after)
        n = len(digests)
        made = {"doc_id": table.column("doc_id"), "leaf": [d.decode() for d in digests], "subroot": [subroot] * len(digests), "root": [root] * len(digests), "proof_sha256": out["proof_sha256"], "folded_root": out["folded_root"], "verified": [f == root for f in out["folded_root"]]}
        if proofs:
            made |= {name: pa.array(out[name], pa.list_(pa.binary())) for name in ("before", "after")}
        return pa.table(made)

    return _walked(nodes, above, columns, emit)


def oracle(height: int = 5) -> str:
    """DuckDB SQL for the query's rows, for sources (and as many sources) of up to 16**height."""

    def tree(leaves: str, name: str, key: str) -> tuple[list[str], str]:
        """Node tables name0 (tree, pos, total, d) to name<height>, with siblings, for ``leaves``."""
        made = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS total FROM {leaves})"]
        for k in range(height):
            side = f"OVER (PARTITION BY {key}, pos // {ARITY} ORDER BY pos ROWS BETWEEN"
            # a tree of one node is done: it goes on as it is, and has no siblings there
            made.append(f"{name}s{k} AS (SELECT {key}, pos, total, d, coalesce(string_agg(d, '') {side} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(d, '') {side} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name}{k})")
            made.append(f"{name}{k + 1} AS (SELECT {key}, pos // {ARITY} AS pos, any_value((total + {ARITY - 1}) // {ARITY}) AS total, CASE WHEN any_value(total) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {name}{k} GROUP BY {key}, pos // {ARITY})")
        return made, f"{name}{height}"

    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    whole = lambda text: "sha256(" + " || ".join([*(part(c) for c in FIELDS[:-1]), part(text)]) + ")"
    leaves = [
        f"f AS (SELECT doc_id, coalesce('s' || source, 'n') AS tree, {whole('text')} AS d, {whole('low')} AS lowered FROM (SELECT *, translate(text, '{UPPER}', '{LOWER}') AS low FROM documents))",
        "l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM f)",
    ]
    below, last = tree("l", "n", "tree")
    middle = [f"r AS (SELECT 0 AS one, tree, d, row_number() OVER (ORDER BY tree) - 1 AS pos FROM {last})"]
    above, top = tree("r", "u", "one")
    # a row's siblings level by level: in its own source's tree, then among the sources
    joins, levels_of = [], []
    for k in range(height):
        levels_of.append((f"a{k}", f"n.pos // {ARITY**k}", f"ns{k}", f"a{k}.tree = n.tree"))
    for k in range(height):
        levels_of.append((f"b{k}", f"r.pos // {ARITY**k}", f"us{k}", "true"))
    for alias, at, source, same in levels_of:
        joins.append(f"JOIN {source} {alias} ON {same} AND {alias}.pos = {at}")
    proof = " || ".join(f"{x}.a || {x}.b" for x, *_ in levels_of)
    steps = [f"w0 AS (SELECT n.*, r.d AS subroot, {proof} AS proof, {', '.join(f'{x}.a AS {x}a, {x}.b AS {x}b, {x}.total AS {x}t' for x, *_ in levels_of)} FROM n0 n JOIN r ON r.tree = n.tree {' '.join(joins)})"]
    folds = ["x0 AS (SELECT *, CASE WHEN crc % 5 = 0 THEN lowered ELSE d END AS v0 FROM (SELECT w0.*, c.crc FROM w0 JOIN crcs c USING (tree, pos)))"]
    for k, (x, *_) in enumerate(levels_of):
        folds.append(f"x{k + 1} AS (SELECT *, CASE WHEN {x}t = 1 THEN v{k} ELSE sha256({x}a || v{k} || {x}b) END AS v{k + 1} FROM x{k})")
    # crc32 of the decimal id (reflected polynomial 0xEDB88320), by a table of its 256 steps
    crc = ["z0 AS (SELECT range AS i, range AS v FROM range(256))"]
    crc += [f"z{k + 1} AS (SELECT i, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) AS v FROM z{k})" for k in range(8)]
    crc.append("crcs AS (SELECT tree, pos, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, steps[(xor(a, x) & 255) + 1])), 4294967295) AS crc FROM l, (SELECT list(v ORDER BY i) AS steps FROM z8))")
    ctes = ", ".join([*leaves, *below, *middle, *above, *crc, *steps, *folds])
    return f"WITH {ctes} SELECT doc_id, d AS leaf, subroot, (SELECT d FROM {top}) AS root, sha256(proof) AS proof_sha256, v{len(levels_of)} AS folded_root, v{len(levels_of)} = (SELECT d FROM {top}) AS verified FROM x{len(levels_of)}"

