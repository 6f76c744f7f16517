"""What the text operators share: the shared folder, written intermediate tables, and
vectorised word hashing over Arrow text buffers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that one vectorised step holds; a single longer text is a step of its own.
CHUNK_BYTES = 2 << 20


#: Folders made in the shared one, in order; see scratch.
_MADE: list[str] = []
#: A join key is hot with more than this share of all rows: so there are at most 10,000 of them.
HOT_SHARE = 1e-4
#: Bits of one bitmap (of the built-in function), bitmaps at most (32 MB in all), and bits a key.
BITMAP, BITMAPS, KEY_BITS = 1 << 15, 1 << 13, 16


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one on a local master;
    a cluster must name one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder, also of a store that only Hadoop's file systems reach."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the intermediate tables made within, when it ends; the list it gives has paths to
    keep."""
    kept: list[str] = []
    first = len(_MADE)
    try:
        yield kept
    finally:
        for path in _MADE[first:]:
            if path not in kept:
                discard(spark, path)
        _MADE[first:] = kept


def stash(spark: SparkSession, df: DataFrame, name: str, path: str | None = None, batch_bytes: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: the lineage ends there,
    and the shuffle files of the writing job are released with it. Its Python functions are
    given Arrow batches of up to ``batch_bytes``, where that is named."""
    path = path or fresh_path(spark, name)
    settings = {CLEANUP: "true"} | ({} if batch_bytes is None else {BATCH_SETTING: str(batch_bytes)})
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def split_join(left: DataFrame, right: DataFrame, key: str, hot: Column) -> DataFrame:
    """left and right joined on ``key``, which is never null and stands once in right. The rows
    of right that are ``hot`` (see HOT_SHARE; at most 10,000) are broadcast, so the rows of left
    with a hot key aren't shuffled to one task."""
    few = F.broadcast(right.filter(hot))
    return left.join(few, key).unionByName(left.join(few.select(key), key, "left_anti").join(right.filter(~hot), key))


def flagged(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: false where ``key`` surely isn't among ``keys`` (one
    column). A bitmap of hashed keys is broadcast; it has KEY_BITS bits a key, up to 32 MB,
    beyond which more keys are flagged without being there."""
    places = BITMAP * min(BITMAPS, max(1, -(-keys.count() * KEY_BITS // BITMAP)))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(places)) + 1
    own = keys.select(place(F.col(keys.columns[0])).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(f"{name} bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    # as whole numbers of eight bytes, which a join doesn't copy for each row
    word = lambda i: F.conv(F.hex(F.substring("bits", 8 * i + 1, F.lit(8))), 16, -10).cast("long")
    own = own.select(f"{name} bucket", F.transform(F.sequence(F.lit(0), F.lit(BITMAP // 64 - 1)), word).alias(f"{name} words"))
    at = df.withColumn(f"{name} place", place(key)).withColumn(f"{name} bucket", F.bitmap_bucket_number(f"{name} place")).withColumn(f"{name} place", F.bitmap_bit_position(f"{name} place").cast("int"))
    is_set = F.expr(f"getbit(`{name} words`[int(`{name} place` div 64)], int(56 - (`{name} place` div 8) % 8 * 8 + `{name} place` % 8)) = 1")
    return at.join(F.broadcast(own), f"{name} bucket", "left").withColumn(name, F.coalesce(is_set, F.lit(False))).drop(f"{name} bucket", f"{name} words", f"{name} place")


def without(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` (never null) isn't in ``gone`` (one column). Only rows that a
    bitmap flags are shuffled."""
    name = gone.columns[0]
    marked = flagged(df.withColumn(name, key), F.col(name), gone, f"maybe {name}")
    flag = F.col(f"maybe {name}")
    return marked.filter(~flag).unionByName(marked.filter(flag).join(gone, name, "left_anti")).select(df.columns)


#: Settings of the tasks' Python processes, which are reused: large arrays go back to the system
#: when they are freed, instead of staying with the process.
WORKERS = {"MALLOC_MMAP_THRESHOLD_": "16777216", "MALLOC_TRIM_THRESHOLD_": "33554432", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system", "OPENBLAS_NUM_THREADS": "1"}


def _importable(df: DataFrame) -> None:
    env = df.sparkSession.sparkContext.environment
    env.update(WORKERS)
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow whose workers can import this package."""
    _importable(df)
    return df.mapInArrow(fn, schema)


def arrow_groups(df: DataFrame, key: str, fn: Callable, schema: str) -> DataFrame:
    """groupBy(key).applyInArrow(fn) whose workers can import this package."""
    _importable(df)
    return df.groupBy(key).applyInArrow(fn, schema)


def arrow_cogroups(left: DataFrame, right: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """Both frames grouped by ``keys``, each pair of groups given to fn(left, right) as tables."""
    _importable(left)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fn, schema)


def whole(text: str = "text"):
    """The text column, null as empty."""
    return F.coalesce(F.col(text), F.lit("")).alias(text)


def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that have a column row, a struct with the text, with its text (null as empty) beside
    it: so the text is sent once."""
    for batch in batches:
        text = pc.fill_null(pc.struct_field(batch.column("row"), "text"), "")
        yield batch.append_column("text", text)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without nulls, and the offsets of its texts in them."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def drawn(df: DataFrame, size: int, *columns: str) -> DataFrame:
    """About ``size`` rows of ``df`` (all of fewer), chosen by the hash of ``columns`` among all of
    them; the share is set by a count, so tasks send no more rows than are wanted."""
    rows = df.count()
    if rows <= size:
        return df
    place = F.pmod(F.xxhash64(F.lit(size), *columns), F.lit(1 << 40)) / float(1 << 40)
    return df.filter(place < size / rows).limit(2 * size)


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes of text and up to ``rows`` texts, one at
    least."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to


_SEED = np.random.default_rng(20240229)
_MIX = {kind: _SEED.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for kind in ("byte", "other")}
_BASE = {"byte": 0x9E3779B97F4A7C15 | 1, "word": 0xD1342543DE82EF95 | 1, "other": 0xA24BAED4963EE407 | 1}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k < n."""
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = _BASE[kind]
        both = []
        for b in (base, pow(base, -1, 2**64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        have = _POWERS[kind] = (both[0], both[1])
        if size > 1 << 23:
            _POWERS.pop(kind)
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """Finishing mix of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes in the table ``is_word``, within a text), and
    for each text the index of its first word, with the total last."""
    m = is_word[data]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(m)
    after = np.empty_like(m)
    if len(m):
        before[0] = after[-1] = False
        before[1:] = m[:-1]
        after[:-1] = m[1:]
        before[cut] = False
        after[cut - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str = "byte") -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); kinds are independent of each other."""
    up, down = _powers(kind, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_MIX[kind][data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def gram_hashes(words: np.ndarray, n: int, kind: str = "word") -> np.ndarray:
    """64-bit hashes of all runs of n word hashes; run i starts at word i."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(kind, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[n:] - sums[:k]) * down[:k])


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is true for the bytes of these closed ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Everything but space and the controls from tab to carriage return.
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Digits, lower-case letters and all non-ASCII bytes.
LOWER_WORD = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: A-Z to a-z, other bytes unchanged.
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[0x41:0x5B] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
