"""Exact deduplication as a stateful stream.

A stream of (digest, identifier, content locator) is aggregated by digest in RocksDB state
that never expires: the state of a digest is its smallest identifier, that row's locator and
the number of rows so far. Where a digest is hit more than once, the full normalised bytes
of all its rows are compared; rows that share a digest but not their bytes are told apart by
the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from skylattice.llm.common import HOT_SHARE, flagged, fresh_path, split_join, stash, without

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The streaming query's settings: state on disk, one store per shuffle partition, without
#: the 4 MB that each store would set aside before it holds a row.
STREAMING = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: str = "text") -> Column:
    """The text with each run of space and control white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame, *columns: str) -> tuple[DataFrame, Column]:
    """The frame (its ``columns``, or all), and where each of its rows is: file and row of a
    Parquet scan. A frame that isn't one is written to the shared folder first."""
    try:
        place = docs.metadataColumn("_metadata")
    except AnalysisException:
        docs = stash(docs.sparkSession, docs.select(*columns) if columns else docs, "located")
        place = docs.metadataColumn("_metadata")
    return docs, F.concat_ws("#", place["file_path"], F.lpad(place["row_index"].cast("string"), 12, "0"))


def stream_state(stream: DataFrame) -> DataFrame:
    """The keyed state: per digest the first row by (null id last, id, locator) and the rows
    seen. Partial aggregation comes before the shuffle, so a hot digest costs a row a task."""
    return stream.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("first"), F.count(F.lit(1)).alias("group_size"))


def run_stream(spark: SparkSession, source: str, schema, files_per_batch: int, sink: str, checkpoint: str) -> DataFrame:
    """Runs the stream over the files of ``source`` until none is left and returns the last
    state of each digest. Called again with the same checkpoint it goes on where it stopped,
    with the state that it had."""
    kept = {k: spark.conf.get(k, None) for k in STREAMING}
    for k, v in STREAMING.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

        def put(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{sink}/batch={batch:08d}")

        query = stream_state(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema("digest binary, first struct<no_id: boolean, doc_id: %s, locator: string>, group_size long" % schema["doc_id"].dataType.simpleString()).parquet(f"{sink}/batch=*")
    return changes.groupBy("digest").agg(F.min("first").alias("first"), F.max("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, batches: int = 2, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and locator of every row, dropped ones too.

    Texts are equal when identical after white space is normalised; null counts as empty. Of
    equal texts the row with the smallest doc_id stays (a null doc_id only where all are
    null; of rows with the same doc_id the first by content locator). Only doc_id and text
    are read, so other columns don't matter. An empty table gives an empty result.

    ``digest`` maps the normalised text to binary; whatever it is, groups are of equal bytes.
    """
    return _deduplicated(*located(docs, "doc_id", "text"), batches, digest)


def _deduplicated(docs: DataFrame, place: Column, batches: int = 2, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", place.alias("locator"))
    keyed = docs.withColumn("norm", normalised()).withColumn("digest", digest(F.col("norm")))
    arrivals = stash(spark, keyed.select("digest", "doc_id", "locator", F.sha2("norm", 256).alias("text_sha256")), "arrivals")
    files = arrivals.inputFiles()
    if not files:
        return _result(arrivals, stream_state(arrivals), 0)
    source = files[0].rpartition("/")[0]
    state = run_stream(spark, source, arrivals.schema, -(-len(files) // batches), fresh_path(spark, "dedup-state"), fresh_path(spark, "dedup-stream"))
    state = stash(spark, state, "digests")
    total = state.agg(F.sum("group_size")).first()[0] or 0

    # full bytes on hits: smallest and largest text of a digest agree only if all do. Texts that
    # surely weren't hit are left out before the shuffle; of the others a task sends two a digest
    hits = state.filter("group_size > 1").select("digest")
    maybe = flagged(keyed.select("digest", "norm"), F.col("digest"), hits, "hit").filter("hit")
    checked = maybe.groupBy("digest").agg((F.min("norm") != F.max("norm")).alias("differs"))
    clashes = stash(spark, checked.filter("differs").select("digest"), "clashes")
    if clashes.isEmpty():
        return _result(arrivals, state, total)
    # rows of a clashing digest are grouped by their bytes
    apart = keyed.join(clashes, "digest", "left_semi")
    apart = apart.select(F.concat("digest", F.unhex(F.sha2("norm", 512)), F.encode("norm", "UTF-8")).alias("digest"), "doc_id", "locator", F.sha2("norm", 256).alias("text_sha256"))
    rest = arrivals.join(clashes, "digest", "left_anti")
    return _result(rest, state, total).unionByName(_result(apart, stream_state(apart), total))


def _result(arrivals: DataFrame, state: DataFrame, total: int) -> DataFrame:
    both = split_join(arrivals, state.select("digest", "first", "group_size"), "digest", F.col("group_size") > max(1, total * HOT_SHARE))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("locator") == F.col("first.locator"))
    return both.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "locator")


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, all columns, whatever their names. A frame
    that isn't a plain Parquet scan is written to the shared folder first, to have locators."""
    columns = docs.columns
    docs, place = located(docs)
    gone = stash(docs.sparkSession, _deduplicated(docs, place).filter("not kept").select(F.col("locator").alias("locator of exact_dedup")), "later-copies")
    return without(docs, place, gone).select(columns)
