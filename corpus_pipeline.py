"""A training-data pipeline: five stages over the documents table.

Each stage works on all that the one before kept, and returns the columns of documents; the
last adds what mixing decided. A stage's result is written to the shared folder and read back.
All stages take nulls in any column, repeated rows and ids, empty texts and tables, and further
columns of any name; what becomes of them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import discard, fresh_path, scratch, stash, table, without
from skylattice.llm.decontamination import decontamination
from skylattice.llm.exact_dedup import first_copies, located
from skylattice.llm.language_id import language_id
from skylattice.llm.mixing import mixing
from skylattice.llm.simhash_dedup import simhash_dedup


#: Words of a shingle and differing bits in the stage of near duplicates. By fingerprints of two
#: words, documents with 0.8 of their five-word shingles in common differ in few bits: within 6
#: are 80 % of such pairs (of four words within 4: 2 %), and no pair below 0.4.
NEAR_SHINGLE, NEAR_BITS = 2, 6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; what it rejects goes, and so do null texts
    and texts without letters. Rows are judged each; ids and other columns don't matter. If no
    document has a language, all are rejected."""
    return language_id(docs, carry=True).filter(~F.col("rejected")).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each normalised text, that of the smallest doc_id (null ids come last; of rows
    with one id the first in the table). Null counts as an empty text."""
    return first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, chosen as in ``exact``. Rows are told apart
    by their place in the table, so repeated ids don't matter. Texts without words are one group."""
    columns = docs.columns
    docs, place = located(docs)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), place.alias("place"))
    found = simhash_dedup(docs.select(row.alias("doc_id"), "text"), NEAR_SHINGLE, NEAR_BITS)
    gone = stash(spark, found.filter("doc_id <> component_id").select(F.col("doc_id.place").alias("place of near")), "near-copies")
    return without(docs, place, gone).select(columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark; null and empty texts are clean. What
    is judged is the text, so it is the texts' digests that go through the operator."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    found = decontamination(docs.select(digest.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = stash(spark, found.filter("contaminated").select(F.col("doc_id").alias("digest of the text")).distinct(), "contaminated")
    return without(docs, digest, gone)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by raked weights, with topic, words, probability and weight (in place of
    columns of these names). Null sources and languages are values of their own; texts without
    words aren't drawn; repeated rows share their fate."""
    added = ("topic", "n_tokens", "probability", "weight")
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return mixing(docs).filter("kept").select(*columns, *added)


STAGES = [("language", language), ("exact", exact), ("near", near), ("clean", clean), ("mixed", mixed)]

#: SQL can't train the language model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. What a stage has written is deleted once the next one's
    result is; only the last stage's own tables stay, which its result reads."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            keep.append(fresh_path(spark, f"stage-{name}"))
            docs = stash(spark, stage(spark, docs, sf_dir), f"stage-{name}", keep[0])
        if last is not None:
            discard(spark, last)
        last = keep[0]
    return STAGES[-1][1](spark, docs, sf_dir)
