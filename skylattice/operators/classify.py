"""Raw navaid records to planner navaids and exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.canonical import canonical_json
from skylattice.functions.text import non_blank, sha256_tag
from skylattice.schema import DEFAULT_RANGE_NM, FAMILY_BY_TYPE, REASONS
from skylattice.tables import settled, spread


def _kind(value: Column) -> Column:
    """STRING, DECIMAL, ... of a JSON value; VOID for null; null where the key is missing."""
    return F.regexp_extract(F.schema_of_variant(value), r"\A[A-Z]+", 0)


_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "TINYINT", "SMALLINT", "INT")


def json_text(v: Column, path: str) -> Column:
    """A JSON string without white space at its ends; null for others and for blank ones."""
    part = F.try_variant_get(v, path, "variant")
    return F.when(_kind(part) == "STRING", non_blank(F.try_variant_get(v, path, "string")))


def json_number(v: Column, path: str) -> Column:
    part = F.try_variant_get(v, path, "variant")
    return F.when(_kind(part).isin(*_NUMBERS), F.try_variant_get(v, path, "double"))


def identified(raw: DataFrame) -> DataFrame:
    """source_record_id, canonical_record and checksum of raw records (column ``record``: JSON).

    The id is the record's _id; without one it is made of the content's checksum and an ordinal
    among records of the same content. Records that aren't JSON get no canonical form.
    """
    canon = spread(raw).select(canonical_json("record").alias("canonical_record")).withColumn("checksum", sha256_tag(F.col("canonical_record")))
    canon = settled(canon.select("*", json_text(F.try_parse_json("canonical_record"), "$._id").alias("given"), F.spark_partition_id().alias("part")))
    # records of one content are numbered within their partition, after those of partitions before
    # it; they are the same to the byte, so any order does
    open_ = canon.filter("given is null")
    counts = open_.groupBy("checksum", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("checksum").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("checksum", "part", before.alias("before"))
    numbered = open_.join(offsets.withColumnRenamed("checksum", "content"), F.col("checksum").eqNullSafe(F.col("content")) & (open_["part"] == offsets["part"]))
    ordinal = F.col("before") + F.row_number().over(Window.partitionBy("checksum", open_["part"]).orderBy("before"))
    made = numbered.select(F.concat(F.lit("generated:"), "checksum", F.lit(":"), ordinal.cast("string")).alias("source_record_id"), "canonical_record", "checksum", F.lit(False).alias("has_own_id"))
    return canon.filter("given is not null").select(F.col("given").alias("source_record_id"), "canonical_record", "checksum", F.lit(True).alias("has_own_id")).unionByName(made)


def duplicate_ids(records: DataFrame) -> DataFrame:
    """Own ids that stand more than once; any of them fails the whole batch."""
    return records.filter("has_own_id").groupBy("source_record_id").count().filter("count > 1")


def classified(records: DataFrame, id_prefix: str = "source:") -> DataFrame:
    """Planner columns of every identified record, and ``reason`` (the first that excludes it, in
    the order of REASONS, or null)."""
    # parsed once: a column that others use several times isn't copied into each of them
    records, v = records.withColumn("v", F.try_parse_json("canonical_record")), F.col("v")
    families = F.create_map(*[F.lit(x) for kv in FAMILY_BY_TYPE.items() for x in (float(kv[0]), kv[1])])
    family = families[json_number(v, "$.type")]
    size = F.size(F.try_variant_get(v, "$.geometry.coordinates", "array<variant>"))
    lon, lat = json_number(v, "$.geometry.coordinates[0]"), json_number(v, "$.geometry.coordinates[1]")
    placed = (json_text(v, "$.geometry.type") == "Point") & (size == 2) & lon.between(-180, 180) & lat.between(-90, 90)
    ndb = F.col("family") == "NDB"
    written = F.when(_kind(F.try_variant_get(v, "$.frequency.value", "variant")) == "STRING", F.try_variant_get(v, "$.frequency.value", "string"))
    frequency = F.when(written.rlike(r"\A\d{3}\.\d{3}\z") & (json_number(v, "$.frequency.unit") == F.when(ndb, 1.0).otherwise(2.0)), written.cast("double"))
    range_kind = _kind(F.try_variant_get(v, "$.range", "variant"))
    given_range = F.when(json_number(v, "$.range.unit") == 2, json_number(v, "$.range.value"))
    reach = F.when(range_kind.isNull(), F.lit(DEFAULT_RANGE_NM)).otherwise(given_range)
    rows = records.select(
        "source_record_id", family.alias("family"), F.when(placed, lon).alias("longitude"), F.when(placed, lat).alias("latitude"), json_text(v, "$.identifier").alias("identifier"), json_text(v, "$.name").alias("own_name"),
        "v", reach.alias("published_range_nm"), "canonical_record",
    ).withColumn("frequency_value", frequency)
    checks = (F.coalesce("source_record_id", F.lit("")) == "", F.col("family").isNull(), F.col("longitude").isNull() | F.col("latitude").isNull(), F.col("identifier").isNull(), ~F.coalesce(F.col("frequency_value") > 0, F.lit(False)), ~F.coalesce(F.col("published_range_nm") > 0, F.lit(False)))
    reason = F.coalesce(*[F.when(c, r) for c, r in zip(checks, REASONS)])
    return rows.select(
        "source_record_id", F.concat(F.lit(id_prefix), "source_record_id").alias("database_id"), "identifier", F.coalesce("own_name", "identifier").alias("name"), "family", "longitude", "latitude",
        "frequency_value", F.when(ndb, "kHz").otherwise("MHz").alias("frequency_unit"), "published_range_nm", F.try_variant_get("v", "$.country", "string").alias("country"), reason.alias("reason"),
    )


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Planner navaids, and exclusions (source_record_id, reason)."""
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").select("source_record_id", "reason")


def exclusion_counts(rows: DataFrame) -> DataFrame:
    return rows.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
