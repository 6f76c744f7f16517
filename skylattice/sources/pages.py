"""Captured pages of a list service: envelopes, drift checks, records, filters."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.functions import areas, geo
from skylattice.schema import AREAS, ENTITIES, FILTERS

ENVELOPE = ("items", "limit", "nextPage", "page", "totalCount", "totalPages")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """file and body of page files, one JSON envelope each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("body"))


def envelopes(pages: DataFrame) -> DataFrame:
    """Parsed envelopes: page, limit, totals, next_page, items; valid is false for what isn't JSON,
    has a key twice, or has missing or further keys. Columns other than body are kept."""
    v = F.try_parse_json("body")
    keys = F.array_sort(F.json_object_keys("body"))
    number = lambda k: F.try_variant_get("v", f"$.{k}", "long")
    rows = pages.withColumn("v", v).withColumn("keys", keys)
    required = F.array(*[F.lit(k) for k in ENVELOPE if k != "nextPage"])
    valid = F.col("v").isNotNull() & (F.size(F.array_except("keys", F.array(*map(F.lit, ENVELOPE)))) == 0) & (F.size(F.array_except(required, "keys")) == 0)
    items = F.try_variant_get("v", "$.items", "array<variant>")
    out = rows.select(*[c for c in pages.columns if c != "body"], F.coalesce(valid, F.lit(False)).alias("valid"), *[number(k).alias(a) for k, a in (("page", "page"), ("limit", "page_limit"), ("totalCount", "total_count"), ("totalPages", "total_pages"), ("nextPage", "next_page"))], items.alias("items"))
    return out.withColumn("valid", F.col("valid") & F.col("page").isNotNull() & F.col("page_limit").isNotNull() & F.col("total_count").isNotNull() & F.col("total_pages").isNotNull() & F.col("items").isNotNull())


def records(parsed: DataFrame, *by: str) -> DataFrame:
    """page, position and record (JSON) of all items of valid pages, with the columns ``by``."""
    return parsed.filter("valid").select(*by, "page", F.posexplode("items").alias("position", "item")).select(*by, "page", "position", F.to_json("item").alias("record"))


#: Flags of drift.
DRIFT = ("invalid_page", "totals_differ", "pages_missing", "wrong_size", "wrong_next", "ids_fall")


def drift(parsed: DataFrame, *by: str) -> DataFrame:
    """Flags (one row for each value of ``by``, such as the attempt), any of which says that the
    collection changed while it was read: an invalid page, totals that differ, a wrong number of
    pages, a page of a wrong size, a wrong next page, ids that don't rise."""
    last = F.col("page") == F.col("total_pages")
    due = F.when(last, F.col("total_count") - (F.col("total_pages") - 1) * F.col("page_limit")).otherwise(F.col("page_limit"))
    following = F.coalesce("next_page", F.lit(-1)) != F.when(last, -1).otherwise(F.col("page") + 1)
    any_ = lambda c, n: F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False)).alias(n)
    flags = parsed.groupBy(*by).agg(
        any_(~F.col("valid"), "invalid_page"),
        (F.count_distinct("total_count", "total_pages", "page_limit") > 1).alias("totals_differ"),
        F.coalesce((F.max("total_pages") != F.greatest(F.lit(1), F.ceil(F.max("total_count") / F.max("page_limit")))) | (F.count(F.lit(1)) != F.max("total_pages")) | (F.count_distinct("page") != F.count(F.lit(1))), F.lit(False)).alias("pages_missing"),
        any_(F.size("items") != due, "wrong_size"),
        any_(following, "wrong_next"),
    )
    ids = records(parsed, *by).select(*by, "page", "position", F.get_json_object("record", "$._id").alias("id"))
    # within a page by position; between pages by their first and last id
    w = Window.partitionBy(*by, "page").orderBy("position")
    within = ids.withColumn("before", F.lag("id").over(w)).groupBy(*by, "page").agg(F.bool_or(F.coalesce(F.col("id") <= F.col("before"), F.lit(False)) | F.col("id").isNull()).alias("falls"), F.min_by("id", "position").alias("first"), F.max_by("id", "position").alias("last"))
    after = within.select(*by, (F.col("page") - 1).alias("page"), F.col("first").alias("next_first"))
    falls = within.join(after, [*by, "page"], "left").groupBy(*by).agg(any_(F.col("falls") | (F.col("next_first") <= F.col("last")), "ids_fall"))
    if not by:
        return flags.join(falls, F.lit(True))
    return flags.join(falls, list(by), "left").withColumn("ids_fall", F.coalesce("ids_fall", F.lit(False)))


#: Attempts to read a collection before it counts as unstable.
ATTEMPTS = 3


def stable_attempt(flags: DataFrame) -> int:
    """The first of up to ATTEMPTS attempts (column attempt, from 1) without drift."""
    clean = flags.filter((F.col("attempt") <= ATTEMPTS) & ~F.greatest(*[F.col(f).cast("int") for f in DRIFT]).cast("boolean"))
    first = clean.agg(F.min("attempt")).first()[0]
    if first is None:
        raise ValueError(f"the collection changed in each of {ATTEMPTS} attempts to read it")
    return first


def typed(found: DataFrame, entity: str) -> DataFrame:
    """Records parsed by an entity's schema, beside the raw text; a country may be one or many."""
    many = F.coalesce(F.from_json(F.get_json_object("record", "$.country"), "array<string>"), F.when(F.get_json_object("record", "$.country").isNotNull(), F.array(F.get_json_object("record", "$.country"))))
    return found.select("record", F.from_json("record", ENTITIES[entity]).alias("r"), many.alias("countries"))


def selected(rows: DataFrame, entity: str, search: str | None = None, anywhere: bool = False, country: str | None = None, updated_after: str | None = None, within: tuple[float, float, float] | None = None, box: tuple[float, float, float, float] | None = None, ids: list[str] | None = None, fields: list[str] | None = None, sort: str | None = None, descending: bool = False, page: int | None = None, limit: int = 1000, **equal) -> DataFrame:
    """Filters of the list service over typed records (column ``r``) of an entity: names that
    begin with a text (or have it ``anywhere``), whatever the case; a country; a time of change;
    a point with a radius in metres (latitude, longitude, metres); a box (west, south, east,
    north; west > east crosses the antimeridian): points must lie within, areas share a point with
    the circle or box, and rows without a geometry don't fit; ids; the entity's own FILTERS (a value or a
    list of them); ``fields`` to keep; sorting (ties by id) and pages."""
    columns = rows.columns
    asked = {"search": search, "anywhere": anywhere, "country": country, "updated_after": updated_after, "within": within, "box": box, "ids": ids}
    rows = _with_places(rows, entity)
    rows = rows.filter(_fits(rows, entity, **asked, **equal)).select(columns)
    if sort is not None:
        key = F.col(f"r.{sort}")
        rows = rows.orderBy(key.desc() if descending else key.asc(), F.col("r._id"))
    if page is not None:
        rows = rows.offset((page - 1) * limit).limit(limit)
    return rows if fields is None else rows.select(*[F.col(f"r.{f}").alias(f) for f in fields])


def matched(rows: DataFrame, entity: str, asked: dict[str, dict]) -> DataFrame:
    """The rows that each of several filters finds, with its name (column ``filter``), in one pass:
    asked has what ``selected`` is given for each, without sorting, fields and pages."""
    columns, rows = rows.columns, _with_places(rows, entity)
    names = F.array_compact(F.array(*[F.when(_fits(rows, entity, **how), F.lit(name)) for name, how in asked.items()]))
    return rows.select(*columns, F.explode(names).alias("filter"))


def _with_places(rows: DataFrame, entity: str) -> DataFrame:
    """Rows with what filters of places need: edges of areas, else the point."""
    if entity in AREAS:
        return rows.withColumn("edges", areas.edges(F.col("r.geometry.coordinates"))) if "geometry" in rows.schema["r"].dataType.names else rows
    return rows.withColumn("at", F.struct(F.col("r.geometry.coordinates")[1].alias("lat"), F.col("r.geometry.coordinates")[0].alias("lon"))) if "geometry" in rows.schema["r"].dataType.names else rows


def _fits(rows: DataFrame, entity: str, search=None, anywhere=False, country=None, updated_after=None, within=None, box=None, ids=None, **equal) -> Column:
    """Whether a row fits a filter; null counts as no."""
    area, all_ = entity in AREAS, [F.lit(True)]
    if search is not None:
        text, name = F.lower(F.lit(search)), F.lower("r.name")
        all_.append(name.contains(text) if anywhere else name.startswith(text))
    if country is not None:
        all_.append(F.array_contains("countries", country))
    if updated_after is not None:
        all_.append(F.col("r.updatedAt") > updated_after)
    if within is not None:
        lat, lon, metres = within
        all_.append(areas.within_nm("edges", lat, lon, metres / 1852) if area else geo.haversine_nm("at.lat", "at.lon", f"{float(lat)!r}e0", f"{float(lon)!r}e0") * 1852 <= metres)
    if box is not None:
        west, south, east, north = box
        if area:
            all_.append(areas.meets_box(F.col("edges"), west, south, east, north))
        else:
            lat, lon = F.col("at.lat"), F.col("at.lon")
            all_.append((lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)) & lat.between(south, north))
    if ids is not None:
        all_.append(F.col("r._id").isin(*ids))
    all_ += [_equals(rows, FILTERS[entity][name], value) for name, value in equal.items()]
    return functools.reduce(lambda a, b: a & b, all_)


def _equals(rows: DataFrame, path: str, value) -> Column:
    values = value if isinstance(value, (list, tuple)) else [value]
    if rows.select(f"r.{path}").schema[0].dataType.typeName() == "array":
        return F.arrays_overlap(F.col(f"r.{path}"), F.array(*map(F.lit, values)))
    return F.col(f"r.{path}").isin(*values)
