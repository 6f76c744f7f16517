"""The engine's queries over the driver's tables, and DuckDB SQL for the same rows.

Every query covers its whole tables; navaids are of all orders, local and long requests of
all nations. Floats are rounded to 6 digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.functions.text import archive_date, cycle_date, cycle_id, icao, megahertz_to_hertz, sha256_tag, signed_variation
from skylattice.operators import classify, contract, facility, snapshot
from skylattice.plans import legs as leg_plans
from skylattice.plans import search
from skylattice.plans.derived import derived, with_views
from skylattice.schema import FAMILY_BY_TYPE, VOR_FAMILIES
from skylattice.tables import settled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FAMILY_CASE = "CASE t " + " ".join(f"WHEN {t} THEN '{f}'" for t, f in FAMILY_BY_TYPE.items()) + " END"
VOR_LIST = ", ".join(f"'{f}'" for f in VOR_FAMILIES)


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a query under its name, with the SQL for its rows."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = with_views(sql, *views) if views else sql
        return fn

    return put


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _resolved(spark, d, kind="local") -> DataFrame:
    return search.resolve_airports(derived(spark, d, f"{kind}_requests"), derived(spark, d, f"{kind}_airports"))


def _near(spark, d, kind="local", factor=1.5) -> DataFrame:
    return search.candidates(_resolved(spark, d, kind), derived(spark, d, "navaids"), factor)


def _vors(spark, d) -> DataFrame:
    return derived(spark, d, "navaids").filter(F.col("family").isin(*VOR_FAMILIES))


def best_single(near: DataFrame) -> DataFrame:
    """The best single VOR-family navaid of each request's candidates."""
    own = near.filter(F.col("family").isin(*VOR_FAMILIES) & (F.col("dep_nm") <= F.col("published_range_nm")) & (F.col("arr_nm") <= F.col("published_range_nm")))
    best = own.groupBy("request_id").agg(F.min(F.struct((F.col("dep_nm") + F.col("arr_nm")).alias("total_nm"), "identifier", "database_id")).alias("b"))
    return best.select("request_id", "b.identifier", "b.database_id", "b.total_nm")


DIRECT = geo.haversine_sql("a.latitude", "a.longitude", "b.latitude", "b.longitude")
DEP, ARR = geo.haversine_sql("r.dlat", "r.dlon", "n.latitude", "n.longitude"), geo.haversine_sql("r.alat", "r.alon", "n.latitude", "n.longitude")


def _res(kind: str) -> str:
    return f"res AS (SELECT request_id, a.icao AS dep, b.icao AS arr, a.latitude AS dlat, a.longitude AS dlon, b.latitude AS alat, b.longitude AS alon, a.magnetic_declination_deg_east AS ddecl, b.magnetic_declination_deg_east AS adecl, {DIRECT} AS direct FROM {kind}_requests q JOIN {kind}_airports a ON a.icao = q.departure JOIN {kind}_airports b ON b.icao = q.arrival)"


def _cand(kind: str) -> str:
    return f"WITH {_res(kind)}, cand AS (SELECT request_id, direct, database_id, identifier, family, published_range_nm AS reach, {DEP} AS dep_nm, {ARR} AS arr_nm FROM res r, navaids n WHERE {DEP} + {ARR} <= direct * 15e-1)"


EDGES = f"edges AS (SELECT a.database_id AS a, b.database_id AS b, {DIRECT} AS nm FROM navaids a JOIN navaids b ON a.database_id < b.database_id AND abs(a.latitude - b.latitude) < 5 WHERE a.family IN ({VOR_LIST}) AND b.family IN ({VOR_LIST}) AND {DIRECT} <= a.published_range_nm + b.published_range_nm)"
LOCALS, LONGS = ("navaids", "local_airports", "local_requests"), ("navaids", "long_airports", "long_requests")


@query(f"{_cand('local')}, one AS (SELECT request_id, database_id, identifier, dep_nm + arr_nm AS total, row_number() OVER (PARTITION BY request_id ORDER BY dep_nm + arr_nm, identifier, database_id) AS k FROM cand WHERE family IN ({VOR_LIST}) AND dep_nm <= reach AND arr_nm <= reach) SELECT request_id, identifier, database_id, round(total, 6) AS total_nm FROM one WHERE k = 1", LOCALS)
def one_navaid_route(spark, d):
    """Best route over a single VOR-family navaid."""
    return rounded(best_single(_near(spark, d)))


@query("SELECT q.request_id, q.departure, q.arrival, CASE WHEN a.icao IS NULL OR b.icao IS NULL THEN 'not-found' ELSE 'resolved' END AS status FROM (SELECT * FROM local_requests UNION ALL SELECT concat('x', request_id), departure, concat(substr(arrival, 1, 3), '9') FROM local_requests UNION ALL SELECT concat('y', request_id), departure, concat('Z', substr(arrival, 2, 3)) FROM local_requests) q LEFT JOIN local_airports a ON a.icao = q.departure LEFT JOIN local_airports b ON b.icao = q.arrival", LOCALS)
def resolve_airports(spark, d):
    """Requests against airports: known ones, malformed codes, and unknown ones."""
    q = derived(spark, d, "local_requests")
    q = q.unionByName(q.select(F.concat(F.lit("x"), "request_id").alias("request_id"), "departure", F.concat(F.substring("arrival", 1, 3), F.lit("9")).alias("arrival"))).unionByName(q.select(F.concat(F.lit("y"), "request_id").alias("request_id"), "departure", F.concat(F.lit("Z"), F.substring("arrival", 2, 3)).alias("arrival")))
    found = search.resolve_airports(q, derived(spark, d, "local_airports")).select("request_id", F.when(F.col("status").isNull(), "resolved").otherwise("not-found").alias("status"))
    return q.join(found, "request_id").select("request_id", "departure", "arrival", "status")


@query(f"WITH {_res('long')} SELECT request_id, dep AS departure, arr AS arrival, round(direct, 6) AS direct_nm FROM res", LONGS)
def direct_distance(spark, d):
    return rounded(_resolved(spark, d, "long").select("request_id", F.col("departure_icao").alias("departure"), F.col("arrival_icao").alias("arrival"), "direct_nm"))


@query(f"WITH {_res('long')}, l AS (SELECT *, direct * 15e-1 AS lim FROM res), b AS (SELECT *, degrees(lim * 1852e0 / 6371000e0) AS ang, degrees(asin(least(1e0, sin(lim * 1852e0 / 6371000e0) / cos(radians(dlat))))) AS dw, degrees(asin(least(1e0, sin(lim * 1852e0 / 6371000e0) / cos(radians(alat))))) AS aw FROM l) SELECT request_id, count(*) AS n FROM b JOIN navaids n ON n.latitude BETWEEN dlat - ang AND dlat + ang AND n.latitude BETWEEN alat - ang AND alat + ang AND ((dlat + ang >= 90) OR n.longitude BETWEEN dlon - dw AND dlon + dw) AND ((alat + ang >= 90) OR n.longitude BETWEEN alon - aw AND alon + aw) GROUP BY request_id", LONGS)
def bbox_candidates(spark, d):
    """Navaids within the boxes around both endpoints, counted by request."""
    r = _resolved(spark, d, "long").select("request_id", (F.col("direct_nm") * 1.5).alias("lim"), *[F.col(f"{e}_airport.{c}").alias(f"{e}_{c}") for e in ("departure", "arrival") for c in ("latitude", "longitude")])
    for e in ("departure", "arrival"):
        r = r.withColumn(f"{e}_box", geo.bounds(F.col(f"{e}_latitude"), F.col(f"{e}_longitude"), F.col("lim")))
    both = F.array_intersect(geo.cells(F.col("departure_box"), 5.0), geo.cells(F.col("arrival_box"), 5.0))
    n = derived(spark, d, "navaids").select("latitude", "longitude", geo.cell(F.col("latitude"), F.col("longitude"), 5.0).alias("cell"))
    near = r.withColumn("cell", F.explode(both)).join(n, "cell")
    return near.filter(geo.in_bounds(F.col("departure_box"), F.col("latitude"), F.col("longitude")) & geo.in_bounds(F.col("arrival_box"), F.col("latitude"), F.col("longitude"))).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_cand('long')} SELECT request_id, database_id, family, round(dep_nm, 6) AS dep_nm, round(arr_nm, 6) AS arr_nm FROM cand", LONGS)
def endpoint_ellipse(spark, d):
    return rounded(_near(spark, d, "long").select("request_id", "database_id", "family", "dep_nm", "arr_nm"))


@query(f"{_cand('long')} SELECT request_id, count(*) FILTER (WHERE dep_nm + arr_nm <= direct * 11e-1) AS n_110, count(*) FILTER (WHERE dep_nm + arr_nm > direct * 11e-1 AND dep_nm + arr_nm <= direct * 125e-2) AS n_125, count(*) FILTER (WHERE dep_nm + arr_nm > direct * 125e-2) AS n_150 FROM cand WHERE family IN ({VOR_LIST}) GROUP BY request_id", LONGS)
def discovery_stage_counts(spark, d):
    """VOR-family candidates that each widening of the ellipse admits."""
    c = _near(spark, d, "long").filter(F.col("family").isin(*VOR_FAMILIES)).withColumn("factor", (F.col("dep_nm") + F.col("arr_nm")) / (F.col("limit_nm") / 1.5))
    stages = ((None, 1.1, "n_110"), (1.1, 1.25, "n_125"), (1.25, 1.5 + search.SLACK, "n_150"))
    return c.groupBy("request_id").agg(*[F.count_if(search.newly_admitted("factor", done, limit)).alias(name) for done, limit, name in stages])


@query(f"{_cand('local')} SELECT x.request_id, count(*) AS n_pairs, round(min({DIRECT}), 6) AS least_nm, round(max({DIRECT}), 6) AS most_nm FROM cand x JOIN cand y ON x.request_id = y.request_id AND x.database_id < y.database_id JOIN navaids a ON a.database_id = x.database_id JOIN navaids b ON b.database_id = y.database_id GROUP BY x.request_id", LOCALS)
def navaid_pairs(spark, d):
    """Distances of all pairs of a request's candidates, summed up."""
    c = _near(spark, d).select("request_id", "database_id").join(derived(spark, d, "navaids").select("database_id", "latitude", "longitude"), "database_id")
    a, b = (c.select("request_id", F.col("database_id").alias(f"id_{s}"), F.col("latitude").alias(f"lat_{s}"), F.col("longitude").alias(f"lon_{s}")) for s in "ab")
    p = a.join(b, "request_id").filter("id_a < id_b").withColumn("nm", geo.haversine_nm("lat_a", "lon_a", "lat_b", "lon_b"))
    return rounded(p.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.min("nm").alias("least_nm"), F.max("nm").alias("most_nm")))


@query(f"WITH {EDGES} SELECT a, b, round(nm, 6) AS nm FROM edges", ("navaids",))
def navigable_edges(spark, d):
    return rounded(search.navigable_edges(_vors(spark, d)))


@query(f"WITH {EDGES} SELECT id AS database_id, count(*) AS degree FROM (SELECT a AS id FROM edges UNION ALL SELECT b FROM edges) GROUP BY id", ("navaids",))
def degree_by_navaid(spark, d):
    return search.degrees(_vors(spark, d))


@query(f"{_cand('local')}, {EDGES}, steps AS (SELECT a, b, nm FROM edges UNION ALL SELECT b, a, nm FROM edges) SELECT x.request_id, round(min(x.dep_nm + nm + y.arr_nm), 6) AS total_nm FROM cand x JOIN steps e ON e.a = x.database_id JOIN cand y ON y.request_id = x.request_id AND y.database_id = e.b WHERE x.dep_nm <= x.reach AND y.arr_nm <= y.reach AND x.dep_nm + nm + y.arr_nm <= x.direct * 15e-1 GROUP BY x.request_id", LOCALS)
def two_navaid_route(spark, d):
    """Best route over exactly two VOR-family navaids."""
    # two navaids of one place are a pair as any other; the least total needs no third of a place,
    # and only pairs of candidates
    n = settled(search.widest(_vors(spark, d), 2))
    c = settled(search.candidates(_resolved(spark, d), n))
    e = search.navigable_edges(n.join(c.select("database_id").distinct(), "database_id", "left_semi"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "nm"))
    x = c.filter("dep_nm <= published_range_nm").select("request_id", "limit_nm", F.col("database_id").alias("a"), "dep_nm")
    y = c.filter("arr_nm <= published_range_nm").select("request_id", F.col("database_id").alias("b"), "arr_nm")
    t = x.join(both, "a").join(y, ["request_id", "b"]).withColumn("total_nm", F.expr("dep_nm + nm + arr_nm")).filter("total_nm <= limit_nm")
    return rounded(t.groupBy("request_id").agg(F.min("total_nm").alias("total_nm")))


def _layers(count: int) -> str:
    """Least totals by legs: a level for each further navaid."""
    parts = [f"{_cand('long')}, vor AS (SELECT * FROM cand WHERE family IN ({VOR_LIST})), {EDGES}, steps AS (SELECT a, b, nm FROM edges UNION ALL SELECT b, a, nm FROM edges), l1 AS (SELECT request_id, database_id AS node, dep_nm AS t FROM vor WHERE dep_nm <= reach AND dep_nm <= direct * 15e-1)"]
    for i in range(2, count + 1):
        parts.append(f"l{i} AS (SELECT l.request_id, e.b AS node, min(l.t + e.nm) AS t FROM l{i - 1} l JOIN steps e ON e.a = l.node JOIN vor v ON v.request_id = l.request_id AND v.database_id = e.b WHERE l.t + e.nm + v.arr_nm <= v.direct * 15e-1 + 1e-6 GROUP BY l.request_id, e.b)")
    done = " UNION ALL ".join(f"SELECT l.request_id, {i + 1} AS legs, min(l.t + v.arr_nm) AS t FROM l{i} l JOIN vor v ON v.request_id = l.request_id AND v.database_id = l.node WHERE v.arr_nm <= v.reach AND l.t + v.arr_nm <= v.direct * 15e-1 GROUP BY l.request_id" for i in range(1, count + 1))
    return ", ".join(parts) + f", best AS (SELECT request_id, legs, t, row_number() OVER (PARTITION BY request_id ORDER BY round(t, 7), legs) AS k FROM ({done})) SELECT r.request_id, CASE WHEN b.t IS NULL THEN 'no-route' ELSE 'found' END AS status, CAST(b.legs AS INTEGER) AS legs, round(b.t, 6) AS total_nm FROM res r LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (request_id)"


@query(_layers(24), LONGS)
def optimal_route(spark, d):
    """Best routes of the long requests over VOR-family navaids."""
    plans = search.plan_routes(derived(spark, d, "long_requests"), derived(spark, d, "long_airports"), _vors(spark, d))
    return rounded(plans.select("request_id", "status", "legs", "total_nm"))


def _staged_sql() -> str:
    layers = _layers(24)
    return layers[: layers.rindex(" SELECT r.request_id")] + ", won AS (SELECT request_id, b.t, r.direct, CASE WHEN b.t <= r.direct * 11e-1 THEN 11e-1 WHEN b.t <= r.direct * 125e-2 THEN 125e-2 ELSE 15e-1 END AS factor FROM best b JOIN res r USING (request_id) WHERE k = 1) SELECT w.request_id, CAST(CASE w.factor WHEN 11e-1 THEN 1 WHEN 125e-2 THEN 2 ELSE 3 END AS INTEGER) AS stage, any_value(w.factor) AS factor, count(*) AS admitted, round(any_value(w.t), 6) AS total_nm FROM won w JOIN vor v ON v.request_id = w.request_id AND v.dep_nm + v.arr_nm <= w.direct * w.factor GROUP BY ALL"


@query(_staged_sql(), LONGS)
def staged_discovery(spark, d):
    """The stage that found each long request's best route, and the navaids admitted until then."""
    found = search.discover(_resolved(spark, d, "long"), _vors(spark, d))
    return rounded(found.select("request_id", "stage", "factor", "admitted", "total_nm"))


@query(ORACLES["optimal_route"])
def frontier_route(spark, d):
    """As optimal_route, with every request solved by joins."""
    plans = search.plan_routes(derived(spark, d, "long_requests"), derived(spark, d, "long_airports"), _vors(spark, d), pairs=0)
    return rounded(plans.select("request_id", "status", "legs", "total_nm"))


@query()
def route_plans(spark, d):
    """Plans of all local and long requests, NDB fallback included, with their navaids."""
    requests, airports = (derived(spark, d, f"local_{t}").unionByName(derived(spark, d, f"long_{t}")) for t in ("requests", "airports"))
    plans = search.plan_routes(requests, airports, derived(spark, d, "navaids"))
    return rounded(plans.select("request_id", "status", "mode", "legs", F.array_join(F.col("route.identifier"), " ").alias("navaids"), "total_nm", "stage", F.array_join(F.transform("completed_factors", lambda f: f.cast("string")), " ").alias("completed_factors")))


C = ("a.latitude", "a.longitude", "b.latitude", "b.longitude")


@query(f"SELECT request_id, round({geo.course_sql(*C)}, 6) AS departure_true, round({geo.arrival_course_sql(*C)}, 6) AS arrival_true FROM long_requests q JOIN long_airports a ON a.icao = q.departure JOIN long_airports b ON b.icao = q.arrival", LONGS)
def leg_courses(spark, d):
    r = _resolved(spark, d, "long")
    at = ("departure_airport.latitude", "departure_airport.longitude", "arrival_airport.latitude", "arrival_airport.longitude")
    return rounded(r.select("request_id", F.expr(geo.course_sql(*at)).alias("departure_true"), F.expr(geo.arrival_course_sql(*at)).alias("arrival_true")))


@query(f"SELECT request_id, round({geo.magnetic_sql(geo.course_sql(*C), 'a.magnetic_declination_deg_east')}, 6) AS departure_magnetic, round({geo.magnetic_sql(geo.arrival_course_sql(*C), 'b.magnetic_declination_deg_east')}, 6) AS arrival_magnetic FROM long_requests q JOIN long_airports a ON a.icao = q.departure JOIN long_airports b ON b.icao = q.arrival", LONGS)
def magnetic_course(spark, d):
    r = _resolved(spark, d, "long")
    at = ("departure_airport.latitude", "departure_airport.longitude", "arrival_airport.latitude", "arrival_airport.longitude")
    return rounded(r.select("request_id", F.expr(geo.magnetic_sql(geo.course_sql(*at), "departure_airport.magnetic_declination_deg_east")).alias("departure_magnetic"), F.expr(geo.magnetic_sql(geo.arrival_course_sql(*at), "arrival_airport.magnetic_declination_deg_east")).alias("arrival_magnetic")))


def _one_leg(spark, d):
    """Plans over the best single navaid, as plan_routes gives them."""
    best, r = one_navaid_route(spark, d), _resolved(spark, d)
    plan = r.join(best.select("request_id", "total_nm", F.array(F.struct("identifier", "database_id")).alias("route")), "request_id")
    return plan.withColumn("status", F.lit("found")).withColumn("mode", F.lit("vor-family")).withColumn("legs", F.lit(2))


_ONE = ORACLES["one_navaid_route"]
_LEGS = _ONE[: _ONE.rindex(" SELECT request_id, identifier")] + f""", l AS (
    SELECT o.request_id, 1 AS leg, r.dlat AS la, r.dlon AS lo, n.latitude AS lb, n.longitude AS lp, r.ddecl AS da, n.magnetic_declination_deg_east AS db, NULL::DOUBLE AS va, n.facility_variation_deg_east AS vb, false AS ka, true AS kb, NULL::DATE AS ea, n.facility_variation_effective_date AS eb FROM one o JOIN res r USING (request_id) JOIN navaids n USING (database_id) WHERE k = 1
    UNION ALL SELECT o.request_id, 2, n.latitude, n.longitude, r.alat, r.alon, n.magnetic_declination_deg_east, r.adecl, n.facility_variation_deg_east, NULL, true, false, n.facility_variation_effective_date, NULL FROM one o JOIN res r USING (request_id) JOIN navaids n USING (database_id) WHERE k = 1),
    c AS (SELECT *, {geo.haversine_sql("la", "lo", "lb", "lp")} AS nm, {geo.course_sql("la", "lo", "lb", "lp")} AS ta, {geo.arrival_course_sql("la", "lo", "lb", "lp")} AS tb FROM l)"""


@query(_LEGS + f" SELECT request_id, leg, round(nm, 6) AS distance_nm, round(ta, 6) AS departure_true, round(tb, 6) AS arrival_true, round({geo.magnetic_sql('ta', 'da')}, 6) AS departure_magnetic, round({geo.magnetic_sql('tb', 'db')}, 6) AS arrival_magnetic, round({geo.magnetic_sql('ta', 'va')}, 6) AS departure_guidance, round({geo.magnetic_sql('tb', 'vb')}, 6) AS arrival_guidance FROM c")
def route_legs(spark, d):
    """Legs of the single-navaid routes, with courses and guidance."""
    legs = leg_plans.route_legs(_one_leg(spark, d), derived(spark, d, "navaids"))
    return rounded(legs.select("request_id", "leg", "distance_nm", "departure_true", "arrival_true", "departure_magnetic", "arrival_magnetic", "departure_guidance", "arrival_guidance"))


@query(_LEGS + """, w AS (SELECT request_id, 'magnetic-course-unavailable' AS code FROM c WHERE da IS NULL UNION ALL SELECT request_id, 'magnetic-course-unavailable' FROM c WHERE db IS NULL
    UNION ALL SELECT request_id, 'vor-guidance-unavailable' FROM c WHERE ka AND va IS NULL UNION ALL SELECT request_id, 'vor-guidance-unavailable' FROM c WHERE kb AND vb IS NULL
    UNION ALL SELECT request_id, 'facility-variation-date-unavailable' FROM c WHERE ka AND va IS NOT NULL AND ea IS NULL UNION ALL SELECT request_id, 'facility-variation-date-unavailable' FROM c WHERE kb AND vb IS NOT NULL AND eb IS NULL)
    SELECT request_id, code, count(*) AS n FROM w GROUP BY ALL""")
def warnings_by_code(spark, d):
    plans = _one_leg(spark, d)
    return leg_plans.warning_summary(leg_plans.warnings(leg_plans.route_legs(plans, derived(spark, d, "navaids")), plans)).drop("places")


def _records(spark, d) -> DataFrame:
    """JSON records of the raw navaids; some with faults, by their key."""
    r = derived(spark, d, "raw_navaids")
    k = F.col("k")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = lambda c: c.cast("string")
    lat = F.when(k % 13 == 5, F.lit("91")).otherwise(number(F.col("latitude")))
    frequency = F.when(k % 17 == 3, F.lit("112.30")).when(F.col("type") == 2, F.lit("350.000")).otherwise(F.format_string("%.3f", 108 + (k % 200) / 20.0))
    unit = F.when(F.col("type") == 2, F.lit("1")).otherwise("2")
    reach = F.when(k % 19 == 4, F.lit('"range":null,')).when(k % 5 == 1, F.lit("")).otherwise(F.concat(F.lit('"range":{"value":'), number(F.col("published_range_nm")), F.lit(',"unit":2},')))
    text = F.concat(
        F.lit('{"_id":'), q(F.concat(F.lit("id"), F.col("database_id"))), F.lit(',"type":'), number(F.col("type")), F.lit(',"geometry":{"type":"Point","coordinates":['), number(F.col("longitude")), F.lit(","), lat, F.lit("]},"),
        F.lit('"identifier":'), F.when(k % 23 == 6, q(F.lit("  "))).otherwise(q("identifier")), F.lit(","), reach, F.lit('"frequency":{"value":'), q(frequency), F.lit(',"unit":'), unit, F.lit("}}"),
    )
    return r.select(text.alias("record"))


_REASON = "CASE WHEN t < 2 THEN 'unsupported-navaid-type' WHEN k % 13 = 5 THEN 'invalid-coordinates' WHEN k % 23 = 6 THEN 'missing-identifier' WHEN k % 17 = 3 THEN 'invalid-frequency' WHEN k % 19 = 4 THEN 'invalid-published-range' END"


@query(f"SELECT concat('id', database_id) AS source_record_id, {FAMILY_CASE} AS family, CASE WHEN k % 19 = 4 THEN NULL WHEN k % 5 = 1 THEN 90e0 ELSE published_range_nm END AS published_range_nm, {_REASON} AS reason FROM (SELECT *, type AS t FROM raw_navaids)", ("raw_navaids",))
def classify_navaids(spark, d):
    """Raw JSON records with the first reason that excludes them."""
    return classify.classified(classify.identified(_records(spark, d))).select("source_record_id", "family", "published_range_nm", "reason")


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM (SELECT *, type AS t FROM raw_navaids)) WHERE reason IS NOT NULL GROUP BY reason", ("raw_navaids",))
def exclusion_counts(spark, d):
    return classify.exclusion_counts(classify.classified(classify.identified(_records(spark, d))))


@query(f"SELECT count(*) FILTER (WHERE family IN ({VOR_LIST})) AS vor_family, count(*) FILTER (WHERE family = 'NDB') AS fallback, count(*) FILTER (WHERE facility_variation_deg_east IS NOT NULL) AS with_variation FROM navaids", ("navaids",))
def vor_fallback_counts(spark, d):
    return derived(spark, d, "navaids").agg(F.count_if(F.col("family").isin(*VOR_FAMILIES)).alias("vor_family"), F.count_if(F.col("family") == "NDB").alias("fallback"), F.count_if(F.col("facility_variation_deg_east").isNotNull()).alias("with_variation"))


@query("SELECT bool_or(trim(c_name) = '' OR c_name IS NULL) AS invalid_identity, bool_or(c_acctbal < 0) AS invalid_geometry, bool_or(c_acctbal - 5000 < -180 OR c_acctbal - 5000 >= 180) AS invalid_magnetic_angle, bool_or(c_acctbal IS NOT NULL) AS has_declination FROM customer")
def contract_flags(spark, d):
    """The airports' data rules, over customers that stand for airports."""
    a = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("database_id"), F.lit("ABCD").alias("icao"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") < 0, 200.0).otherwise(10.0).alias("longitude"), F.lit(5.0).alias("latitude"), (F.col("c_acctbal") - 5000).cast("double").alias("magnetic_declination_deg_east"))
    return contract.airport_flags(a)


@query("SELECT 'identifier' AS key, identifier AS value, count(*) AS n FROM navaids GROUP BY identifier HAVING count(*) > 1 UNION ALL SELECT 'database_id', database_id, count(*) FROM navaids GROUP BY database_id HAVING count(*) > 1", ("navaids",))
def duplicate_identity(spark, d):
    return contract.duplicates(derived(spark, d, "navaids"), "identifier", "database_id")


def _match_inputs(spark, d):
    """Navaids, and reference records 0.005 degrees north of every third VOR, some twice, some without values."""
    n = derived(spark, d, "navaids").filter("family <> 'NDB'").withColumn("k", F.col("database_id").cast("long"))
    csv = n.filter("k % 3 <> 2").select(F.col("identifier").alias("NAV_ID"), F.lit("VORTAC").alias("NAV_TYPE"), (F.col("latitude") + 0.005).cast("string").alias("LAT_DECIMAL"), F.col("longitude").cast("string").alias("LONG_DECIMAL"), F.format_string("%.2f", "frequency_value").alias("FREQ"), F.when(F.col("k") % 4 == 1, F.lit("")).otherwise("7.5").alias("MAG_VARN"), F.lit("W").alias("MAG_VARN_HEMIS"), F.lit("2020").alias("MAG_VARN_YEAR"), "k")
    twice = csv.filter("k % 10 = 0").withColumn("MAG_VARN_YEAR", F.lit("2015"))
    navaids = n.withColumn("source_record_id", F.col("database_id")).withColumn("country", F.when(F.col("k") % 7 == 0, F.array(F.lit("CA"))).when(F.col("k") % 7 == 1, F.array(F.lit("CA"), F.lit(" us "))))
    return navaids, facility.reference_records(csv.unionByName(twice).drop("k"))


def _matching(spark, d):
    navaids, records = _match_inputs(spark, d)
    return facility.match_facilities(navaids, records, records.select("country_code"), "cycle 2501")


# frequencies repeat every 200 and identifiers every 700 keys, so both agree within 1,400 keys
_MATCH = "WITH v AS (SELECT *, CAST(database_id AS BIGINT) AS k FROM navaids WHERE family <> 'NDB'), ref AS (SELECT k AS rk, identifier, frequency_value AS f, latitude + 5e-3 AS rlat, longitude AS rlon, k % 4 = 1 AS unusable FROM v WHERE k % 3 <> 2 UNION ALL SELECT k, identifier, frequency_value, latitude + 5e-3, longitude, k % 4 = 1 FROM v WHERE k % 3 <> 2 AND k % 10 = 0), hits AS (SELECT v.database_id, count(*) AS n, bool_or(unusable) AS unusable FROM v JOIN ref r ON r.identifier = v.identifier AND round(r.f * 1000000) = round(v.frequency_value * 1000000) WHERE " + geo.haversine_sql("v.latitude", "v.longitude", "r.rlat", "r.rlon") + " <= 1e0 GROUP BY v.database_id), out AS (SELECT v.database_id AS source_record_id, CASE WHEN k % 7 = 0 THEN 'outside-source-coverage' WHEN coalesce(n, 0) <> 1 THEN 'no-unique-match' WHEN unusable THEN 'unusable-source-value' ELSE 'matched' END AS outcome FROM v LEFT JOIN hits USING (database_id))"


@query(f"WITH n AS (SELECT CAST(database_id AS BIGINT) AS k, identifier, latitude, longitude FROM navaids WHERE family <> 'NDB'), r AS (SELECT * FROM n WHERE k % 3 <> 2 UNION ALL SELECT * FROM n WHERE k % 3 <> 2 AND k % 10 = 0) SELECT n.k % 10 AS digit, count(*) AS pairs FROM n JOIN r ON r.identifier = n.identifier AND r.k % 200 = n.k % 200 AND {geo.haversine_sql('n.latitude', 'n.longitude', '(r.latitude + 5e-3)', 'r.longitude')} <= {(facility.NEAR_M + facility.ERROR_M) / 1852 * facility.FAR!r}e0 GROUP BY n.k % 10", ("navaids",))
def compared_facilities(spark, d):
    """Pairs of a navaid and a record whose distance on the ellipsoid is taken, by last digit: they
    grow with the rows, though identifiers and frequencies stay few."""
    navaids, records = _match_inputs(spark, d)
    return facility.compared(navaids, records).groupBy((F.col("source_record_id").cast("long") % 10).alias("digit")).agg(F.count(F.lit(1)).alias("pairs"))


@query(_MATCH + " SELECT source_record_id, outcome, CASE WHEN outcome = 'matched' THEN -75e-1 END AS facility_variation_deg_east FROM out", ("navaids",))
def facility_match(spark, d):
    return _matching(spark, d).select("source_record_id", "outcome", "facility_variation_deg_east")


@query(_MATCH + " SELECT outcome, count(*) AS n FROM out GROUP BY outcome", ("navaids",))
def facility_outcomes(spark, d):
    return _matching(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()


@query("WITH c AS (SELECT DISTINCT CAST(DATE '2025-01-23' + CAST(floor(date_diff('day', DATE '2025-01-23', CAST(o_orderdate AS DATE)) / 28e0) * 28 AS INTEGER) AS DATE) AS e FROM orders) SELECT CAST(max(e) AS VARCHAR) AS effective_date, 1::BIGINT AS n FROM c WHERE e <= DATE '1995-06-17'")
def latest_cycle(spark, d):
    """The cycle in force on a day, of all cycles that orders lie in."""
    cycles = _orders(spark, d).select(cycle_date(F.col("day")).alias("effective_date")).distinct()
    cycles = cycles.withColumn("published_at", F.date_sub("effective_date", 28).cast("timestamp")).withColumn("cycle_id", cycle_id(F.col("effective_date")))
    return facility.latest_cycle(cycles, "1995-06-17T00:00:00Z").select(F.col("effective_date").cast("string").alias("effective_date"), "n")


@query("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), e AS (SELECT day, CAST(DATE '2025-01-23' + CAST(floor(date_diff('day', DATE '2025-01-23', day) / 28e0) * 28 AS INTEGER) AS DATE) AS effective_date FROM d) SELECT CAST(day AS VARCHAR) AS day, CAST(effective_date AS VARCHAR) AS effective_date, concat(strftime(effective_date, '%y'), lpad(CAST(CAST(floor((dayofyear(effective_date) - 1) / 28e0) AS INTEGER) + 1 AS VARCHAR), 2, '0')) AS cycle_id, strftime(effective_date, '%d_%b_%Y') AS archive_date FROM e")
def airac_cycle(spark, d):
    e = _orders(spark, d).withColumn("effective_date", cycle_date(F.col("day")))
    return e.select(F.col("day").cast("string").alias("day"), F.col("effective_date").cast("string").alias("effective_date"), cycle_id(F.col("effective_date")).alias("cycle_id"), archive_date(F.col("effective_date")).alias("archive_date"))


@query("WITH g AS (SELECT concat('{\"k\":', CAST(l_quantity AS INTEGER), '}') AS j FROM lineitem), s AS (SELECT j, row_number() OVER (PARTITION BY j) AS o FROM g) SELECT concat('generated:sha256:', sha256(j), ':', CAST(o AS VARCHAR)) AS source_record_id FROM s")
def generated_ids(spark, d):
    """Ids of records that bring none: content checksum and ordinal."""
    raw = table(spark, d, "lineitem").select(F.format_string('{ "k" : %d }', F.col("l_quantity").cast("int")).alias("record"))
    return classify.identified(raw).select("source_record_id")


@query("SELECT event_id, concat('sha256:', sha256(replace(props, ' ', ''))) AS checksum, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def record_checksums(spark, d):
    """Canonical checksums and a field of the events' JSON."""
    from skylattice.functions.canonical import canonical_json

    e = table(spark, d, "events").select("event_id", canonical_json("props").alias("j"))
    return e.select("event_id", sha256_tag(F.col("j")).alias("checksum"), F.get_json_object("j", "$.k").cast("long").alias("k"))


@query("SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def orphan_anti_join(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return snapshot.orphans(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey")


@query("SELECT (SELECT count(*) FROM raw_navaids) AS raw, (SELECT count(*) FROM navaids) AS planner, (SELECT count(*) FROM raw_navaids WHERE type < 2) AS excluded", ("raw_navaids", "navaids"))
def snapshot_counts(spark, d):
    r = derived(spark, d, "raw_navaids")
    return r.agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("type") >= 2).alias("planner"), F.count_if(F.col("type") < 2).alias("excluded"))


@query("SELECT n_name, CASE WHEN regexp_full_match(upper(substr(n_name, 1, 4)), '[A-Z]{4}') THEN upper(substr(n_name, 1, 4)) END AS icao FROM nation")
def icao_codes(spark, d):
    return table(spark, d, "nation").select("n_name", icao(F.concat(F.lit(" \t"), F.lower(F.substring("n_name", 1, 4)), F.lit(" \n"))).alias("icao"))


@query("SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) % 100000 AS cents, CASE WHEN CAST(round(p_retailprice * 100) AS BIGINT) % 100000 > 0 THEN (CAST(round(p_retailprice * 100) AS BIGINT) % 100000) * 10000 END AS hertz, CASE WHEN (CAST(round(p_retailprice * 100) AS BIGINT) % 100000) / 100e0 <= 180 THEN -(CAST(round(p_retailprice * 100) AS BIGINT) % 100000) / 100e0 END AS variation FROM part")
def frequency_and_variation(spark, d):
    """Exact hertz and signed variation from decimal text."""
    cents = (F.round(F.col("p_retailprice") * 100).cast("long") % 100_000).alias("cents")
    p = table(spark, d, "part").select("p_partkey", cents)
    text = F.concat(F.floor(F.col("cents") / 100).cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    return p.select("p_partkey", "cents", megahertz_to_hertz(text).alias("hertz"), signed_variation(text, F.lit("w"), F.lit("2020")).alias("variation"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -1 - c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0")
def upserted_rows(spark, d):
    """A third of the rows replaced by key, and as many new ones."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    new = c.filter("c_custkey % 3 = 0").withColumn("c_name", F.lit("new"))
    return snapshot.upserted(c, new.unionByName(new.withColumn("c_custkey", (-1 - F.col("c_custkey")).cast(c.schema["c_custkey"].dataType))), "c_custkey")
