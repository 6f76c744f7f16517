"""Relations of the engine derived from the driver's tables by fixed arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylattice.schema import FAMILY_BY_TYPE

_FAMILY = "CASE k % 9 " + " ".join(f"WHEN {t} THEN '{f}'" for t, f in FAMILY_BY_TYPE.items()) + " END"

#: SQL that Spark and DuckDB read alike; each uses the tables orders, nation or customer. All orders are
#: read: each block of 1,500 keys lies in one of 24 fields of 25 by 60 degrees, so that density
#: grows with a 24th of the orders.
RAW = """SELECT k, concat('V', CAST(k % 700 AS VARCHAR(9))) AS identifier, CAST(k AS VARCHAR(9)) AS database_id, k % 9 AS type,
    CAST(25 * ((field + 4) % 6) - 75 AS DOUBLE) + CAST((k * 7919) % 2500 AS DOUBLE) / 100e0 AS latitude, floor(field / 6e0) * 60e0 - 125e0 + CAST((k * 104729) % 6000 AS DOUBLE) / 100e0 AS longitude,
    CAST(40 + (k % 7) * 15 AS DOUBLE) AS published_range_nm
    FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(floor(o_orderkey / 1500e0) AS BIGINT) % 24 AS field FROM orders) o"""
NAVAIDS = f"""SELECT database_id, identifier, concat('Navaid ', identifier) AS name, {_FAMILY} AS family, longitude, latitude,
    CASE WHEN type = 2 THEN 200e0 + CAST(k % 300 AS DOUBLE) ELSE 108e0 + CAST(k % 200 AS DOUBLE) / 20e0 END AS frequency_value,
    CASE WHEN type = 2 THEN 'kHz' ELSE 'MHz' END AS frequency_unit, published_range_nm,
    CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k % 41 AS DOUBLE) - 20e0 END AS magnetic_declination_deg_east,
    CASE WHEN type > 2 AND k % 3 <> 0 THEN CAST(k % 37 AS DOUBLE) - 18e0 END AS facility_variation_deg_east,
    CASE WHEN type > 2 AND k % 3 <> 0 THEN 'reference' END AS facility_variation_source,
    CASE WHEN type > 2 AND k % 3 = 1 THEN DATE '2025-01-23' END AS facility_variation_effective_date
    FROM ({RAW}) r WHERE type >= 2"""
_AIRPORT = "CAST(n AS VARCHAR(9)) AS database_id, concat('{code}', chr(CAST(65 + n AS INT))) AS icao, concat('Airport ', CAST(n AS VARCHAR(9))) AS name, {lon} AS longitude, {lat} AS latitude, CASE WHEN n % 5 = 0 THEN NULL ELSE CAST(n AS DOUBLE) - 12e0 END AS magnetic_declination_deg_east FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation) x"
LONG = "SELECT " + _AIRPORT.format(code="NAA", lon="-122e0 + CAST((n * 53) % 55 AS DOUBLE)", lat="27e0 + CAST((n * 37) % 21 AS DOUBLE)")
LOCAL = "SELECT " + _AIRPORT.format(code="NLA", lon="-101e0 + floor(n / 5e0) * 11e-1", lat="33e0 + CAST(n % 5 AS DOUBLE) * 9e-1")


def _requests(code: str, steps: tuple[int, ...]) -> str:
    one = "SELECT concat('{c}', CAST(n AS VARCHAR(9)), '-', CAST((n + {s}) % 25 AS VARCHAR(9))) AS request_id, concat('{c}', chr(CAST(65 + n AS INT))) AS departure, concat('{c}', chr(CAST(65 + (n + {s}) % 25 AS INT))) AS arrival FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation) x"
    return " UNION ALL ".join(one.format(c=code, s=s) for s in steps)


#: Each customer has a request between two airports, in the first field of navaids. There are codes
#: for PLACES pairs of airports; from then on customers share them.
PLACES = 26**4 // 2
_CODE = "concat(chr(CAST(65 + m % 26 AS INT)), chr(CAST(65 + floor(m / 26e0) % 26 AS INT)), chr(CAST(65 + floor(m / 676e0) % 26 AS INT)), chr(CAST(65 + floor(m / 17576e0) % 26 AS INT)))"
_ENDS = f"(SELECT c * 2 + {{end}} AS m, c, {{end}} AS e FROM (SELECT DISTINCT CAST(c_custkey AS BIGINT) % {PLACES} AS c FROM customer) y) x"
_CUSTOMER_AIRPORT = "SELECT concat('c', CAST(m AS VARCHAR(9))) AS database_id, " + _CODE + " AS icao, 'Airport' AS name, -120e0 + CAST((c * 53) % 4900 AS DOUBLE) / 100e0 + e * (1e0 + CAST(c % 5 AS DOUBLE) * 8e-1) AS longitude, 27e0 + CAST((c * 37) % 1900 AS DOUBLE) / 100e0 + e * (CAST(c % 7 AS DOUBLE) - 3e0) * 6e-1 AS latitude, CAST(c % 31 AS DOUBLE) - 15e0 AS magnetic_declination_deg_east FROM " + _ENDS
CUSTOMER_AIRPORTS = " UNION ALL ".join(_CUSTOMER_AIRPORT.format(end=e) for e in (0, 1))
CUSTOMER_REQUESTS = f"SELECT concat('c', CAST(c AS VARCHAR(9))) AS request_id, {_CODE.replace('m', 'd')} AS departure, {_CODE.replace('m', 'a')} AS arrival FROM (SELECT CAST(c_custkey AS BIGINT) AS c, CAST(c_custkey AS BIGINT) % {PLACES} * 2 AS d, CAST(c_custkey AS BIGINT) % {PLACES} * 2 + 1 AS a FROM customer) x"
LONG_REQUESTS, LOCAL_REQUESTS = _requests("NAA", (5, 11)), _requests("NLA", tuple(range(1, 13)))
VIEWS = {"navaids": NAVAIDS, "long_airports": LONG, "local_airports": LOCAL, "long_requests": LONG_REQUESTS, "local_requests": LOCAL_REQUESTS, "raw_navaids": RAW, "customer_airports": CUSTOMER_AIRPORTS, "customer_requests": CUSTOMER_REQUESTS}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables in ``sf_dir``."""
    sql = VIEWS[name]
    used = [t for t in ("orders", "nation", "customer") if f"FROM {t}" in sql]
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql.replace("VARCHAR(9)", "STRING"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with these relations in front."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + ("," if sql.lstrip().startswith("WITH ") else "") + " " + (sql.lstrip()[5:] if sql.lstrip().startswith("WITH ") else sql)
