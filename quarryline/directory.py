"""The directory's tables made of the provided ones, as one SQL text for both engines, so that operators on them can be checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The time that time-dependent queries look from.
NOW = "'2024-06-01 00:00:00'"
_CUSTOMERS = "FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"
_BAND = "CASE WHEN {x} >= 85 THEN 'VERY_HIGH' WHEN {x} >= 70 THEN 'HIGH' WHEN {x} >= 45 THEN 'MEDIUM' WHEN {x} >= 20 THEN 'LOW' ELSE 'INVALID' END"
_DAY = "CAST(DATE '2023-09-01' + CAST({x} AS INT) AS {{TIME}})"
NATIONAL = (
    "concat('0', CASE WHEN c_custkey % 3 = 0 THEN concat(CASE WHEN c_custkey % 2 = 0 THEN '91' ELSE '93' END, lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 8, '0')) "
    "WHEN c_custkey % 3 = 1 THEN concat('21', lpad(CAST(c_custkey * 104729 % 100000000 AS STRING), 8, '0')) ELSE concat('99', lpad(CAST(c_custkey * 31 % 1000000 AS STRING), 6, '0')) END)"
)


def _day(x: str) -> str:
    return _DAY.format(x=x)


TABLES = {
    "businesses": f"""SELECT c_custkey AS id, concat('fp', CAST(c_custkey AS STRING)) AS fingerprint, c_name AS name,
 CASE WHEN c_custkey % 4 = 0 THEN concat('Owner ', CAST(c_custkey % 97 AS STRING)) ELSE 'NOT_FOUND' END AS owner_name,
 CASE WHEN c_custkey % 2 = 0 THEN concat('Street ', CAST(c_custkey % 31 AS STRING)) ELSE 'NOT_FOUND' END AS address, r_name AS province_name, 'NOT_FOUND' AS county_name, n_name AS city_name,
 CASE WHEN c_custkey % 3 = 0 THEN concat('http://www.shop', CAST(c_custkey % 200 AS STRING), '.ir/') ELSE 'NOT_FOUND' END AS website,
 CASE WHEN c_custkey % 3 = 0 THEN concat('shop', CAST(c_custkey % 200 AS STRING), '.ir') ELSE 'NOT_FOUND' END AS domain,
 split(concat('http://t.me/', CAST(c_custkey % 50 AS STRING)), ' ') AS social_links, CASE WHEN c_custkey % 5 = 0 THEN 'UNKNOWN' WHEN c_custkey % 5 = 1 THEN 'MAKER' ELSE 'SELLER' END AS business_type,
 split(concat(c_mktsegment, ',', CASE WHEN c_custkey % 2 = 0 THEN 'HYGIENE' ELSE 'COSMETIC' END), ',') AS categories, c_mktsegment AS primary_category,
 CAST(c_custkey * 13 % 100 AS INT) AS relevance_score, CAST(c_custkey * 7919 % 101 AS INT) AS confidence, {_BAND.format(x="(c_custkey * 7919 % 101)")} AS confidence_band, '-' AS confidence_breakdown,
 CAST(1 AS BIGINT) AS source_count, CAST(1 AS BIGINT) AS independent_source_count,
 CASE WHEN c_custkey % 13 = 0 THEN 'MERGED' WHEN c_custkey % 11 = 0 THEN 'QUARANTINED' ELSE 'ACTIVE' END AS status, CAST(NULL AS BIGINT) AS merged_into, c_custkey % 17 = 0 AS is_synthetic,
 concat('About ', c_name) AS description, {_day("c_custkey % 300")} AS discovered_at, {_day("c_custkey % 300 + 5")} AS last_seen_at,
 CASE WHEN c_custkey % 3 = 1 THEN {_day("c_custkey % 290")} END AS last_validated_at {_CUSTOMERS}""",
    "phones": f"""SELECT c_custkey AS id, concat('+98', substr({NATIONAL}, 2)) AS e164, {NATIONAL} AS national, substr({NATIONAL}, 2) AS digits,
 CASE c_custkey % 3 WHEN 0 THEN 'MOBILE' WHEN 1 THEN 'LANDLINE' ELSE 'UNKNOWN' END AS type, CASE WHEN c_custkey % 3 = 1 THEN '021' END AS area_code,
 CASE WHEN c_custkey % 3 = 1 THEN substr({NATIONAL}, 4) END AS subscriber, CASE c_custkey % 5 WHEN 0 THEN 'VALID' WHEN 1 THEN 'PROBABLE' WHEN 2 THEN 'INVALID' ELSE 'UNVERIFIED' END AS status,
 CAST(c_custkey * 37 % 101 AS INT) AS confidence, {_BAND.format(x="(c_custkey * 37 % 101)")} AS confidence_band, c_custkey % 19 = 0 AS is_synthetic, CAST(c_custkey % 4 AS BIGINT) AS validation_count,
 {_day("c_custkey % 200")} AS first_seen_at, {_day("c_custkey % 200 + 3")} AS last_seen_at, CASE WHEN c_custkey % 2 = 0 THEN {_day("c_custkey % 250")} END AS last_validated_at,
 CASE WHEN c_custkey % 10 <> 0 THEN {_day("c_custkey % 400")} END AS next_check_at, {_day("c_custkey % 200")} AS created_at, {_day("c_custkey % 200")} AS updated_at FROM {{customer}}""",
    "business_phones": f"""SELECT c_custkey * 2 AS id, c_custkey AS business_id, c_custkey AS phone_id, true AS is_primary, 'main' AS label, CAST(c_custkey * 31 % 101 AS INT) AS confidence, 'UNVERIFIED' AS status,
 CAST(1 AS BIGINT) AS source_count, {_day("c_custkey % 200")} AS first_seen_at, {_day("c_custkey % 200")} AS last_seen_at FROM {{customer}} WHERE c_custkey % 7 <> 0
 UNION ALL SELECT c_custkey * 2 + 1, c_custkey, greatest(c_custkey - 3, 0), false, 'fax', CAST(c_custkey * 53 % 101 AS INT), 'UNVERIFIED', CAST(1 AS BIGINT), {_day("c_custkey % 200")}, {_day("c_custkey % 200")}
 FROM {{customer}} WHERE c_custkey % 5 = 0""",
    "sources": """SELECT CAST(n_nationkey AS BIGINT) AS id, lower(n_name) AS key, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'SEARCH_ENGINE' ELSE 'OPEN_DATA' END AS kind,
 n_nationkey % 3 = 0 AS requires_key, n_nationkey % 4 <> 0 AS enabled FROM {nation}""",
    "source_observations": """SELECT o_orderkey AS id, concat('h', CAST(o_orderkey AS STRING)) AS dedupe_hash, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS business_id,
 CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS phone_id, CAST(o_orderkey % 25 AS BIGINT) AS source_id, 'PAGE_TEXT' AS evidence_kind,
 concat('http://www.site', CAST(o_orderkey % 40 AS STRING), '.ir/p/', CAST(o_orderkey AS STRING)) AS url, concat('site', CAST(o_orderkey % 40 AS STRING), '.ir') AS url_domain,
 concat('Title ', CAST(o_orderkey AS STRING)) AS page_title, concat(o_orderpriority, ' order') AS snippet, CAST((o_orderkey % 8 + 2) * 0.0625 + 0.25 AS DOUBLE) AS source_reliability,
 CASE WHEN o_orderkey % 31 = 0 THEN 'SPAM' ELSE 'OK' END AS status, o_orderdate AS observed_at FROM {orders}""",
    "validation_results": """SELECT event_id AS id, CAST(NULL AS BIGINT) AS business_id, user_id AS phone_id, event_type AS method, CASE WHEN value > 50 THEN 'PASS' ELSE 'FAIL' END AS result,
 CASE WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END AS band, CAST(event_id % 101 AS INT) AS confidence, ts AS checked_at FROM {events}""",
    "places": """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS city, concat('County ', CAST(n_nationkey % 6 AS STRING)) AS county, r_name AS province
 FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
}


def _text(name: str, time: str, source) -> str:
    found = ("region", "nation", "customer", "orders", "events", "part", "supplier")
    text = TABLES[name]
    return text.format(TIME=time, **{k: source(k) for k in found})


def directory(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named tables as frames over the Parquet files in ``sf_dir``."""
    return {name: spark.sql(_text(name, "TIMESTAMP_NTZ", lambda k: f"parquet.`{sf_dir}/{k}.parquet`")) for name in names}


def ctes(*names: str) -> str:
    """The same tables as the common table expressions of an oracle's query."""
    return ", ".join(f"{name} AS ({_text(name, 'TIMESTAMP', str)})" for name in names)
