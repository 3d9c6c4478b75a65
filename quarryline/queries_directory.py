"""Queries that run the operators of the directory itself on its tables, with the DuckDB SQL that each must agree with."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quarryline.directory import NOW, ctes, directory
from quarryline.functions.labels import LABELS
from quarryline.operators import catalog, dedup, revalidate, stats, upsert
from quarryline.operators.catalog import BusinessFilter
from quarryline.operators.joins import dealt
from quarryline.plans import jobs, planner, queue
from quarryline.registry import query, table
from quarryline.sources import export, politeness, search

def _now():
    return F.expr(f"TIMESTAMP_NTZ {NOW}")

_LISTED = "NOT is_synthetic AND status IN ('ACTIVE', 'QUARANTINED')"

# ---- lists, pages and details


@query(f"""WITH {ctes("businesses")} SELECT id, name FROM businesses WHERE {_LISTED} AND province_name IN ('ASIA', 'EUROPE') AND business_type IN ('MAKER', 'SELLER')
 AND confidence_band IN ('HIGH', 'VERY_HIGH', 'MEDIUM') AND confidence BETWEEN 30 AND 95 AND discovered_at >= TIMESTAMP '2023-10-01' AND discovered_at <= TIMESTAMP '2024-05-01'""")
def list_businesses(spark, sf_dir):
    f = BusinessFilter(
        provinces=("ASIA", "EUROPE"), types=("MAKER", "SELLER"), bands=("HIGH", "VERY_HIGH", "MEDIUM"), min_confidence=30, max_confidence=95,
        discovered_after=datetime(2023, 10, 1), discovered_before=datetime(2024, 5, 1),
    )
    return catalog.businesses(directory(spark, sf_dir, "businesses", "business_phones"), f).select("id", "name")


@query(f"""WITH {ctes("businesses")} SELECT id FROM businesses WHERE status IN ('ACTIVE', 'MERGED') AND primary_category IN ('MACHINERY', 'FURNITURE') AND last_validated_at >= TIMESTAMP '2023-11-01'
 AND (name ILIKE '%#00%3%' OR address ILIKE '%#00%3%' OR city_name ILIKE '%#00%3%' OR owner_name ILIKE '%#00%3%')""")
def list_by_search(spark, sf_dir):
    f = BusinessFilter(statuses=("ACTIVE", "MERGED"), categories=("MACHINERY", "FURNITURE"), validated_after=datetime(2023, 11, 1), search=" #00%3 ", include_synthetic=True)
    return catalog.businesses(directory(spark, sf_dir, "businesses", "business_phones"), f).select("id")


@query(f"""WITH {ctes("businesses", "business_phones", "phones")} SELECT id FROM businesses b WHERE {_LISTED} AND EXISTS (SELECT 1 FROM business_phones l WHERE l.business_id = b.id)
 AND EXISTS (SELECT 1 FROM business_phones l JOIN phones p ON p.id = l.phone_id WHERE l.business_id = b.id AND p.status IN ('VALID', 'PROBABLE'))""")
def list_with_phones(spark, sf_dir):
    f = BusinessFilter(has_phone=True, phone_statuses=("VALID", "PROBABLE"))
    return catalog.businesses(directory(spark, sf_dir, "businesses", "business_phones", "phones"), f).select("id")


@query(f"WITH {ctes('businesses', 'business_phones')} SELECT id FROM businesses b WHERE {_LISTED} AND NOT EXISTS (SELECT 1 FROM business_phones l WHERE l.business_id = b.id)")
def list_without_phones(spark, sf_dir):
    return catalog.businesses(directory(spark, sf_dir, "businesses", "business_phones"), BusinessFilter(has_phone=False)).select("id")


@query(f"""WITH {ctes("businesses", "sources", "source_observations")} SELECT id FROM businesses b WHERE {_LISTED}
 AND EXISTS (SELECT 1 FROM source_observations o JOIN sources s ON s.id = o.source_id WHERE o.business_id = b.id AND s.key = 'nation_3')""")
def list_by_source(spark, sf_dir):
    return catalog.businesses(directory(spark, sf_dir, "businesses", "business_phones", "sources", "source_observations"), BusinessFilter(source_key="nation_3")).select("id")


@query(f"""WITH {ctes("businesses")}, b AS (SELECT * FROM businesses WHERE {_LISTED})
SELECT * FROM (SELECT 'confidence' AS by_order, id FROM b ORDER BY confidence DESC, id LIMIT 20 OFFSET 10) UNION ALL SELECT * FROM (SELECT 'newest', id FROM b ORDER BY discovered_at DESC, id DESC LIMIT 20 OFFSET 10)
UNION ALL SELECT * FROM (SELECT 'name', id FROM b ORDER BY name, id LIMIT 20 OFFSET 10)""")
def list_pages(spark, sf_dir):
    tables, out = directory(spark, sf_dir, "businesses", "business_phones"), None
    for order in ("confidence", "newest", "name"):
        f = BusinessFilter(order=order, limit=20, offset=10)
        part = catalog.page(catalog.businesses(tables, f), f).select(F.lit(order).alias("by_order"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {ctes('businesses')} SELECT count(*) AS n FROM businesses WHERE {_LISTED} AND city_name IN ('NATION_3', 'NATION_5')")
def list_count(spark, sf_dir):
    return catalog.count(directory(spark, sf_dir, "businesses", "business_phones"), BusinessFilter(cities=("NATION_3", "NATION_5")))


@query(f"WITH {ctes('phones')} SELECT id, e164 FROM phones WHERE NOT is_synthetic AND status IN ('VALID', 'UNVERIFIED') AND type = 'MOBILE' AND confidence >= 40")
def list_phones(spark, sf_dir):
    return catalog.phones_list(directory(spark, sf_dir, "phones")["phones"], ("VALID", "UNVERIFIED"), "MOBILE", 40).select("id", "e164")


_LEDGER = "ledger AS (SELECT event_id AS id, concat('N', CAST(user_id % 9 AS STRING)) AS city, CASE event_id % 4 WHEN 0 THEN 'DONE' WHEN 1 THEN 'BLOCKED' ELSE 'NEW' END AS state, ts AS last_run_at FROM {events})"


@query(f"WITH {_LEDGER.format(events='events')} SELECT id, city FROM ledger WHERE state IN ('DONE', 'NEW') AND city IN ('N1', 'N4') ORDER BY last_run_at DESC, id DESC LIMIT 50")
def list_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "concat('N', CAST(user_id % 9 AS STRING)) AS city", "CASE event_id % 4 WHEN 0 THEN 'DONE' WHEN 1 THEN 'BLOCKED' ELSE 'NEW' END AS state", "ts AS last_run_at"
    )
    return catalog.queries_list(rows, ("DONE", "NEW"), ("N1", "N4"), 50).select("id", "city")


@query(f"WITH {ctes('places')} SELECT id, city AS name, county, province FROM places WHERE province = 'ASIA'")
def list_locations(spark, sf_dir):
    p = directory(spark, sf_dir, "places")["places"]
    none = F.lit(None).cast("bigint")
    county = p.groupBy("county").agg(F.min("id").alias("k"))
    province = p.groupBy("province").agg(F.min("id").alias("m"))
    locations = p.join(county, "county").join(province, "province").select("id", F.lit("city").alias("kind"), F.col("city").alias("name"), (100 + F.col("k")).alias("county_id"), (200 + F.col("m")).alias("province_id"))
    locations = locations.unionByName(county.select((100 + F.col("k")).alias("id"), F.lit("county").alias("kind"), F.col("county").alias("name"), none.alias("county_id"), none.alias("province_id")))
    locations = locations.unionByName(province.select((200 + F.col("m")).alias("id"), F.lit("province").alias("kind"), F.col("province").alias("name"), none.alias("county_id"), none.alias("province_id")))
    return catalog.locations_list(locations, "ASIA")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 40")
def newest_rows(spark, sf_dir):
    return catalog.newest(table(spark, sf_dir, "events"), 40, "ts", "event_id").select("event_id", "ts")


@query(f"""WITH {ctes("business_phones", "phones")} SELECT business_id, string_agg(e164, ',' ORDER BY is_primary DESC, l.confidence DESC, l.phone_id) AS phones, count(*) AS n
FROM business_phones l JOIN phones p ON p.id = l.phone_id GROUP BY 1""")
def phones_of_businesses(spark, sf_dir):
    got = catalog.phones_of(directory(spark, sf_dir, "business_phones", "phones"))
    return got.select("business_id", F.array_join(F.transform("phones", lambda x: x["e164"]), ",").alias("phones"), F.size("phones").cast("bigint").alias("n"))


@query(f"""WITH {ctes("source_observations", "sources")}, o AS (SELECT o.*, s.key, row_number() OVER (PARTITION BY business_id ORDER BY observed_at DESC, o.id DESC) AS k FROM source_observations o JOIN sources s ON s.id = o.source_id WHERE business_id IS NOT NULL)
SELECT business_id, string_agg(concat(key, ' ', page_title, ' ', snippet), '|' ORDER BY k) AS evidence FROM o WHERE k <= 4 GROUP BY 1""")
def evidence_of_businesses(spark, sf_dir):
    got = catalog.evidence_of(directory(spark, sf_dir, "source_observations", "sources"), 4)
    return got.select("business_id", F.array_join(F.transform("evidence", lambda x: F.concat_ws(" ", x["source_key"], x["page_title"], x["snippet"])), "|").alias("evidence"))


@query(f"""WITH {ctes("business_phones", "validation_results")}, v AS (SELECT l.business_id, v.*, row_number() OVER (PARTITION BY l.business_id ORDER BY checked_at DESC, v.id DESC) AS k
 FROM validation_results v JOIN (SELECT DISTINCT business_id, phone_id FROM business_phones) l ON l.phone_id = v.phone_id)
SELECT business_id, string_agg(concat(method, ' ', result), '|' ORDER BY k) AS validations FROM v WHERE k <= 3 GROUP BY 1""")
def validations_of_businesses(spark, sf_dir):
    got = catalog.validations_of(directory(spark, sf_dir, "business_phones", "validation_results"), 3)
    return got.select("business_id", F.array_join(F.transform("validations", lambda x: F.concat_ws(" ", x["method"], x["result"])), "|").alias("validations"))


@query(f"""WITH {ctes("businesses", "business_phones", "source_observations", "validation_results")}, kept AS (SELECT id FROM businesses WHERE {_LISTED} ORDER BY confidence DESC, id LIMIT 30)
SELECT b.id, b.name, (SELECT count(*) FROM business_phones l WHERE l.business_id = b.id) AS phones, least(200, (SELECT count(*) FROM source_observations o WHERE o.business_id = b.id)) AS evidence,
 least(50, (SELECT count(*) FROM validation_results v WHERE v.phone_id IN (SELECT phone_id FROM business_phones l WHERE l.business_id = b.id))) AS validations FROM businesses b WHERE b.id IN (SELECT id FROM kept)""")
def business_details(spark, sf_dir):
    tables, f = directory(spark, sf_dir, "businesses", "business_phones", "phones", "source_observations", "sources", "validation_results"), BusinessFilter(limit=30)
    got = catalog.details(tables, catalog.page(catalog.businesses(tables, f), f))
    return got.select("id", "name", *(F.size(c).cast("bigint").alias(c) for c in ("phones", "evidence", "validations")))


@query(f"""WITH {ctes("places")}, d AS (SELECT c_custkey, concat('NATION_', CAST(c_custkey % 30 AS VARCHAR)) AS city, concat('County ', CAST(c_custkey % 8 AS VARCHAR)) AS county, CASE c_custkey % 3 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'EUROPE' ELSE 'AFRICA' END AS province FROM customer)
SELECT c_custkey, coalesce((SELECT min(id) FROM places p WHERE p.city = d.city AND p.county = d.county), (SELECT min(id) FROM places p WHERE p.city = d.city AND p.province = d.province), (SELECT min(id) FROM places p WHERE p.city = d.city), -1) AS city_id FROM d""")
def resolved_locations(spark, sf_dir):
    d = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('NATION_', c_custkey % 30) AS city", "concat('County ', c_custkey % 8) AS county", "CASE c_custkey % 3 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'EUROPE' ELSE 'AFRICA' END AS province")
    return catalog.resolve_location(d, directory(spark, sf_dir, "places")["places"]).select("c_custkey", F.coalesce("city_id", F.lit(-1).cast("bigint")).alias("city_id"))


@query(f"WITH {ctes('businesses', 'source_observations')} SELECT id FROM businesses WHERE id NOT IN (SELECT business_id FROM source_observations WHERE business_id IS NOT NULL AND status = 'SPAM')")
def businesses_without_evidence(spark, sf_dir):
    t = directory(spark, sf_dir, "businesses", "source_observations")
    return catalog.without_evidence(t | {"source_observations": t["source_observations"].where("status = 'SPAM'")}).select("id")


def _cases(code: str, kind: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS[kind].items()) + f" ELSE {code} END"


@query(f"""WITH {ctes("businesses", "business_phones", "phones")}, kept AS (SELECT * FROM businesses WHERE {_LISTED} AND confidence_band IN ('HIGH', 'LOW') ORDER BY confidence DESC, id LIMIT 50)
SELECT id, city_name AS city, {_cases("business_type", "business_type")} AS business_type_label, {_cases("primary_category", "category")} AS category_label, {_cases("confidence_band", "band")} AS band_label, {_cases("status", "business_status")} AS status_label,
 coalesce((SELECT string_agg(e164, ',' ORDER BY is_primary DESC, l.confidence DESC, l.phone_id) FROM business_phones l JOIN phones p ON p.id = l.phone_id WHERE l.business_id = kept.id), '') AS phones FROM kept""")
def labelled_businesses(spark, sf_dir):
    tables, f = directory(spark, sf_dir, "businesses", "business_phones", "phones"), BusinessFilter.requested(bands=["high", "Low"])
    got = catalog.labelled(tables, catalog.page(catalog.businesses(tables, f), f))
    return got.select("id", "city", "business_type_label", "category_label", "band_label", "status_label", F.array_join(F.transform("phones", lambda x: x["e164"]), ",").alias("phones"))


# ---- counts


@query(f"""WITH {ctes("businesses", "phones")} SELECT count(*) FILTER (status <> 'MERGED') AS businesses_total, count(*) FILTER (status = 'ACTIVE') AS active, count(*) FILTER (status = 'QUARANTINED') AS quarantined,
 count(*) FILTER (status = 'ACTIVE' AND confidence >= 70) AS high_confidence, count(*) FILTER (discovered_at >= TIMESTAMP {NOW} - INTERVAL 24 HOUR) AS new_24h,
 (SELECT count(*) FROM phones) AS phones_total, (SELECT count(*) FROM phones WHERE next_check_at IS NULL OR next_check_at <= TIMESTAMP {NOW}) AS phones_due FROM businesses""")
def dashboard_totals(spark, sf_dir):
    t = directory(spark, sf_dir, "businesses", "phones")
    return stats.dashboard(t["businesses"], t["phones"], _now())


@query(f"""WITH {ctes("source_observations")} SELECT business_id, phone_id, round(sum(source_reliability), 4) AS sum_reliability, max(source_reliability) AS max_reliability, count(*) AS observations, max(observed_at) AS newest,
 bool_or(status = 'SPAM') AS spam, count(DISTINCT url_domain) AS domains, count(DISTINCT source_reliability) AS kinds FROM source_observations WHERE business_id IS NOT NULL AND phone_id IS NOT NULL GROUP BY 1, 2""")
def evidence_rollups(spark, sf_dir):
    o = directory(spark, sf_dir, "source_observations")["source_observations"].where("business_id is not null and phone_id is not null")
    got = stats.evidence_rollup(o, "business_id", "phone_id")
    return got.select("business_id", "phone_id", F.round("sum_reliability", 4).alias("sum_reliability"), "max_reliability", "observations", "newest", "spam", "domains", F.size("reliabilities").cast("bigint").alias("kinds"))


@query(f"""WITH {ctes("businesses", "business_phones")} SELECT 'no_orphan_links' AS name, (SELECT count(*) FROM business_phones WHERE business_id NOT IN (SELECT id FROM businesses)) = 0 AS passed
UNION ALL SELECT 'all_trusted', (SELECT count(*) FROM businesses WHERE confidence < 20) = 0""")
def acceptance_verdicts(spark, sf_dir):
    t = directory(spark, sf_dir, "businesses", "business_phones")
    orphans = t["business_phones"].join(t["businesses"].select(F.col("id").alias("business_id")), "business_id", "left_anti")
    return stats.verdicts({"no_orphan_links": orphans, "all_trusted": t["businesses"].where("confidence < 20")})


@query(f"""WITH {ctes("places", "businesses")} SELECT city, county, province, (SELECT count(*) FROM businesses b WHERE b.city_name = p.city) AS existing FROM places p
 WHERE province IN ('ASIA', 'EUROPE') ORDER BY existing, length(city), city, province, county LIMIT 6""")
def planning_scope(spark, sf_dir):
    t = directory(spark, sf_dir, "places", "businesses")
    return planner.scope(t["places"].drop("id"), t["businesses"].select(F.col("city_name").alias("city")), provinces=("asia", "Europe"), most=6)


@query(f"WITH {ctes('sources')} SELECT kind, count(*) AS sources, count(*) FILTER (enabled) AS enabled, count(*) FILTER (requires_key) AS need_key FROM sources GROUP BY 1")
def registry_summary(spark, sf_dir):
    return stats.registry_summary(directory(spark, sf_dir, "sources")["sources"])


@query(f"""WITH {ctes("businesses", "phones", "source_observations")}, b AS (SELECT * FROM businesses)
SELECT 'totals' AS section, 'businesses' AS value, count(*) FILTER (status <> 'MERGED') AS n FROM b UNION ALL SELECT 'totals', 'phones', (SELECT count(*) FROM phones) UNION ALL SELECT 'totals', 'observations', (SELECT count(*) FROM source_observations)
UNION ALL SELECT 'totals', 'due', (SELECT count(*) FROM phones WHERE next_check_at IS NULL OR next_check_at <= TIMESTAMP {NOW})
UNION ALL SELECT 'status', status, count(*) FROM b GROUP BY 2 UNION ALL SELECT 'confidence_band', confidence_band, count(*) FROM b GROUP BY 2 UNION ALL SELECT 'phone_status', status, count(*) FROM phones GROUP BY 2
UNION ALL SELECT 'phone_type', type, count(*) FROM phones GROUP BY 2""")
def full_statistics(spark, sf_dir):
    t = directory(spark, sf_dir, "businesses", "phones", "source_observations")
    return stats.full_stats(t["businesses"], t["phones"], t["source_observations"], _now())


# ---- writes


_SEEN = "SELECT concat('+98', substr({n}, 2)) AS e164, {n} AS national, 'MOBILE' AS type, CAST(NULL AS STRING) AS area_code, CAST(NULL AS STRING) AS subscriber, false AS is_synthetic FROM {{customer}} WHERE c_custkey % 4 = 1"


def _seen(customer: str, shift: int) -> str:
    from quarryline.directory import NATIONAL

    return _SEEN.format(n=NATIONAL.replace("c_custkey", f"(c_custkey + {shift})")).format(customer=customer)


@query(f"""WITH {ctes("phones")}, seen AS ({_seen("customer", 500)}), one AS (SELECT DISTINCT e164, national FROM seen)
SELECT coalesce(p.e164, s.e164) AS e164, CASE WHEN p.e164 IS NULL THEN 'MOBILE' WHEN p.type = 'UNKNOWN' AND s.e164 IS NOT NULL THEN 'MOBILE' ELSE p.type END AS type, coalesce(p.status, 'UNVERIFIED') AS status, coalesce(p.confidence, 0) AS confidence,
 p.e164 IS NULL AS added, coalesce(p.last_seen_at <> TIMESTAMP {NOW} AND s.e164 IS NOT NULL, false) AS seen_again FROM (SELECT DISTINCT ON (e164) * FROM phones ORDER BY e164, id) p FULL JOIN one s ON p.e164 = s.e164""")
def upserted_phones(spark, sf_dir):
    old = directory(spark, sf_dir, "phones")["phones"]
    old = old.groupBy("e164").agg(F.min_by(F.struct(*[c for c in old.columns if c != "e164"]), "id").alias("x")).select("e164", "x.*")
    seen = spark.sql(_seen(f"parquet.`{sf_dir}/customer.parquet`", 500))
    new = upsert.upsert_phones(old, seen, _now())
    both = new.join(old.select("e164", F.col("last_seen_at").alias("was")), "e164", "left")
    return both.select("e164", "type", "status", "confidence", F.col("was").isNull().alias("added"), F.coalesce((F.col("was") != F.col("last_seen_at")), F.lit(False)).alias("seen_again"))


@query(f"""WITH {ctes("source_observations")}, arrived AS (SELECT concat('h', CAST(o_orderkey * 2 AS VARCHAR)) AS dedupe_hash, o_orderkey FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(o.dedupe_hash, a.dedupe_hash) AS dedupe_hash, coalesce(o.page_title, concat('New ', CAST(a.o_orderkey AS VARCHAR))) AS page_title, CASE WHEN a.dedupe_hash IS NOT NULL THEN TIMESTAMP {NOW} ELSE o.observed_at END AS observed_at
FROM source_observations o FULL JOIN arrived a ON a.dedupe_hash = o.dedupe_hash""")
def inserted_observations(spark, sf_dir):
    old = directory(spark, sf_dir, "source_observations")["source_observations"].select("dedupe_hash", "page_title", "observed_at")
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").selectExpr("concat('h', o_orderkey * 2) AS dedupe_hash", "concat('New ', o_orderkey) AS page_title", "o_orderdate AS observed_at")
    return upsert.insert_observations(old, o.unionByName(o.where("page_title < 'New 3'")), _now())


@query(f"""WITH {ctes("business_phones")}, arrived AS (SELECT o_custkey AS business_id, o_orderkey % 40 AS phone_id, o_orderkey AS arrival FROM orders),
a AS (SELECT business_id, phone_id, min(arrival) AS arrival FROM arrived GROUP BY 1, 2), fresh AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM business_phones l WHERE l.business_id = a.business_id AND l.phone_id = a.phone_id)),
made AS (SELECT business_id, phone_id, business_id NOT IN (SELECT business_id FROM business_phones) AND row_number() OVER (PARTITION BY business_id ORDER BY arrival, phone_id) = 1 AS is_primary FROM fresh)
SELECT business_id, phone_id, is_primary, false AS seen_now FROM made UNION ALL SELECT business_id, phone_id, is_primary, (business_id, phone_id) IN (SELECT (business_id, phone_id) FROM a) FROM business_phones""")
def linked_phones(spark, sf_dir):
    links = directory(spark, sf_dir, "business_phones")["business_phones"]
    arrived = table(spark, sf_dir, "orders").selectExpr("o_custkey AS business_id", "o_orderkey % 40 AS phone_id", "'main' AS label", "o_orderkey AS arrival")
    new = upsert.link_phones(links, arrived, _now())
    return new.select("business_id", "phone_id", "is_primary", ((F.col("last_seen_at") == _now()) & (F.col("first_seen_at") != _now())).alias("seen_now"))


@query(f"""WITH {ctes("businesses")}, g AS (SELECT c_custkey AS cid, c_custkey % 23 = 0 AS is_spam, CAST(c_custkey % 60 AS INT) AS relevance, c_custkey % 5 = 0 AS no_phone, c_custkey % 2 = 0 AS no_site FROM customer)
SELECT cid, CASE WHEN is_spam THEN 'drop' WHEN relevance < 30 THEN 'evidence' WHEN no_phone AND no_site THEN 'skip' ELSE 'keep' END AS fate FROM g""")
def gated_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS cid", "c_custkey % 23 = 0 AS is_spam", "CAST(c_custkey % 60 AS INT) AS relevance", "if(c_custkey % 5 = 0, array(), array('+98912')) AS phones", "if(c_custkey % 2 = 0, null, 'http://a.ir') AS website"
    )
    return upsert.gate(c).select("cid", "fate")


_CANDIDATES = """c AS (SELECT o_orderkey AS cid, o_orderkey AS arrival, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('Shop', CAST(o_custkey AS VARCHAR)) END AS name, concat('City', CAST(o_custkey % 7 AS VARCHAR)) AS city,
 o_custkey AS business_id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS address, CASE o_orderkey % 3 WHEN 0 THEN 'HYGIENE' ELSE 'COSMETIC' END AS category, CAST(o_orderkey % 90 AS INT) AS relevance,
 CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 80 END AS location_confidence FROM orders)"""


@query(f"""WITH {_CANDIDATES}, f AS (SELECT business_id, min(CASE WHEN name IS NOT NULL THEN name END) AS name, arg_min(address, arrival) FILTER (address IS NOT NULL) AS address, min(city) AS city,
 string_agg(DISTINCT category, ',' ORDER BY category) AS categories, max(relevance) AS relevance, min(location_confidence) AS location_confidence, count(*) AS seen FROM c GROUP BY 1),
x AS (SELECT c.business_id, bool_or(regexp_replace(lower(c.address), '[^a-z0-9_]', '', 'g') <> regexp_replace(lower(f.address), '[^a-z0-9_]', '', 'g')
 AND NOT contains(regexp_replace(lower(c.address), '[^a-z0-9_]', '', 'g'), regexp_replace(lower(f.address), '[^a-z0-9_]', '', 'g')) AND NOT contains(regexp_replace(lower(f.address), '[^a-z0-9_]', '', 'g'), regexp_replace(lower(c.address), '[^a-z0-9_]', '', 'g'))) AS differs
 FROM c JOIN f USING (business_id) WHERE c.address IS NOT NULL GROUP BY 1)
SELECT f.business_id, f.name, f.address, f.categories, f.relevance, f.seen, CASE WHEN f.address IS NULL THEN 'NOT_FOUND' WHEN coalesce(x.differs, false) THEN 'CONFLICTED' ELSE 'FOUND' END AS address_state,
 CASE WHEN f.location_confidence <= 20 THEN 'UNVERIFIED' ELSE 'FOUND' END AS city_state FROM f LEFT JOIN x USING (business_id)""")
def folded_businesses(spark, sf_dir):
    none = F.lit(None).cast("string")
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS cid", "o_orderkey AS arrival", "if(o_orderkey % 4 = 0, null, concat('Shop', o_custkey)) AS name", "concat('City', o_custkey % 7) AS city", "o_custkey AS business_id",
        "if(o_orderstatus = 'F', o_orderpriority, null) AS address", "array(if(o_orderkey % 3 = 0, 'HYGIENE', 'COSMETIC')) AS categories", "CAST(o_orderkey % 90 AS INT) AS relevance", "if(o_orderkey % 2 = 0, 20, 80) AS location_confidence",
    ).withColumns({c: none for c in ("owner_name", "province", "county", "website", "domain", "description", "business_type")})
    got = upsert.fold_businesses(o)
    return got.select("business_id", "name", "address", F.array_join("categories", ",").alias("categories"), "relevance", "seen", F.col("field_status")["address"].alias("address_state"), F.col("field_status")["city"].alias("city_state"))


_KNOWN = "SELECT c_custkey AS id, concat('Shop ', CAST(c_custkey AS STRING)) AS name, concat('City', CAST(c_custkey % 7 AS STRING)) AS city, concat('+98912', lpad(CAST(c_custkey AS STRING), 7, '0')) AS e164 FROM {customer} WHERE c_custkey % 2 = 0"


@query("""WITH k AS (""" + _KNOWN.format(customer="customer") + """), c AS (SELECT c_custkey AS cid, CASE c_custkey % 3 WHEN 0 THEN concat('shop ', CAST(c_custkey AS VARCHAR)) ELSE concat('Other ', CAST(c_custkey AS VARCHAR)) END AS name FROM customer)
SELECT cid, CASE WHEN cid % 2 = 0 AND cid % 3 = 0 THEN cid ELSE -1 END AS known, count(*) OVER (PARTITION BY cid) AS n FROM c""")
def identified_candidates(spark, sf_dir):
    from quarryline.functions.fingerprint import business_fingerprint

    customer, none = f"parquet.`{sf_dir}/customer.parquet`", F.lit(None).cast("string")
    known = spark.sql(_KNOWN.format(customer=customer))
    # the fingerprints of a half are known, the other half has to be found by a phone and an equal name
    printed = known.withColumn("fingerprint", F.when(F.col("id") % 4 == 0, business_fingerprint("name", "city", none, none)).otherwise(F.lit("none")))
    c = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS cid", "c_custkey AS arrival", "concat(if(c_custkey % 3 = 0, 'shop ', 'Other '), c_custkey) AS name", "concat('City', c_custkey % 7) AS city", "CAST(null AS STRING) AS domain",
        "array(concat('+98912', lpad(c_custkey, 7, '0'))) AS phones",
    )
    got = upsert.identify(c, printed.select("id", "fingerprint", "name", "city"), known.select("id", "e164"))
    ids = known.select(F.col("id").alias("business_id"), F.col("id").alias("known"))
    return got.join(ids, "business_id", "left").groupBy("cid").agg(F.coalesce(F.max("known"), F.lit(-1).cast("bigint")).alias("known"), F.count("*").alias("n"))


@query(f"""WITH {ctes("businesses", "business_phones")} SELECT 'businesses' AS name, count(*) AS n FROM businesses WHERE NOT is_synthetic
UNION ALL SELECT 'business_phones', count(*) FROM business_phones WHERE business_id NOT IN (SELECT id FROM businesses WHERE is_synthetic)""")
def purged_tables(spark, sf_dir):
    t = directory(spark, sf_dir, "businesses", "business_phones")
    got = upsert.purge_businesses(t, t["businesses"].where("is_synthetic"))
    return got["businesses"].select(F.lit("businesses").alias("name")).unionByName(got["business_phones"].select(F.lit("business_phones").alias("name"))).groupBy("name").agg(F.count("*").alias("n"))


@query(f"WITH {ctes('phones')}, top AS (SELECT id FROM phones ORDER BY confidence DESC, id LIMIT 25) SELECT id, CASE WHEN id IN (SELECT id FROM top) THEN TIMESTAMP {NOW} ELSE next_check_at END AS next_check_at FROM phones")
def expired_phones(spark, sf_dir):
    return upsert.expire(directory(spark, sf_dir, "phones")["phones"], 25, _now()).select("id", "next_check_at")


@query(f"WITH {ctes('phones')} SELECT id FROM phones WHERE next_check_at IS NULL OR next_check_at <= TIMESTAMP {NOW} ORDER BY confidence DESC, id LIMIT 70")
def due_phones(spark, sf_dir):
    return revalidate.due_phones(directory(spark, sf_dir, "phones")["phones"], _now(), 70).select("id")


@query(f"""WITH {ctes("businesses", "business_phones", "source_observations")}, m AS (SELECT id, id - id % 3 AS canonical FROM businesses), l AS (SELECT l.id, coalesce(m.canonical, l.business_id) AS business_id, l.phone_id FROM business_phones l LEFT JOIN m ON m.id = l.business_id)
SELECT b.id, CASE WHEN b.id % 3 <> 0 THEN 'MERGED' ELSE b.status END AS status, CASE WHEN b.id % 3 <> 0 THEN b.id - b.id % 3 ELSE -1 END AS merged_into,
 CASE WHEN b.id % 3 = 0 THEN (SELECT max(x.relevance_score) FROM businesses x WHERE x.id - x.id % 3 = b.id) ELSE b.relevance_score END AS relevance_score,
 CASE WHEN b.id % 3 = 0 AND b.owner_name = 'NOT_FOUND' THEN coalesce((SELECT arg_min(x.owner_name, x.id) FROM businesses x WHERE x.id - x.id % 3 = b.id AND x.owner_name <> 'NOT_FOUND'), 'NOT_FOUND') ELSE b.owner_name END AS owner_name,
 (SELECT count(*) FROM (SELECT DISTINCT business_id, phone_id FROM l) d WHERE d.business_id = b.id) AS links, (SELECT count(*) FROM source_observations o WHERE o.business_id IS NOT NULL AND o.business_id - o.business_id % 3 = b.id AND b.id % 3 = 0) AS evidence
FROM businesses b""")
def merged_businesses(spark, sf_dir):
    t = directory(spark, sf_dir, "businesses", "business_phones", "source_observations")
    out = dedup.merge(t, t["businesses"].select("id", (F.col("id") - F.col("id") % 3).alias("canonical")))
    n = lambda name, as_: out[name].groupBy(F.col("business_id").alias("id")).agg(F.count("*").alias(as_))
    got = out["businesses"].join(n("business_phones", "links"), "id", "left").join(n("source_observations", "evidence"), "id", "left").fillna(0, ["links", "evidence"])
    return got.select("id", "status", F.coalesce("merged_into", F.lit(-1).cast("bigint")).alias("merged_into"), "relevance_score", "owner_name", "links", "evidence")


@query("""WITH r AS (SELECT s_suppkey AS id, concat('shop ', CAST(s_suppkey % 40 AS VARCHAR)) AS name, concat('town ', CAST(s_nationkey % 3 AS VARCHAR)) AS city, (s_suppkey * 7919 % 101) AS confidence FROM supplier)
SELECT id, first_value(id) OVER (PARTITION BY name, city ORDER BY confidence DESC, id) AS canonical FROM r QUALIFY count(*) OVER (PARTITION BY name, city) > 1""")
def merged_clusters(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "concat('shop ', s_suppkey % 40) AS name", "concat('town ', s_nationkey % 3) AS city", "s_suppkey * 7919 % 101 AS confidence", "1 AS completeness")
    rows = rows.withColumns({"address": none, "domain": none, "phones": F.array().cast("array<string>")})
    members, _ = dedup.clusters(rows)
    return members


@query("""WITH r AS (SELECT s_suppkey AS id, concat('shop ', CAST(s_suppkey % 40 AS VARCHAR)) AS name, concat('town ', CAST(s_nationkey % 3 AS VARCHAR)) AS city, (s_suppkey * 7919 % 101) AS confidence FROM supplier),
m AS (SELECT id, first_value(id) OVER (PARTITION BY name, city ORDER BY confidence DESC, id) AS canonical FROM r QUALIFY count(*) OVER (PARTITION BY name, city) > 1)
SELECT canonical AS canonical_id, id AS merged_id, 0.9 AS score FROM m WHERE id <> canonical""".replace("0.9 AS score", "0.88::DOUBLE AS score"))
def duplicate_log(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "concat('shop ', s_suppkey % 40) AS name", "concat('town ', s_nationkey % 3) AS city", "s_suppkey * 7919 % 101 AS confidence", "1 AS completeness")
    rows = rows.withColumns({"address": none, "domain": none, "phones": F.array().cast("array<string>")})
    return dedup.duplicate_log(rows, _now()).select("canonical_id", "merged_id", "score")


@query("""WITH r AS (SELECT s_suppkey AS id, concat('shop ', CAST(s_suppkey % 40 AS VARCHAR)) AS name, concat('town ', CAST(s_nationkey % 3 AS VARCHAR)) AS city, (s_suppkey * 7919 % 101) AS confidence FROM supplier),
m AS (SELECT id, first_value(id) OVER (PARTITION BY name, city ORDER BY confidence DESC, id) AS canonical FROM r QUALIFY count(*) OVER (PARTITION BY name, city) > 1), g AS (SELECT id FROM m WHERE id <> canonical)
SELECT 'total' AS what, count(*) AS n FROM g UNION ALL SELECT 'newest', id FROM (SELECT id FROM g ORDER BY id DESC LIMIT 10)""")
def duplicate_totals(spark, sf_dir):
    """How many records merged, and the ten that merged last."""
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "concat('shop ', s_suppkey % 40) AS name", "concat('town ', s_nationkey % 3) AS city", "s_suppkey * 7919 % 101 AS confidence", "1 AS completeness")
    total, newest = dedup.dedup_stats(dedup.duplicate_log(rows.withColumns({"address": none, "domain": none, "phones": F.array().cast("array<string>")}), _now()))
    return total.select(F.lit("total").alias("what"), F.col("total").alias("n")).unionByName(newest.select(F.lit("newest").alias("what"), F.col("merged_id").alias("n")))


@query("""SELECT query_text, 'A' AS source_key, 1 AS page FROM (SELECT DISTINCT 'q ' || p_name AS query_text, min(p_partkey) OVER (PARTITION BY p_name) AS ordinal FROM part) ORDER BY ordinal, query_text LIMIT 25""")
def budgeted_admission(spark, sf_dir):
    """A round that may ask for 25 queries asks for the first of those that the ledger admits."""
    tasks = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("q "), "p_name").alias("query_text")).agg(F.min("p_partkey").alias("ordinal"))
    sources = spark.createDataFrame([("A", 1), ("B", 2)], "source_key string, turn int")
    ledger = spark.createDataFrame([], "source_key string, query_hash string, state string, depth int, run_count int, new_results int, last_run_at timestamp, next_run_at timestamp")
    return planner.admit(tasks, sources, ledger, _now(), budget=25).select("query_text", "source_key", "page")


@query("SELECT 'q ' || p_name AS query_text, count(*) AS n, true AS same FROM part GROUP BY 1")
def shuffled_tasks(spark, sf_dir):
    """Tasks in an order that a seed decides: all are there, each seed gives one order however the tasks are dealt, and no other seed's."""
    tasks = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("q "), "p_name").alias("query_text")).agg(F.count("*").alias("n"))
    one, again, other = (planner.shuffled(x, seed).select("query_text", F.col("ordinal").alias(name)) for x, seed, name in ((tasks, 7, "a"), (tasks.repartition(5), 7, "b"), (tasks, 8, "c")))
    return tasks.join(one, "query_text").join(again, "query_text").join(other, "query_text").select("query_text", "n", ((F.col("a") == F.col("b")) & (F.col("a") != F.col("c"))).alias("same"))


# ---- planning, queue and jobs

_RUNS = "runs AS (SELECT concat('S', CAST(o_custkey % 4 AS STRING)) AS source_key, CAST(o_orderkey AS STRING) AS query_hash, CAST(o_orderkey % 3 + 1 AS INT) AS page, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'FAILED' ELSE 'BLOCKED' END AS outcome, 5 AS results, CAST(o_orderkey % 2 * 3 AS INT) AS found FROM {orders} WHERE o_orderkey % 3 = 0)"
_OLD = "old AS (SELECT concat('S', CAST(o_custkey % 4 AS STRING)) AS source_key, CAST(o_orderkey AS STRING) AS query_hash, 'DONE' AS state, 1 AS depth, 2 AS run_count, 4 AS new_results, 9 AS results_seen, CAST(o_orderkey % 5 AS INT) AS failures, o_orderdate AS last_run_at, o_orderdate AS next_run_at FROM {orders} WHERE o_orderkey % 2 = 0)"


@query(f"""WITH {_RUNS.format(orders="orders")}, {_OLD.format(orders="orders")}
SELECT source_key, query_hash, CASE WHEN outcome = 'FAILED' THEN 'COOLING' WHEN outcome IS NOT NULL THEN outcome ELSE state END AS state, (coalesce(run_count, 0) + CASE WHEN outcome IS NULL THEN 0 ELSE 1 END)::INT AS run_count,
 (CASE WHEN outcome = 'FAILED' THEN coalesce(failures, 0) + 1 WHEN outcome = 'DONE' THEN 0 ELSE coalesce(failures, 0) END)::INT AS failures, (CASE WHEN outcome = 'DONE' THEN greatest(coalesce(depth, 0), page) ELSE coalesce(depth, 0) END)::INT AS depth,
 CASE WHEN outcome IS NULL THEN next_run_at WHEN outcome = 'FAILED' THEN TIMESTAMP {NOW} + INTERVAL 6 HOUR * (coalesce(failures, 0) + 1) WHEN outcome = 'DONE' AND found = 0 THEN TIMESTAMP {NOW} + INTERVAL 14 DAY END AS next_run_at
FROM old FULL JOIN runs USING (source_key, query_hash)""")
def finalised_ledger(spark, sf_dir):
    source = f"parquet.`{sf_dir}/orders.parquet`"
    old, runs = (spark.sql(f"WITH {x.format(orders=source)} SELECT * FROM {n}") for x, n in ((_OLD, "old"), (_RUNS, "runs")))
    return planner.finalise(old, runs, _now()).select("source_key", "query_hash", "state", "run_count", "failures", "depth", F.col("next_run_at").cast("timestamp_ntz").alias("next_run_at"))


_QUEUE = """queue AS (SELECT event_id AS id, concat('k', CAST(event_id AS STRING)) AS dedupe_key, event_type AS kind, props AS payload, CAST(user_id % 3 AS INT) AS priority, CASE event_id % 5 WHEN 0 THEN 'DONE' WHEN 1 THEN 'LEASED' WHEN 2 THEN 'DEAD' ELSE 'QUEUED' END AS state,
 CAST(event_id % 4 AS INT) AS attempts, 3 AS max_attempts, ts AS available_at, CASE WHEN event_id % 5 = 1 THEN ts END AS leased_until, CAST(NULL AS STRING) AS error, ts AS created_at, ts AS updated_at FROM {events})"""


def _queue(spark, sf_dir):
    return spark.sql(f"WITH {_QUEUE.format(events=f'parquet.`{sf_dir}/events.parquet`')} SELECT * FROM queue")


@query(f"""WITH {_QUEUE.format(events="events")}, a AS (SELECT DISTINCT concat('k', CAST(event_id * 2 AS VARCHAR)) AS dedupe_key FROM events)
SELECT coalesce(q.dedupe_key, a.dedupe_key) AS dedupe_key, CASE WHEN q.id IS NULL OR (q.state = 'DEAD' AND a.dedupe_key IS NOT NULL) THEN 'QUEUED' ELSE q.state END AS state,
 CASE WHEN q.id IS NULL OR (q.state = 'DEAD' AND a.dedupe_key IS NOT NULL) THEN 0 ELSE q.attempts END AS attempts FROM queue q FULL JOIN a ON a.dedupe_key = q.dedupe_key""")
def enqueued_items(spark, sf_dir):
    arrived = table(spark, sf_dir, "events").selectExpr("concat('k', event_id * 2) AS dedupe_key", "event_type AS kind", "props AS payload", "1 AS priority")
    return queue.enqueue(_queue(spark, sf_dir), arrived.unionByName(arrived), _now()).select("dedupe_key", "state", "attempts")


@query(f"""WITH {_QUEUE.format(events="events")}, t AS (SELECT id FROM queue WHERE (state = 'QUEUED' AND available_at <= TIMESTAMP {NOW}) OR (state = 'LEASED' AND leased_until < TIMESTAMP {NOW}) ORDER BY priority, id LIMIT 80)
SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN 'LEASED' ELSE state END AS state, (attempts + CASE WHEN id IN (SELECT id FROM t) THEN 1 ELSE 0 END)::INT AS attempts, CASE WHEN id IN (SELECT id FROM t) THEN TIMESTAMP {NOW} + INTERVAL 300 SECOND ELSE leased_until END AS leased_until FROM queue""")
def claimed_items(spark, sf_dir):
    return queue.claim(_queue(spark, sf_dir), 80, _now())[1].select("id", "state", "attempts", "leased_until")


@query(f"""WITH {_QUEUE.format(events="events")} SELECT id, CASE WHEN id % 3 = 2 THEN state WHEN id % 3 = 0 THEN 'DONE' WHEN attempts >= 3 THEN 'DEAD' ELSE 'QUEUED' END AS state,
 CASE WHEN id % 3 = 1 AND attempts < 3 THEN TIMESTAMP {NOW} + INTERVAL 1 SECOND * (30 * 2 ** (greatest(attempts, 1) - 1))::INT ELSE available_at END AS available_at FROM queue""")
def settled_items(spark, sf_dir):
    outcomes = table(spark, sf_dir, "events").where("event_id % 3 < 2").selectExpr("event_id AS id", "event_id % 3 = 0 AS ok", "'why' AS message")
    return queue.settle(_queue(spark, sf_dir), outcomes, _now()).select("id", "state", F.col("available_at").cast("timestamp_ntz").alias("available_at"))


@query(f"""WITH {_QUEUE.format(events="events")} SELECT id, CASE WHEN state = 'LEASED' AND leased_until < TIMESTAMP {NOW} THEN 'QUEUED' ELSE state END AS state FROM queue WHERE NOT (state = 'DONE' AND updated_at < TIMESTAMP {NOW} - INTERVAL 48 HOUR)""")
def released_items(spark, sf_dir):
    return queue.purge_done(queue.release(_queue(spark, sf_dir), _now()), _now()).select("id", "state")


@query(f"WITH {_QUEUE.format(events='events')} SELECT id FROM queue WHERE state = 'DEAD' ORDER BY updated_at DESC, id DESC LIMIT 50")
def dead_letters(spark, sf_dir):
    return queue.dead_letters(_queue(spark, sf_dir)).select("id")


_JOBS = "jobs AS (SELECT CAST(o_orderkey AS BIGINT) AS id, 'discover' AS kind, 'j' AS name, CASE o_orderstatus WHEN 'F' THEN 'RUNNING' WHEN 'O' THEN 'PENDING' ELSE 'DONE' END AS status, 'p' AS params, CAST(10 AS BIGINT) AS target, 0.0 AS progress, false AS cancel_requested, CAST(NULL AS STRING) AS error, o_orderdate AS heartbeat_at, o_orderdate AS created_at, o_orderdate AS updated_at FROM {orders})"


def _jobs(spark, sf_dir):
    return spark.sql(f"WITH {_JOBS.format(orders=f'parquet.`{sf_dir}/orders.parquet`')} SELECT * FROM jobs").withColumn("progress", F.col("progress").cast("double"))


@query(f"""WITH {_JOBS.format(orders="orders")} SELECT id, CASE WHEN status = 'RUNNING' AND heartbeat_at < TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 30 MINUTE THEN 'FAILED' WHEN id = 7 AND status = 'PENDING' THEN 'CANCELLED' ELSE status END AS status,
 id = 7 AND status IN ('PENDING', 'RUNNING') AS cancel_requested, CASE WHEN id = 9 THEN 0.25 ELSE 0 END::DOUBLE AS progress FROM jobs
UNION ALL SELECT -1, 'PENDING', false, 0.0""")
def job_states(spark, sf_dir):
    at = F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")
    rows, _ = jobs.stale(jobs.cancelled(_jobs(spark, sf_dir), 7), at)
    rows = jobs.created(jobs.progressed(rows, 9, 5, 20, at), "discover", "{}", 10, at)
    return rows.select(F.when(F.col("params") == "{}", -1).otherwise(F.col("id")).cast("bigint").alias("id"), "status", "cancel_requested", "progress")


@query(f"WITH {_JOBS.format(orders='orders')} SELECT id AS job_id, 'ERROR' AS level, 'STALE' AS event FROM jobs WHERE status = 'RUNNING' AND heartbeat_at < TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 30 MINUTE")
def job_events(spark, sf_dir):
    return jobs.stale(_jobs(spark, sf_dir), F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'"))[1].select("job_id", "level", "event")


# ---- exports


_EXPORT = f"""kept AS (SELECT * FROM businesses WHERE {_LISTED} ORDER BY confidence DESC, id LIMIT 60),
p AS (SELECT business_id, string_agg(e164, ', ' ORDER BY is_primary DESC, l.confidence DESC, l.phone_id) FILTER (type = 'LANDLINE') AS landline, string_agg(e164, ', ' ORDER BY is_primary DESC, l.confidence DESC, l.phone_id) FILTER (type = 'MOBILE') AS mobile
 FROM business_phones l JOIN phones p ON p.id = l.phone_id GROUP BY 1),
e AS (SELECT business_id, string_agg(DISTINCT key, ', ' ORDER BY key) AS source_keys, arg_min(url, k) AS first_url FROM (SELECT o.business_id, o.url, s.key, row_number() OVER (PARTITION BY business_id ORDER BY observed_at DESC, o.id DESC) AS k
 FROM source_observations o JOIN sources s ON s.id = o.source_id WHERE business_id IS NOT NULL) WHERE k <= 50 GROUP BY 1)"""


def _export_tables(spark, sf_dir):
    t = directory(spark, sf_dir, "businesses", "business_phones", "phones", "source_observations", "sources")
    return t | {"businesses": t["businesses"].withColumn("field_status", F.create_map(F.lit("owner_name"), F.when(F.col("owner_name") == "NOT_FOUND", "NOT_FOUND").otherwise("FOUND")))}


_EXPORTED = """SELECT b.id, b.name, CASE WHEN owner_name = 'NOT_FOUND' THEN 'NOT_FOUND' ELSE 'FOUND' END AS owner_status, coalesce(landline, 'NOT_FOUND') AS primary_phone, coalesce(mobile, 'NOT_FOUND') AS mobile_phone,
 array_to_string(categories, ', ') AS categories, coalesce(source_keys, '') AS source_keys, coalesce(first_url, 'NOT_FOUND') AS first_evidence_url, strftime(discovered_at, '%Y-%m-%dT%H:%M:%S') AS discovered_at FROM kept b LEFT JOIN p ON p.business_id = b.id LEFT JOIN e ON e.business_id = b.id"""
_EXPORT_COLUMNS = ("id", "name", "owner_status", "primary_phone", "mobile_phone", "categories", "source_keys", "first_evidence_url", "discovered_at")


@query(f"WITH {ctes('businesses', 'business_phones', 'phones', 'source_observations', 'sources')}, {_EXPORT} {_EXPORTED}")
def exported_businesses(spark, sf_dir):
    return export.rows(_export_tables(spark, sf_dir), BusinessFilter(limit=60)).select(*_EXPORT_COLUMNS)


@query(f"WITH {ctes('businesses', 'business_phones', 'phones', 'source_observations', 'sources')}, {_EXPORT} {_EXPORTED}")
def exported_csv(spark, sf_dir):
    """Written as CSV and read back."""
    from quarryline.operators.components import shared_path

    path = shared_path(spark, "export")
    export.write_csv(export.rows(_export_tables(spark, sf_dir), BusinessFilter(limit=60)).select(*_EXPORT_COLUMNS), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.toDF(*_EXPORT_COLUMNS).withColumns({"id": F.col("id").cast("bigint"), "source_keys": F.coalesce("source_keys", F.lit(""))})


@query(f"WITH {ctes('businesses', 'business_phones', 'phones', 'source_observations', 'sources')}, {_EXPORT} {_EXPORTED}")
def exported_json(spark, sf_dir):
    """Written as JSON lines and read back."""
    from quarryline.operators.components import shared_path

    path = shared_path(spark, "export")
    rows = export.rows(_export_tables(spark, sf_dir), BusinessFilter(limit=60)).select(*_EXPORT_COLUMNS)
    export.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query(f"WITH {ctes('businesses', 'business_phones', 'phones', 'source_observations', 'sources')}, {_EXPORT.replace(' ORDER BY confidence DESC, id LIMIT 60', '')} {_EXPORTED}")
def exported_whole(spark, sf_dir):
    return export.rows(_export_tables(spark, sf_dir), BusinessFilter(limit=None)).select(*_EXPORT_COLUMNS)


@query(f"""WITH {ctes("businesses", "source_observations", "sources")} SELECT b.id AS business_id, b.name, s.key AS source_key, o.url, o.page_title, o.snippet, strftime(o.observed_at, '%Y-%m-%dT%H:%M:%S') AS observed_at
FROM source_observations o JOIN businesses b ON b.id = o.business_id JOIN sources s ON s.id = o.source_id WHERE NOT is_synthetic AND b.status IN ('ACTIVE', 'QUARANTINED') AND b.confidence >= 50""")
def exported_evidence(spark, sf_dir):
    return export.evidence_rows(_export_tables(spark, sf_dir), BusinessFilter(min_confidence=50))


@query(f"""WITH {ctes("businesses", "business_phones")} SELECT id, (SELECT count(*) FROM business_phones l WHERE l.business_id = b.id) AS phones FROM businesses b WHERE {_LISTED} ORDER BY confidence DESC, id LIMIT 25""")
def exported_api_rows(spark, sf_dir):
    got = export.api_rows(_export_tables(spark, sf_dir), BusinessFilter(limit=25))
    return got.select("id", F.when(F.col("phones_detail").isNull(), 0).otherwise(F.size("phones_detail")).cast("bigint").alias("phones"))


# ---- sources

@query("""WITH x AS (SELECT *, count(*) FILTER (value >= 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events), s AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS streak FROM x WHERE value < 50)
SELECT user_id, max(ts) + INTERVAL 120 SECOND AS blocked_until FROM s WHERE streak % 5 = 0 GROUP BY 1 HAVING max(ts) + INTERVAL 120 SECOND > TIMESTAMP '2024-01-05 00:00:00'""")
def blocked_domains(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("failed", F.col("value") < 50)
    return politeness.blocked(e, "user_id", "ts", ["ts", "event_id"], "failed", F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'"))


@query(f"""WITH c AS (SELECT concat('http://a.ir/', CAST(event_id AS VARCHAR)) AS url, event_id % 2 = 0 AS ok_status, ts + INTERVAL 150 DAY AS expires_at FROM events WHERE event_id % 3 = 0)
SELECT concat('http://a.ir/', CAST(event_id AS VARCHAR)) AS url, coalesce(event_id % 3 = 0 AND event_id % 2 = 0 AND ts + INTERVAL 150 DAY >= TIMESTAMP {NOW}, false) AS ok FROM events""")
def cached_answers(spark, sf_dir):
    from quarryline.functions.urls import url_hash_key

    e = table(spark, sf_dir, "events").withColumn("url", F.concat(F.lit("http://a.ir/"), F.col("event_id").cast("string")))
    cache = e.where("event_id % 3 = 0").select(url_hash_key("url").alias("url_hash"), F.when(F.col("event_id") % 2 == 0, 200).otherwise(404).alias("status"), F.lit("x").alias("body"), (F.col("ts") + F.expr("INTERVAL 150 DAYS")).alias("expires_at"))
    return politeness.cache_read(e.select("url"), cache, _now()).select("url", "ok")


@query(f"""SELECT concat('http://a.ir/', CAST(event_id AS VARCHAR)) AS url, event_id % 2 = 0 AS fresh FROM events WHERE event_id % 2 = 0 OR (event_id % 3 = 0 AND ts + INTERVAL 150 DAY >= TIMESTAMP {NOW})""")
def cache_after_writes(spark, sf_dir):
    from quarryline.functions.urls import url_hash_key

    e = table(spark, sf_dir, "events").withColumn("url", F.concat(F.lit("http://a.ir/"), F.col("event_id").cast("string")))
    cache = e.where("event_id % 3 = 0").select(
        url_hash_key("url").alias("url_hash"), "url", F.lit(200).alias("status"), F.lit("html").alias("content_type"), F.lit("old").alias("body"), F.col("ts").alias("fetched_at"), (F.col("ts") + F.expr("INTERVAL 150 DAYS")).alias("expires_at")
    )
    answers = e.where("event_id % 2 = 0").select("url", F.lit(200).alias("status"), F.lit("html").alias("content_type"), F.lit("new").alias("body"))
    return politeness.cache_write(cache, answers.unionByName(answers), _now()).select("url", (F.col("body") == "new").alias("fresh"))


def _api_answers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = F.struct(F.concat(F.lit("http://s.ir/"), F.col("p_partkey").cast("string")).alias("u"), F.col("p_name").alias("t"), F.col("p_type").alias("s"))
    made = None
    for key, (path, names) in {"BING_API": ("webPages.value", ("url", "name", "snippet")), "GOOGLE_CSE": ("items", ("link", "title", "snippet")), "SERPAPI": ("organic_results", ("link", "title", "snippet")), "SEARX": ("results", ("url", "title", "content"))}.items():
        item = F.struct(one["u"].alias(names[0]), one["t"].alias(names[1]), one["s"].alias(names[2]))
        outer, _, inner = path.partition(".")
        listed = F.array(item, item)
        body = F.to_json(F.struct((F.struct(listed.alias(inner)) if inner else listed).alias(outer)))
        part = search.api_items(p.select("p_partkey", body.alias("body")), key).withColumn("source", F.lit(key))
        made = part if made is None else made.unionByName(part)
    return made


@query("""SELECT p_partkey, source, rank, concat('http://s.ir/', CAST(p_partkey AS VARCHAR)) AS url, p_name AS title, p_type AS snippet FROM part, (VALUES ('BING_API'), ('GOOGLE_CSE'), ('SERPAPI'), ('SEARX')) s(source), (VALUES (1), (2)) r(rank)""")
def api_result_items(spark, sf_dir):
    return _api_answers(spark, sf_dir).select("p_partkey", "source", "rank", "url", "title", "snippet")


@query("""SELECT p_partkey, concat('http://s.ir/', CAST(p_partkey AS VARCHAR)) AS url, p_name AS title, p_type AS snippet, engine FROM part, (VALUES ('DUCKDUCKGO'), ('BING_HTML'), ('MOJEEK')) e(engine)""")
def html_result_items(spark, sf_dir):
    # pages take long to read, so they are dealt to all tasks, however few files the parts are in
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")).withColumn("u", F.concat(F.lit("http://s.ir/"), F.col("p_partkey").cast("string")))
    shapes = {
        "DUCKDUCKGO": ("<div class='result'><a class='result__a' href='", "'>", "</a><a class='result__snippet'>", "</a></div>"),
        "BING_HTML": ("<ol><li class='b_algo'><h2><a href='", "'>", "</a></h2><div class='b_caption'><p>", "</p></div></li></ol>"),
        "MOJEEK": ("<ul class='results-standard'><li><a class='other' href='x'>no</a><h2><a class='title' href='", "'>", "</a></h2><p class='s'>", "</p></li></ul>"),
    }
    out = None
    for engine, (a, b, c, d) in shapes.items():
        body = F.concat(F.lit("<html><div class='s'>noise</div>" + a), "u", F.lit(b), "p_name", F.lit(c), "p_type", F.lit(d))
        rows = p.select("p_partkey", F.explode(search.html_items(body, engine)).alias("x")).select("p_partkey", search.unwrapped("x.url").alias("url"), "x.title", "x.snippet", F.lit(engine).alias("engine"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN concat('http://a.ir/', n_nationkey) WHEN 1 THEN concat('https://b.ir/', n_nationkey) WHEN 2 THEN concat('https://c.ir/?q=', n_nationkey) ELSE concat('http://d.ir/', n_nationkey) END AS url FROM nation""")
def unwrapped_links(spark, sf_dir):
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "CASE n_nationkey % 4 WHEN 0 THEN concat('http://a.ir/', n_nationkey) WHEN 1 THEN concat('//b.ir/', n_nationkey) WHEN 2 THEN concat('/l/?uddg=https%3A%2F%2Fc.ir%2F%3Fq%3D', n_nationkey, '&rut=9') ELSE concat('http://d.ir/', n_nationkey) END AS u")
    return n.select("n_nationkey", search.unwrapped("u").alias("url"))


@query("SELECT s_suppkey, 1 AS rank, s_name AS name, concat('021', lpad(CAST(s_suppkey AS VARCHAR), 8, '4')) AS phone, concat('Road ', CAST(s_nationkey AS VARCHAR)) AS address, concat('https://www.openstreetmap.org/node/', CAST(s_suppkey AS VARCHAR)) AS url FROM supplier WHERE s_suppkey % 3 <> 0")
def open_map_items(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    phone = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("021"), F.lpad(F.col("s_suppkey").cast("string"), 8, "4")))
    tags = F.create_map(F.lit("name"), "s_name", F.lit("contact:phone"), phone, F.lit("addr:street"), F.lit("Road"), F.lit("addr:housenumber"), F.col("s_nationkey").cast("string"))
    body = F.to_json(F.struct(F.array(F.struct(F.col("s_suppkey").alias("id"), F.lit("node").alias("type"), tags.alias("tags"))).alias("elements")))
    return search.overpass_items(s.select("s_suppkey", body.alias("body"))).select("s_suppkey", "rank", "name", "phone", "address", "url")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id ELSE page_id - 1 END AS found FROM pages WHERE page_id % 2 = 0 OR page_id - 1 >= 0")
def found_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id")
    stored = p.where("page_id % 2 = 0").select(F.concat(F.lit("http://a.ir/p/"), F.col("page_id").cast("string"), F.lit("/")).alias("url"), F.col("page_id").cast("string").alias("body"))
    wanted = p.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://a.ir/p/"), F.col("page_id").cast("string"), F.lit("/"))).otherwise(F.concat(F.lit("http://other.ir/"), (F.col("page_id") - 1).cast("string"))).alias("url"))
    got = search.find_page(wanted.select("url"), stored)
    return wanted.join(got, "url").select("page_id", F.col("body").cast("bigint").alias("found"))


@query("SELECT concat('site:', d, ' ', s_name) AS query_text, d AS domain FROM supplier, (VALUES ('a.ir'), ('b.ir')) x(d)")
def restricted_queries(spark, sf_dir):
    tasks = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("query_text"))
    return search.restricted_queries(tasks, ["a.ir", "b.ir", "c.ir"], 2)


@query("SELECT * FROM (VALUES ('BING_API', 'SEARCH_ENGINE', 0.85::DOUBLE), ('SEARX', 'SEARCH_ENGINE', 0.65::DOUBLE), ('FIXTURE', 'FIXTURE', 0.70::DOUBLE)) v(key, kind, reliability)")
def resolved_sources(spark, sf_dir):
    return search.resolve(search.registry(spark), ("BING_API", "GOOGLE_CSE", "SEARX", "FIXTURE", "NOPE"), keys=("BING_API",)).select("key", "kind", "reliability")


@query("SELECT n_nationkey, concat('http://d.ir/?q=a+', n_nationkey, '&p=', n_nationkey % 3) AS url FROM nation")
def directory_urls(spark, sf_dir):
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "'http://d.ir/?q={query}&p={page}' AS template", "concat('a ', n_nationkey) AS q", "n_nationkey % 3 AS page")
    return n.select("n_nationkey", search.directory_url("template", "q", "page").alias("url"))


@query("SELECT n_nationkey, concat(CASE n_nationkey % 4 WHEN 0 THEN 'http://www.ok.ir/' WHEN 1 THEN 'http://notbad.ir/' ELSE 'x' END, n_nationkey) AS url FROM nation WHERE n_nationkey % 4 < 2")
def unblocked_fetches(spark, sf_dir):
    from quarryline.operators.components import shared_path

    path = shared_path(spark, "blocklist")
    spark.range(1).select(F.lit("# a note\n\n bad.ir \nworse.com").alias("value")).write.text(path)
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "concat(CASE n_nationkey % 4 WHEN 0 THEN 'http://www.ok.ir/' WHEN 1 THEN 'http://notbad.ir/' WHEN 2 THEN 'https://shop.bad.ir/' ELSE 'http://bad.ir/' END, n_nationkey) AS url")
    return politeness.unblocked(n, politeness.blocklist(spark, path)).select("n_nationkey", "url")


@query("SELECT p_partkey, p_name AS name, concat('+98912', lpad(CAST(p_partkey AS VARCHAR), 7, '3')) AS phones, 'SEARCH_SNIPPET' AS kind, 45 AS hint FROM part WHERE p_partkey % 2 = 0")
def search_candidates(spark, sf_dir):
    from quarryline.functions import pages

    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_name, ' - ') AS title", "if(p_partkey % 2 = 0, concat('تلفن 0912', lpad(p_partkey, 7, '3')), 'none') AS snippet", "'http://a.ir' AS url")
    return pages.search_candidates(p, "p_partkey").select("p_partkey", "name", F.array_join("phones", ",").alias("phones"), "kind", "hint")


# ---- validation of pairs

_PAIRS = """pairs AS (SELECT l.business_id, l.phone_id, l.id AS link_id, p.e164, p.national, p.type, p.is_synthetic FROM business_phones l JOIN phones p ON p.id = l.phone_id WHERE p.type <> 'UNKNOWN'),
own AS (SELECT business_id, phone_id, avg(source_reliability) AS mean, max(source_reliability) AS top, list_sort(list_distinct(list(source_reliability))) AS kinds, count(*) AS n, count(DISTINCT url_domain) AS domains, max(observed_at) AS newest, bool_or(status = 'SPAM') AS spam
 FROM source_observations WHERE business_id IS NOT NULL AND phone_id IS NOT NULL GROUP BY 1, 2),
whole AS (SELECT business_id, max(source_reliability) AS top, list_sort(list_distinct(list(source_reliability))) AS kinds, count(*) AS n, count(DISTINCT url_domain) AS domains, max(observed_at) AS newest, bool_or(status = 'SPAM') AS spam FROM source_observations WHERE business_id IS NOT NULL GROUP BY 1),
x AS (SELECT p.*, coalesce(o.top, w.top) AS top, coalesce(o.kinds, w.kinds) AS kinds, coalesce(o.n, w.n, 0) AS n, coalesce(o.domains, w.domains, 0) AS domains, coalesce(o.newest, w.newest) AS newest, coalesce(o.spam, w.spam, false) AS spam
 FROM pairs p LEFT JOIN own o USING (business_id, phone_id) LEFT JOIN whole w USING (business_id))"""


@query(f"""WITH {ctes("businesses", "business_phones", "phones", "source_observations")}, {_PAIRS}
SELECT link_id, round(CASE WHEN top IS NULL THEN 0 ELSE 100 * (0.7 * top + 0.3 * list_avg(kinds)) END, 6) AS source, least(100, CASE WHEN domains >= 3 THEN 100 WHEN domains = 2 THEN 70 WHEN domains = 1 THEN 40 ELSE 0 END + CASE WHEN n > domains THEN least(10, 2 * (n - domains)) ELSE 0 END)::DOUBLE AS corroboration,
 (34 + CASE WHEN b.address <> 'NOT_FOUND' THEN 22 ELSE 0 END + CASE WHEN b.website <> 'NOT_FOUND' THEN 12 ELSE 0 END + CASE WHEN b.owner_name <> 'NOT_FOUND' THEN 6 ELSE 0 END + 16 + CASE WHEN b.business_type <> 'UNKNOWN' THEN 10 ELSE 0 END)::DOUBLE AS fields,
 (CASE WHEN coalesce(top, 0) < 0.55 THEN 10 ELSE 0 END + CASE WHEN spam THEN 30 ELSE 0 END + CASE WHEN newest IS NULL THEN 10 ELSE 0 END + CASE WHEN newest < TIMESTAMP {NOW} - INTERVAL 730 DAY THEN 10 ELSE 0 END)::BIGINT AS penalty
FROM x JOIN businesses b ON b.id = x.business_id""")
def evaluated_pairs(spark, sf_dir):
    t = directory(spark, sf_dir, "businesses", "business_phones", "phones", "source_observations")
    p = t["phones"].where("type <> 'UNKNOWN'").select(F.col("id").alias("phone_id"), "e164", "national", "is_synthetic")
    pairs = t["business_phones"].select("business_id", "phone_id", F.col("id").alias("link_id")).join(p, "phone_id")
    b = t["businesses"].select(F.col("id").alias("business_id"), "name", "address", "website", "owner_name", "city_name", F.lit("021").alias("area_code"), "business_type", "relevance_score")
    got = revalidate.evaluate_pairs(pairs, t["source_observations"], b, _now())
    counted = F.filter("penalties", lambda x: ~x["code"].isin("FAKE", "AREA_MISMATCH"))
    return got.select("link_id", F.round("components.source", 6).alias("source"), "components.corroboration", "components.fields", F.aggregate(counted, F.lit(0), lambda a, x: a + x["amount"]).cast("bigint").alias("penalty"))


_EVALUATED = "evaluated AS (SELECT l.id AS link_id, business_id, phone_id, CAST(l.id * 29 % 101 AS INT) AS total FROM {links} l)"
_BANDED = "CASE WHEN total >= 85 THEN 'VERY_HIGH' WHEN total >= 70 THEN 'HIGH' WHEN total >= 45 THEN 'MEDIUM' WHEN total >= 20 THEN 'LOW' ELSE 'INVALID' END"


def _evaluated(tables):
    from quarryline.functions.confidence import band

    rows = tables["business_phones"].selectExpr("id AS link_id", "business_id", "phone_id", "CAST(id * 29 % 101 AS INT) AS total")
    return rows.withColumns({"band": band("total"), "new_status": F.when(F.col("total") >= 50, "VALID").otherwise("UNVERIFIED")})


_BEST = f"best AS (SELECT phone_id, arg_max(total, (total, -link_id)) AS total FROM evaluated GROUP BY 1), taken AS (SELECT p.*, b.total, {_BANDED} AS band, CASE WHEN total >= 50 THEN 'VALID' ELSE 'UNVERIFIED' END AS new_status, coalesce(b.total >= p.confidence, false) AS take FROM phones p LEFT JOIN best b ON b.phone_id = p.id)"


@query(f"""WITH {ctes("business_phones", "phones")}, {_EVALUATED.format(links="business_phones")}, {_BEST}
SELECT id, CASE WHEN take THEN total ELSE confidence END AS confidence, CASE WHEN take THEN band ELSE confidence_band END AS confidence_band, CASE WHEN take THEN new_status ELSE status END AS status,
 CASE WHEN total IS NOT NULL THEN TIMESTAMP {NOW} + INTERVAL 90 DAY ELSE next_check_at END AS next_check_at, (validation_count + CASE WHEN total IS NULL THEN 0 ELSE 1 END)::BIGINT AS validation_count FROM taken""")
def revalidated_phones(spark, sf_dir):
    t = directory(spark, sf_dir, "business_phones", "phones")
    return revalidate.apply_evaluations(t["phones"], _evaluated(t), _now())[0].select("id", "confidence", "confidence_band", "status", "next_check_at", "validation_count")


@query(f"""WITH {ctes("business_phones", "phones")}, {_EVALUATED.format(links="business_phones")}, {_BEST}, r(name, k) AS (VALUES ('INVALID', 0), ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3), ('VERY_HIGH', 4)),
h AS (SELECT (SELECT k FROM r WHERE name = CASE WHEN take THEN band ELSE confidence_band END) - (SELECT k FROM r WHERE name = confidence_band) AS move, take AND (band <> confidence_band OR new_status <> status) AS changed FROM taken WHERE total IS NOT NULL)
SELECT count(*) AS checked, count(*) FILTER (move > 0) AS upgraded, count(*) FILTER (move < 0) AS downgraded, count(*) FILTER (changed) AS changed FROM h""")
def validation_transitions(spark, sf_dir):
    t = directory(spark, sf_dir, "business_phones", "phones")
    return revalidate.transitions(revalidate.apply_evaluations(t["phones"], _evaluated(t), _now())[1])


@query(f"""WITH {ctes("business_phones", "businesses", "source_observations")}, {_EVALUATED.format(links="business_phones")}, best AS (SELECT business_id, arg_max(total, (total, -link_id)) AS total FROM evaluated GROUP BY 1)
SELECT b.id, (SELECT count(DISTINCT source_id) FROM source_observations o WHERE o.business_id = b.id) AS source_count, (SELECT count(DISTINCT url_domain) FROM source_observations o WHERE o.business_id = b.id) AS independent_source_count,
 coalesce(total, 0) AS confidence, CASE WHEN total IS NULL THEN 'INVALID' ELSE {_BANDED} END AS confidence_band, CASE WHEN status = 'ACTIVE' AND relevance_score < 30 THEN 'QUARANTINED' ELSE status END AS status FROM businesses b LEFT JOIN best ON best.business_id = b.id""")
def recomputed_businesses(spark, sf_dir):
    t = directory(spark, sf_dir, "business_phones", "businesses", "source_observations")
    return revalidate.recompute_businesses(t["businesses"], t["source_observations"], _evaluated(t)).select("id", "source_count", "independent_source_count", "confidence", "confidence_band", "status")


# ---- streams


def _stream(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(frame, spark, label: str, mode: str):
    """All that a stream gives until its source is read, through files in the shared folder."""
    from quarryline.operators.components import shared_path

    path, schema = shared_path(spark, label), frame.schema

    def keep(batch, turn):
        batch.write.mode("overwrite").parquet(f"{path}/{0 if mode == 'complete' else turn}")

    frame.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_windows(spark, sf_dir):
    from quarryline.streaming import ingest

    return _drained(ingest.windowed(_stream(spark, sf_dir), "ts", "event_type"), spark, "windows", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT DISTINCT event_id % 50 AS k, event_type FROM events WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 1000 DAY")
def streamed_distinct(spark, sf_dir):
    from quarryline.streaming import ingest

    s = _stream(spark, sf_dir).withColumn("k", F.col("event_id") % 50)
    return _drained(ingest.deduplicated(s, ["k", "event_type"], "ts", "1000 days").select("k", "event_type"), spark, "distinct", "append")


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM g)
SELECT event_type, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY event_type, k""")
def streamed_sessions(spark, sf_dir):
    from quarryline.streaming import ingest

    got = _drained(ingest.sessions(_stream(spark, sf_dir), "ts", "event_type"), spark, "sessions", "complete")
    return got.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("SELECT user_id, count(*) AS n, max(ts) AS newest FROM events GROUP BY 1")
def streamed_snapshots(spark, sf_dir):
    """Batches folded into snapshots of a table by key; the fold of a batch that comes again changes nothing."""
    from quarryline.operators.components import shared_path
    from quarryline.streaming import ingest

    kept = ingest.Snapshots(spark, shared_path(spark, "snapshots"), "event_id bigint, user_id bigint, ts timestamp")
    merge = lambda old, batch: upsert.keyed_upsert(old, batch.select("event_id", "user_id", "ts").dropDuplicates(["event_id"]), ["event_id"])
    ingest.fold(_stream(spark, sf_dir), kept, merge, shared_path(spark, "fold-state")).awaitTermination()
    return kept.read().groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").cast("timestamp_ntz").alias("newest"))
