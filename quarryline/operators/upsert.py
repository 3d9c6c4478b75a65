"""Idempotent writes as set operations: a new snapshot from the old one and what arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.functions.fingerprint import business_fingerprint
from quarryline.functions.text import is_meaningfully_different, name_key
from quarryline.operators.components import components, cut
from quarryline.session import Settings

#: Attributes whose later values may contradict the first.
COMPARABLE = ("name", "owner_name", "address", "province", "county", "city", "website")


def keyed_upsert(old: DataFrame, new: DataFrame, keys: list[str], merged: dict[str, Column] | None = None) -> DataFrame:
    """``old`` with ``new`` folded in by key: a full outer join. A column takes the new value if there is one, unless ``merged`` says how.

    In ``merged``, ``old.<c>`` and ``new.<c>`` are ``o_<c>`` and ``n_<c>``. Both sides have one row a key.
    """
    o = old.select(*keys, *(F.col(c).alias(f"o_{c}") for c in old.columns if c not in keys), F.lit(True).alias("__o"))
    n = new.select(*keys, *(F.col(c).alias(f"n_{c}") for c in new.columns if c not in keys), F.lit(True).alias("__n"))
    both = o.join(n, keys, "full_outer")

    def value(c: str) -> Column:
        if merged and c in merged:
            return merged[c]
        return F.coalesce(F.col(f"n_{c}"), F.col(f"o_{c}")) if c in new.columns else F.col(f"o_{c}")

    return both.select(*keys, *(value(c).alias(c) for c in old.columns if c not in keys)).select(old.columns)


def first_values(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """A row per key with the first value of each column in an order, nulls passed over; by aggregation, not by a window."""
    at = F.struct(*order)
    return df.groupBy(key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns))


def conflicts(df: DataFrame, key: str, order: list[str], attributes: tuple[str, ...] = COMPARABLE) -> DataFrame:
    """(key, conflicted): the attributes of each key of which a later value contradicts the first."""
    firsts = first_values(df, key, order, list(attributes)).select(key, *(F.col(c).alias(f"__{c}") for c in attributes))
    rows = df.join(firsts, key)
    kind = lambda c: c if c in ("website", "address") else "name"
    flags = [F.max(F.when(F.col(c).isNotNull() & is_meaningfully_different(f"__{c}", c, kind(c)), 1).otherwise(0)).alias(c) for c in attributes]
    flagged = rows.groupBy(key).agg(*flags)
    return flagged.select(key, F.array_compact(F.array(*(F.when(F.col(c) == 1, F.lit(c)) for c in attributes))).alias("conflicted"))


def upsert_phones(phones: DataFrame, seen: DataFrame, as_of: Column) -> DataFrame:
    """Phones by e164 after ``seen(e164, national, type, area_code, subscriber, is_synthetic)``: new ones are UNVERIFIED, known ones are seen
    again, their type filled if UNKNOWN and their area if missing."""
    one = seen.groupBy("e164").agg(*(F.min(c).alias(c) for c in ("national", "type", "area_code", "subscriber", "is_synthetic")))
    have, keep = F.col("__o"), lambda c: F.coalesce(F.col(f"o_{c}"), F.col(f"n_{c}"))
    rules = {
        "id": F.coalesce("o_id", F.xxhash64("e164")), "national": keep("national"), "digits": F.coalesce("o_digits", F.ltrim(F.col("n_national"), F.lit("0"))),
        "type": F.when(F.coalesce("o_type", F.lit("UNKNOWN")) == "UNKNOWN", F.coalesce("n_type", "o_type")).otherwise(F.col("o_type")), "area_code": keep("area_code"),
        "subscriber": keep("subscriber"), "is_synthetic": keep("is_synthetic"), "status": F.coalesce("o_status", F.lit("UNVERIFIED")),
        "confidence": F.coalesce("o_confidence", F.lit(0)), "confidence_band": F.coalesce("o_confidence_band", F.lit("INVALID")),
        "first_seen_at": F.coalesce("o_first_seen_at", as_of), "last_seen_at": F.when(F.col("__n"), as_of).otherwise(F.col("o_last_seen_at")),
        "created_at": F.when(have, F.col("o_created_at")).otherwise(as_of), "updated_at": F.when(F.col("__n"), as_of).otherwise(F.col("o_updated_at")),
    }
    return keyed_upsert(phones, one, ["e164"], rules)


def insert_observations(observations: DataFrame, arrived: DataFrame, as_of: Column) -> DataFrame:
    """Observations by dedupe_hash: unknown ones are added once, known ones get a new time; the rest of them stays."""
    columns = observations.columns
    rest = [c for c in columns if c != "dedupe_hash"]
    one = arrived.groupBy("dedupe_hash").agg(F.min(F.struct(*(F.col(c) for c in rest if c != "observed_at"))).alias("x")).select("dedupe_hash", "x.*")
    rules = {c: F.coalesce(F.col(f"o_{c}"), F.col(f"n_{c}")) for c in rest if c != "observed_at"}
    rules["observed_at"] = F.when(F.col("__n"), as_of).otherwise(F.col("o_observed_at"))
    return keyed_upsert(observations, one, ["dedupe_hash"], rules)


def link_phones(links: DataFrame, arrived: DataFrame, as_of: Column) -> DataFrame:
    """Links by business and phone after ``arrived(business_id, phone_id, label, arrival)``; a business's first link is its primary one."""
    fresh = arrived.groupBy("business_id", "phone_id").agg(F.min("arrival").alias("arrival"), F.min_by("label", "arrival").alias("label"))
    fresh = fresh.join(links.select("business_id", "phone_id"), ["business_id", "phone_id"], "left_anti")
    has = links.select("business_id").distinct().withColumn("__has", F.lit(True))
    first = fresh.groupBy("business_id").agg(F.min(F.struct("arrival", "phone_id")).alias("__first"))
    made = fresh.join(first, "business_id").join(has, "business_id", "left").select(
        F.xxhash64("business_id", "phone_id").alias("id"), "business_id", "phone_id", (F.col("__has").isNull() & (F.col("phone_id") == F.col("__first.phone_id"))).alias("is_primary"),
        "label", F.lit(0).alias("confidence"), F.lit("UNVERIFIED").alias("status"), F.lit(0).cast("bigint").alias("source_count"), as_of.alias("first_seen_at"), as_of.alias("last_seen_at"),
    )
    again = links.join(arrived.select("business_id", "phone_id").distinct().withColumn("__seen", F.lit(True)), ["business_id", "phone_id"], "left")
    again = again.withColumn("last_seen_at", F.when(F.col("__seen"), as_of).otherwise(F.col("last_seen_at"))).drop("__seen")
    return again.select(links.columns).unionByName(made.select(links.columns))


def gate(candidates: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``candidates`` with what becomes of each: drop (spam), evidence (not relevant enough), skip (no phone, no website) or keep."""
    has = (F.size(F.coalesce("phones", F.array().cast("array<string>"))) > 0) | (F.coalesce("website", F.lit("")) != "")
    return candidates.withColumn("fate", F.when(F.col("is_spam"), "drop").when(F.col("relevance") < settings.relevance_gate, "evidence").when(~has, "skip").otherwise("keep"))


def identify(candidates: DataFrame, known: DataFrame, known_phones: DataFrame) -> DataFrame:
    """``candidates`` with business_id, of a known business or a new one.

    candidates: (cid, arrival, name, city, domain, phones). known: (id, fingerprint, name, city). known_phones: (id, e164).
    By fingerprint; else a known business that shares a phone and has an equal name, or one in the same city whose name holds the
    other's, the least id of these; else with the other candidates of this batch under the same rule, transitively.
    """
    c = candidates.withColumn("fp", business_fingerprint("name", "city", "domain", F.get("phones", F.lit(0))))
    by_fp = known.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("by_fp"))
    c = cut(c.join(by_fp, "fp", "left").withColumns({"__n": name_key("name"), "__c": name_key("city")}), "candidates")
    rest = c.where("by_fp is null").groupBy("fp").agg(F.min(F.struct("arrival", "cid", "__n", "__c")).alias("x"), F.array_distinct(F.flatten(F.collect_set("phones"))).alias("phones"))
    rest = rest.select("fp", F.col("x.cid").alias("cid"), F.col("x.__n").alias("n"), F.col("x.__c").alias("c"), F.explode_outer("phones").alias("e164"))
    alike = lambda n, c, m, d: (n == m) | ((c == d) & (c != "") & (F.contains(n, m) | F.contains(m, n)))
    k = known_phones.join(known.select("id", name_key("name").alias("kn"), name_key("city").alias("kc")), "id")
    hits = rest.join(k, "e164").where((F.col("n") != "") & (F.col("kn") != "") & alike(F.col("n"), F.col("c"), F.col("kn"), F.col("kc"))).groupBy("fp").agg(F.min("id").alias("by_phone"))
    free = rest.join(hits, "fp", "left_anti")
    # candidates of one phone are linked to its first one of that name or city, so a phone that many have makes no pairs
    first = free.where("e164 is not null").groupBy("e164", "c").agg(F.min(F.struct("cid", "n", "fp")).alias("f"))
    near = free.join(first, ["e164", "c"]).where((F.col("n") != "") & alike(F.col("n"), F.col("c"), F.col("f.n"), F.col("c")) & (F.col("fp") != F.col("f.fp")))
    pairs = near.select(F.xxhash64("fp").alias("a"), F.xxhash64("f.fp").alias("b"))
    roots = components(pairs).withColumnsRenamed({"id": "h", "root": "group"})
    out = c.join(hits, "fp", "left").withColumn("h", F.xxhash64("fp")).join(roots, "h", "left")
    return out.withColumn("business_id", F.coalesce("by_fp", "by_phone", "group", "h")).drop("by_fp", "by_phone", "group", "h", "__n", "__c")


def fold_businesses(candidates: DataFrame) -> DataFrame:
    """A row per business_id: the first value of each attribute, united categories and links, best relevance, states of the fields.

    ``fp``, what ``identify`` looked a candidate up by, is kept, so that the next run finds the business by it.
    """
    text = ["name", "owner_name", "address", "province", "county", "city", "website", "domain", "description", "business_type"]
    text += ["fp"] if "fp" in candidates.columns else []
    one = first_values(candidates, "business_id", ["arrival", "cid"], text)
    more = candidates.groupBy("business_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"), F.max("relevance").alias("relevance"), F.min("location_confidence").alias("location_confidence"), F.count("*").alias("seen")
    )
    out = one.join(more, "business_id").join(conflicts(candidates, "business_id", ["arrival", "cid"]), "business_id")
    unsure = lambda c: F.col("location_confidence") <= 20 if c in ("province", "county", "city") else F.lit(False)
    state = lambda c: F.when(F.col(c).isNull(), "NOT_FOUND").when(F.array_contains("conflicted", c), "CONFLICTED").when(unsure(c), "UNVERIFIED").otherwise("FOUND")
    return out.withColumn("field_status", F.create_map(*(x for c in COMPARABLE for x in (F.lit(c), state(c)))))


def purge(df: DataFrame, doomed: DataFrame, column: str = "id") -> DataFrame:
    return df.join(doomed.select(column), column, "left_anti")


def purge_businesses(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """The tables without the businesses of ``doomed(id)``; their links go too, evidence stays without its business."""
    out = tables | {"businesses": purge(tables["businesses"], doomed)}
    ids = doomed.select(F.col("id").alias("business_id"))
    if "business_phones" in tables:
        out["business_phones"] = purge(tables["business_phones"], ids, "business_id")
    if "source_observations" in tables:
        o = tables["source_observations"].join(ids.distinct().withColumn("__gone", F.lit(True)), "business_id", "left")
        out["source_observations"] = o.withColumn("business_id", F.when(F.col("__gone").isNull(), F.col("business_id"))).select(tables["source_observations"].columns)
    return out


def seeded_sources(sources: DataFrame, seen: DataFrame, as_of: Column) -> DataFrame:
    """Sources after ``seen(key)``: unknown keys are added as search engines of middling reliability, known ones stay."""
    fresh = seen.select("key").where("key is not null").distinct().join(sources.select("key"), "key", "left_anti")
    made = {"id": F.xxhash64("key"), "key": F.col("key"), "name": F.col("key"), "kind": F.lit("SEARCH_ENGINE"), "reliability": F.lit(0.5), "requires_key": F.lit(False), "official": F.lit(False), "enabled": F.lit(True), "created_at": as_of, "updated_at": as_of}
    return sources.unionByName(fresh.select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in sources.schema)))


def seeded_locations(locations: DataFrame, places: DataFrame, as_of: Column) -> DataFrame:
    """Locations by kind and name key after ``places(kind, name)``: known ones keep their id and take the name, new ones are added."""
    keyed = places.withColumn("name_key", name_key("name")).groupBy("kind", "name_key").agg(F.min("name").alias("name"))
    rules = {"id": F.coalesce("o_id", F.xxhash64("kind", "name_key")), "created_at": F.coalesce("o_created_at", as_of)}
    return keyed_upsert(locations, keyed, ["kind", "name_key"], rules)


def expire(phones: DataFrame, most: int, as_of: Column) -> DataFrame:
    """The ``most`` most trusted phones become due now."""
    top = phones.orderBy(F.desc("confidence"), "id").limit(most).select("id").withColumn("__due", F.lit(True))
    return phones.join(top, "id", "left").withColumn("next_check_at", F.when(F.col("__due"), as_of).otherwise(F.col("next_check_at"))).drop("__due")


def history(results: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """``results`` with the value before each one and whether anything changed, per key in an order."""
    w = W.partitionBy(key).orderBy(*order)
    out = results.withColumns({f"previous_{v}": F.lag(v).over(w) for v in values})
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(f"previous_{v}").eqNullSafe(F.col(v))
    return out.withColumn("changed", changed & F.row_number().over(w).cast("boolean") & F.lag(F.lit(True)).over(w).isNotNull())
