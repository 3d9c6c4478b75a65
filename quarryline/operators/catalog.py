"""Filters, ordering, paging and the joins of lists and details, over any tables of these columns."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.labels import label

#: Rows of a page at most.
PAGE_MOST = 5000


@dataclass(frozen=True)
class BusinessFilter:
    """What a list is narrowed to; an empty or missing part narrows nothing. Wildcards in ``search`` mean what LIKE means by them."""

    provinces: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    bands: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    phone_statuses: tuple[str, ...] = ()
    source_key: str | None = None
    has_phone: bool | None = None
    min_confidence: int | None = None
    max_confidence: int | None = None
    discovered_after: datetime | None = None
    discovered_before: datetime | None = None
    validated_after: datetime | None = None
    search: str | None = None
    include_synthetic: bool = False
    order: str = "confidence"
    limit: int | None = 100
    offset: int = 0


    @classmethod
    def requested(cls, **given) -> BusinessFilter:
        """A filter of what a request gives: codes in upper case, single values as lists, a page within its bounds; what isn't known is refused."""
        known = {f.name: f for f in fields(cls)}
        if odd := sorted(set(given) - set(known)):
            raise ValueError(f"no such filter: {', '.join(odd)}")
        out = {}
        for name, value in given.items():
            if known[name].type == "tuple[str, ...]":
                value = (value,) if isinstance(value, str) else tuple(value or ())
                value = value if name in ("provinces", "cities") else tuple(str(v).upper() for v in value)
            out[name] = value
        limit, offset = out.get("limit", 50), out.get("offset", 0)
        if limit is None or not 0 <= limit <= PAGE_MOST or offset < 0:
            raise ValueError(f"a page has up to {PAGE_MOST} rows and starts at 0 or later")
        return cls(**out | {"limit": limit})


def is_in(column: str, values: tuple) -> Column:
    return F.col(column).isin(*values) if values else F.lit(True)


def between(column: str, low=None, high=None) -> Column:
    """Inclusive bounds; a missing one is open."""
    out = F.lit(True)
    out = out & (F.col(column) >= F.lit(low)) if low is not None else out
    return out & (F.col(column) <= F.lit(high)) if high is not None else out


def like_any(columns: list[str], text: str | None) -> Column:
    """Case-insensitive search of the trimmed text in any of the columns."""
    if not text or not text.strip():
        return F.lit(True)
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(f"%{text.strip()}%"), F.lit(False)) for c in columns))


def due(column: str, as_of: Column) -> Column:
    return F.col(column).isNull() | (F.col(column) <= as_of)


def conditions(f: BusinessFilter) -> Column:
    parts = [
        F.lit(True) if f.include_synthetic else ~F.col("is_synthetic"), is_in("province_name", f.provinces), is_in("city_name", f.cities),
        is_in("primary_category", f.categories), is_in("business_type", f.types), is_in("confidence_band", f.bands), is_in("status", f.statuses or ("ACTIVE", "QUARANTINED")),
        between("confidence", f.min_confidence, f.max_confidence), between("discovered_at", f.discovered_after, f.discovered_before),
        between("last_validated_at", f.validated_after), like_any(["name", "address", "city_name", "owner_name"], f.search),
    ]
    return reduce(lambda a, b: a & b, parts)


def businesses(tables: dict[str, DataFrame], f: BusinessFilter) -> DataFrame:
    """Businesses that a filter keeps, unordered: conditions on the row reach the scan, those on others are semi- and anti-joins."""
    out = tables["businesses"].where(conditions(f))
    links = tables["business_phones"].select(F.col("business_id").alias("id"), "phone_id")
    if f.phone_statuses:
        phones = tables["phones"].where(is_in("status", f.phone_statuses)).select(F.col("id").alias("phone_id"))
        out = out.join(links.join(phones, "phone_id", "left_semi"), "id", "left_semi")
    if f.has_phone is not None:
        out = out.join(links, "id", "left_semi" if f.has_phone else "left_anti")
    if f.source_key:
        sources = tables["sources"].where(F.col("key") == f.source_key).select(F.col("id").alias("source_id"))
        seen = tables["source_observations"].join(sources, "source_id", "left_semi").select(F.col("business_id").alias("id"))
        out = out.join(seen, "id", "left_semi")
    return out


def ordered(df: DataFrame, order: str) -> DataFrame:
    keys = {"confidence": [F.desc("confidence"), F.asc("id")], "newest": [F.desc("discovered_at"), F.desc("id")], "name": [F.asc("name"), F.asc("id")]}
    return df.orderBy(*keys[order]) if order in keys else df


def page(df: DataFrame, f: BusinessFilter) -> DataFrame:
    return ordered(df, f.order).offset(f.offset).limit(PAGE_MOST if f.limit is None else min(f.limit, PAGE_MOST))


def count(tables: dict[str, DataFrame], f: BusinessFilter) -> DataFrame:
    return businesses(tables, f).agg(F.count("*").alias("n"))


def children(df: DataFrame, key: str, name: str, order: list[Column], fields: list[str], most: int | None = None) -> DataFrame:
    """(key, name): the rows of each key as an array of structs in an order; the order's columns are compared first to last.

    ``most`` keeps the first so many: where an order is by rows, a window ranks them before they are gathered, so an array
    never holds more than that.
    """
    from pyspark.sql import Window as W

    rows = df.withColumn("__nth", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    rows = rows.where(F.col("__nth") <= most) if most else rows
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__nth", *fields))).alias(name))
    return gathered.withColumn(name, F.transform(name, lambda x: F.struct(*(x[f].alias(f) for f in fields))))


def phones_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(business_id, phones): each business's phones, the primary one first, then by confidence."""
    p = tables["phones"].select(F.col("id").alias("phone_id"), "e164", "national", "type", F.col("status").alias("phone_status"), F.col("confidence").alias("phone_confidence"))
    links = tables["business_phones"].select("business_id", "phone_id", "is_primary", "label", "confidence")
    return children(links.join(p, "phone_id"), "business_id", "phones", [F.desc("is_primary"), F.desc("confidence"), F.asc("phone_id")], ["phone_id", "e164", "national", "type", "phone_status", "is_primary", "label", "confidence"])


def evidence_of(tables: dict[str, DataFrame], most: int = 200) -> DataFrame:
    """(business_id, evidence): the newest observations of each business with their source, at most ``most``."""
    s = tables["sources"].select(F.col("id").alias("source_id"), F.col("key").alias("source_key"), F.col("kind").alias("source_kind"))
    seen = tables["source_observations"].where("business_id is not null").join(s, "source_id")
    seen = seen.withColumn("snippet", F.substring("snippet", 1, 300))
    return children(seen, "business_id", "evidence", [F.desc("observed_at"), F.desc("id")], ["source_key", "source_kind", "url", "url_domain", "page_title", "snippet", "observed_at", "status"], most)


def validations_of(tables: dict[str, DataFrame], most: int = 50) -> DataFrame:
    """(business_id, validations): the newest validations of each business's phones."""
    links = tables["business_phones"].select("business_id", "phone_id").distinct()
    rows = tables["validation_results"].drop("business_id").join(links, "phone_id")
    return children(rows, "business_id", "validations", [F.desc("checked_at"), F.desc("id")], ["phone_id", "method", "result", "band", "confidence", "checked_at"], most)


def details(tables: dict[str, DataFrame], kept: DataFrame | None = None) -> DataFrame:
    """Businesses with their phones, evidence and validations as arrays, empty where there are none; ``kept`` has the ids that matter.

    Narrow with ``kept`` (a column ``id``) before details are gathered: it is semi-joined to every child first.
    """
    if kept is not None:
        ids = kept.select("id")
        by_business = ids.select(F.col("id").alias("business_id"))
        tables = tables | {"businesses": tables["businesses"].join(ids, "id", "left_semi")}
        tables |= {k: tables[k].join(by_business, "business_id", "left_semi") for k in ("business_phones", "source_observations")}
    out = tables["businesses"]
    for made in (phones_of(tables), evidence_of(tables), validations_of(tables)):
        out = out.join(made.withColumnRenamed("business_id", "id"), "id", "left")
    return out.withColumns({c: F.coalesce(c, F.expr(f"cast(array() as {out.schema[c].dataType.simpleString()})")) for c in ("phones", "evidence", "validations")})


def source_usage(sources: DataFrame, observations: DataFrame) -> DataFrame:
    """Sources with the count of their observations, 0 for none; counted before the join, so that only counts are shuffled."""
    n = observations.groupBy("source_id").agg(F.count("*").alias("observations"))
    return sources.join(n.withColumnRenamed("source_id", "id"), "id", "left").fillna(0, ["observations"])


def resolve_location(df: DataFrame, cities: DataFrame) -> DataFrame:
    """``df(city, county, province)`` with city_id: by city and county, else by city and province, else by city alone, the least id of each.

    cities: (id, city, county, province).
    """
    out = df
    for name, keys in (("c1", ["city", "county"]), ("c2", ["city", "province"]), ("c3", ["city"])):
        out = out.join(cities.groupBy(*keys).agg(F.min("id").alias(name)), keys, "left")
    return out.withColumn("city_id", F.coalesce("c1", "c2", "c3")).drop("c1", "c2", "c3")


def without_evidence(tables: dict[str, DataFrame]) -> DataFrame:
    """Businesses that no observation stands behind; a null business of an observation matches none."""
    seen = tables["source_observations"].select(F.col("business_id").alias("id"))
    return tables["businesses"].join(seen, "id", "left_anti")


def newest(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """The last rows by some columns, descending: recent jobs, events, dead letters."""
    return df.orderBy(*(F.desc(k) for k in keys)).limit(most)


def phones_list(phones: DataFrame, statuses: tuple[str, ...] = (), kind: str | None = None, min_confidence: int | None = None, include_synthetic: bool = False) -> DataFrame:
    """Phones by status, kind and least confidence, the most trusted first; a least confidence of 0 narrows nothing."""
    keep = is_in("status", statuses) & (F.lit(True) if kind is None else F.col("type") == kind) & between("confidence", min_confidence or None)
    return phones.where(keep & (F.lit(True) if include_synthetic else ~F.col("is_synthetic"))).orderBy(F.desc("confidence"), "id")


def queries_list(ledger: DataFrame, states: tuple[str, ...] = (), cities: tuple[str, ...] = (), most: int = 200) -> DataFrame:
    """Rows of the ledger by state and city, newest first."""
    return newest(ledger.where(is_in("state", states) & is_in("city", cities)), most, "last_run_at", "id")


def locations_list(locations: DataFrame, province: str | None = None) -> DataFrame:
    """Cities with their county and province, of one province or all."""
    names = lambda kind, key, name: locations.where(F.col("kind") == kind).select(F.col("id").alias(key), F.col("name").alias(name))
    out = locations.where("kind = 'city'").select("id", "name", "county_id", "province_id").join(names("county", "county_id", "county"), "county_id", "left").join(names("province", "province_id", "province"), "province_id", "left")
    return (out if province is None else out.where(F.col("province") == province)).select("id", "name", "county", "province").orderBy("province", "name", "id")


def labelled(tables: dict[str, DataFrame], kept: DataFrame) -> DataFrame:
    """Businesses of ``kept(id)`` as a list shows them: labels beside codes, phones as an array, empty where there are none."""
    ids = kept.select("id")
    links = tables["business_phones"].join(ids.withColumnRenamed("id", "business_id"), "business_id", "left_semi")
    phones = phones_of(tables | {"business_phones": links}).withColumnRenamed("business_id", "id")
    b = tables["businesses"].join(ids, "id", "left_semi").join(phones, "id", "left")
    return b.select(
        "id", "name", "owner_name", F.col("province_name").alias("province"), F.col("county_name").alias("county"), F.col("city_name").alias("city"), "address",
        F.coalesce("phones", F.expr(f"cast(array() as {b.schema['phones'].dataType.simpleString()})")).alias("phones"), "website",
        "business_type", label("business_type", "business_type").alias("business_type_label"), "primary_category", label("primary_category", "category").alias("category_label"),
        "relevance_score", "confidence", "confidence_band", label("confidence_band", "band").alias("band_label"), "status", label("status", "business_status").alias("status_label"),
    )
