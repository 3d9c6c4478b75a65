"""Exports: flat rows of businesses and of evidence, written as CSV or JSON, with a record of each."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.catalog import BusinessFilter, businesses, evidence_of, ordered, phones_of
from quarryline.plans.metrics import written_with

# The columns of an export, in order.
COLUMNS = (
    "id", "name", "owner_name", "owner_status", "province_name", "county_name", "city_name", "address", "address_status", "primary_phone", "mobile_phone", "other_phones",
    "phone_status", "phone_type", "website", "domain", "owner_conflict", "business_type", "categories", "primary_category", "source_count", "independent_source_count",
    "source_keys", "evidence_urls", "first_evidence_url", "relevance_score", "confidence", "confidence_band", "status", "field_status", "discovered_at", "last_seen_at",
    "last_validated_at", "is_duplicate_merged", "is_synthetic", "confidence_breakdown", "description",
)


def _or_missing(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("NOT_FOUND"))


def rows(tables: dict[str, DataFrame], f: BusinessFilter) -> DataFrame:
    """A flat row per business that the filter keeps, within its limit if it has one; phones by kind, sources and links of its evidence.

    A filter's limit is 100 unless it says otherwise; with ``limit=None`` all are exported, and nothing is sorted for it.
    """
    kept = businesses(tables, f)
    if f.limit is not None or f.offset:
        kept = ordered(kept, f.order).offset(f.offset)
        kept = kept if f.limit is None else kept.limit(f.limit)
    p = phones_of(tables | {"business_phones": tables["business_phones"].join(kept.select(F.col("id").alias("business_id")), "business_id", "left_semi")})
    e = evidence_of(tables | {"source_observations": tables["source_observations"].join(kept.select(F.col("id").alias("business_id")), "business_id", "left_semi")}, 50)
    b = kept.join(p.withColumnRenamed("business_id", "id"), "id", "left").join(e.withColumnRenamed("business_id", "id"), "id", "left")
    of = lambda *kinds: F.array_join(F.transform(F.filter("phones", lambda x: x["type"].isin(*kinds)), lambda x: x["e164"]), ", ")
    links = F.array_distinct(F.filter(F.transform("evidence", lambda x: x["url"]), lambda u: u.isNotNull()))
    state = lambda k: F.coalesce(F.col("field_status")[k], F.lit("NOT_FOUND"))
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    first = F.get("phones", F.lit(0))
    out = b.withColumns({
        "owner_status": state("owner_name"), "address_status": state("address"), "primary_phone": _or_missing(of("LANDLINE")), "mobile_phone": _or_missing(of("MOBILE")),
        "other_phones": F.coalesce(of("UNKNOWN", "SERVICE"), F.lit("")), "phone_status": _or_missing(first["phone_status"]), "phone_type": _or_missing(first["type"]),
        "owner_conflict": F.when(F.exists(F.map_values(F.coalesce("field_status", F.expr("cast(map() as map<string, string>)"))), lambda v: v == "CONFLICTED"), "CONFLICTED").otherwise(""),
        "categories": F.array_join("categories", ", "), "source_keys": F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("evidence", lambda x: x["source_key"]))), ", "), F.lit("")),
        "evidence_urls": F.coalesce(F.array_join(F.slice(links, 1, 5), " | "), F.lit("")), "first_evidence_url": _or_missing(F.get(links, F.lit(0))),
        "field_status": F.to_json("field_status"), "is_duplicate_merged": F.col("status") == "MERGED", "description": F.substring(F.coalesce("description", F.lit("")), 1, 500),
        **{c: time(c) for c in ("discovered_at", "last_seen_at", "last_validated_at")}, **{c: _or_missing(c) for c in ("name", "owner_name", "address", "website", "domain", "city_name", "province_name", "county_name")},
    })
    return out.select(*COLUMNS)


def evidence_rows(tables: dict[str, DataFrame], f: BusinessFilter) -> DataFrame:
    """A row per observation of the businesses that the filter keeps."""
    kept = businesses(tables, f).select(F.col("id").alias("business_id"), "name")
    s = tables["sources"].select(F.col("id").alias("source_id"), F.col("key").alias("source_key"))
    o = tables["source_observations"].join(kept, "business_id").join(s, "source_id")
    return o.select("business_id", "name", "source_key", "url", "page_title", F.substring("snippet", 1, 300).alias("snippet"), F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("observed_at"))


def api_rows(tables: dict[str, DataFrame], f: BusinessFilter) -> DataFrame:
    """Export rows with their phones as structs."""
    return rows(tables, f).join(phones_of(tables).select(F.col("business_id").alias("id"), F.col("phones").alias("phones_detail")), "id", "left")


def write_csv(df: DataFrame, path: str) -> None:
    """Part files with a header; a byte order mark starts each, so that spreadsheets read them as UTF-8."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line; characters outside ASCII stay."""
    df.write.mode("overwrite").json(path)


def record(spark: SparkSession, records: DataFrame, path: str, fmt: str, f: BusinessFilter, n: int, as_of: Column) -> DataFrame:
    """The list of exports with one more."""
    given = json.dumps({k: v for k, v in vars(f).items() if v not in (None, (), False)}, default=str, ensure_ascii=False)
    row = spark.range(1).select(F.xxhash64(F.lit(path), as_of).alias("id"), F.lit(path).alias("path"), F.lit(fmt).alias("format"), F.lit(given).alias("filters"), F.lit(n).cast("bigint").alias("row_count"), as_of.alias("created_at"))
    return records.unionByName(row)


def recorded(records: DataFrame, df: DataFrame, path: str, fmt: str, f: BusinessFilter, as_of: Column) -> DataFrame:
    """Writes ``df`` as csv or json and gives the list of exports with this one, whose rows are counted as they are written."""
    write = {"csv": write_csv, "json": write_json}[fmt]
    seen = written_with(df, lambda rows: write(rows, path))
    return record(df.sparkSession, records, path, fmt, f, seen["rows"], as_of)
