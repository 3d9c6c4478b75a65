"""Revalidation of phones that are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.confidence import rank, score_confidence, status
from quarryline.functions.phones import PLAN, PhonePlan, parse_phone, phone_quality
from quarryline.operators.catalog import due
from quarryline.operators.stats import best_of, evidence_rollup
from quarryline.session import Settings


def due_phones(phones: DataFrame, as_of: Column, most: int | None = None) -> DataFrame:
    out = phones.where(due("next_check_at", as_of))
    return out.orderBy(F.desc("confidence"), "id").limit(most) if most else out


def evaluate_pairs(pairs: DataFrame, observations: DataFrame, businesses: DataFrame, as_of: Column, plan: PhonePlan = PLAN, settings: Settings = Settings()) -> DataFrame:
    """``pairs(business_id, phone_id, link_id, e164, national, is_synthetic)`` with total, band, components, penalties, new_status.

    The evidence of a pair is what was seen of its phone, else all that was seen of the business.
    businesses: (business_id, name, address, website, owner_name, city_name, area_code, business_type, relevance_score).
    """
    seen = observations.where("business_id is not null")
    own = evidence_rollup(seen.where("phone_id is not null"), "business_id", "phone_id")
    whole = evidence_rollup(seen, "business_id")
    parts = ["sum_reliability", "max_reliability", "observations", "newest", "spam", "reliabilities", "domains"]
    rows = pairs.join(own, ["business_id", "phone_id"], "left").join(whole.select("business_id", *(F.col(p).alias(f"__{p}") for p in parts)), "business_id", "left")
    rows = rows.withColumns({p: F.coalesce(p, f"__{p}") for p in parts}).drop(*(f"__{p}" for p in parts)).join(businesses, "business_id", "left")
    parsed = parse_phone("national", plan)
    rows = rows.withColumns({"parsed": parsed}).withColumn("phone_quality", phone_quality("parsed"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("NOT_FOUND")).isin("", "NOT_FOUND")
    expected = F.col("area_code")
    rows = rows.withColumns({
        "has_name": ~blank("name"), "has_address": ~blank("address"), "has_website": ~blank("website"), "has_owner": ~blank("owner_name"), "location_known": ~blank("city_name"),
        "business_type_known": F.coalesce(F.col("business_type"), F.lit("UNKNOWN")) != "UNKNOWN", "phone_type": F.col("parsed.type"),
        "area_matches": F.when(F.col("parsed.type") == "MOBILE", F.lit(True)).otherwise(F.col("parsed.area_code") == expected),
        "fake_signals": F.coalesce(F.col("parsed.signals"), F.array().cast("array<string>")), "relevance": F.coalesce("relevance_score", F.lit(0)),
        "reliabilities": F.coalesce("reliabilities", F.array().cast("array<double>")), "domains": F.coalesce("domains", F.lit(0)), "observations": F.coalesce("observations", F.lit(0)),
        "spam": F.coalesce("spam", F.lit(False)), "is_synthetic": F.coalesce("is_synthetic", F.lit(False)),
    })
    out = score_confidence(rows, as_of, settings)
    return out.withColumn("new_status", status("total", F.size("fake_signals") > 0, "is_synthetic", "relevance", "band", "observations", settings))


def apply_evaluations(phones: DataFrame, evaluated: DataFrame, as_of: Column, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Phones after their best pair of ``evaluated``, and the history rows of those checked.

    A phone takes its best pair's score if it is no lower than its own, and is next due after ``revalidate_days``.
    """
    best = best_of(evaluated, "phone_id", "total", "link_id", ["total", "band", "new_status"]).withColumnRenamed("phone_id", "id")
    rows = phones.join(best, "id", "left")
    take = F.col("total").isNotNull() & (F.col("total") >= F.coalesce("confidence", F.lit(0)))
    checked = F.col("total").isNotNull()
    history = rows.where(checked).select(
        F.col("id").alias("phone_id"), F.col("confidence_band").alias("previous_band"), F.when(take, F.col("band")).otherwise(F.col("confidence_band")).alias("new_band"),
        F.col("status").alias("previous_status"), F.when(take, F.col("new_status")).otherwise(F.col("status")).alias("new_status"),
        F.col("confidence").alias("previous_confidence"), F.when(take, F.col("total")).otherwise(F.col("confidence")).alias("new_confidence"), as_of.alias("created_at"),
    ).withColumn("changed", ~F.col("previous_band").eqNullSafe(F.col("new_band")) | ~F.col("previous_status").eqNullSafe(F.col("new_status")))
    new = {
        "confidence": F.when(take, F.col("total")).otherwise(F.col("confidence")), "confidence_band": F.when(take, F.col("band")).otherwise(F.col("confidence_band")),
        "status": F.when(take, F.col("new_status")).otherwise(F.col("status")), "last_validated_at": F.when(checked, as_of).otherwise(F.col("last_validated_at")),
        "next_check_at": F.when(checked, as_of + F.expr(f"INTERVAL {settings.revalidate_days} DAYS")).otherwise(F.col("next_check_at")),
        "validation_count": F.coalesce("validation_count", F.lit(0)) + checked.cast("bigint"),
    }
    return rows.withColumns(new).select(phones.columns), history


def transitions(history: DataFrame) -> DataFrame:
    """How many checked phones rose, fell, stayed."""
    move = rank("new_band") - rank("previous_band")
    return history.agg(F.count("*").alias("checked"), F.count_if(move > 0).alias("upgraded"), F.count_if(move < 0).alias("downgraded"), F.count_if("changed").alias("changed"))


def recompute_businesses(businesses: DataFrame, observations: DataFrame, evaluated: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Businesses with the counts of their sources and the score of their best pair; ACTIVE ones below the gate are quarantined."""
    n = observations.where("business_id is not null").groupBy(F.col("business_id").alias("id")).agg(F.countDistinct("source_id").alias("__s"), F.countDistinct("url_domain").alias("__d"))
    best = best_of(evaluated, "business_id", "total", "link_id", ["total", "band"]).withColumnRenamed("business_id", "id")
    rows = businesses.join(n, "id", "left").join(best, "id", "left")
    return rows.withColumns({
        "source_count": F.coalesce("__s", F.lit(0)), "independent_source_count": F.coalesce("__d", F.lit(0)), "confidence": F.coalesce("total", F.lit(0)), "confidence_band": F.coalesce("band", F.lit("INVALID")),
        "status": F.when((F.col("status") == "ACTIVE") & (F.col("relevance_score") < settings.relevance_gate), "QUARANTINED").otherwise(F.col("status")),
    }).select(businesses.columns)
