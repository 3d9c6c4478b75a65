"""Confidence scores with their components and penalties, bands and statuses, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import _c
from quarryline.session import Settings

# Penalties, and the least score of each band.
PENALTIES = {"FAKE": 40, "AREA_MISMATCH": 25, "WEAK_SOURCES": 10, "SPAM": 30, "NO_DATE": 10, "STALE": 10, "UNKNOWN_LOCATION": 5}
BANDS = (("VERY_HIGH", 85), ("HIGH", 70), ("MEDIUM", 45), ("LOW", 20))
RANKS = {"INVALID": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "VERY_HIGH": 4}


def clamp(x, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def band(score, bands=BANDS) -> Column:
    out = None
    for name, least in bands:
        out = F.when(_c(score) >= least, name) if out is None else out.when(_c(score) >= least, name)
    return out.otherwise("INVALID")


def rank(name) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))[_c(name)], F.lit(0))


def score_confidence(df: DataFrame, as_of: Column, settings: Settings = Settings()) -> DataFrame:
    """``df`` with total (0 to 100), band, components and penalties.

    Columns it reads: reliabilities array<double>, domains, observations, has_name, has_address, has_website, has_owner,
    location_known, business_type_known, phone_quality, phone_type, area_matches (null: unknown), fake_signals, is_synthetic,
    relevance, spam, newest (timestamp).
    """
    c = F.col
    n = F.size("reliabilities")
    mean = F.aggregate("reliabilities", F.lit(0.0), lambda a, b: a + b) / F.when(n > 0, n)
    top = F.array_max("reliabilities")
    source = F.when(n > 0, 100 * (0.7 * top + 0.3 * mean)).otherwise(0.0)
    steps = F.when(c("domains") >= 3, 100.0).when(c("domains") == 2, 70.0).when(c("domains") == 1, 40.0).otherwise(0.0)
    again = F.when(c("observations") > c("domains"), F.least(F.lit(10.0), 2.0 * (c("observations") - c("domains")))).otherwise(0.0)
    share = lambda name, points: F.when(c(name), float(points)).otherwise(0.0)
    fields = share("has_name", 34) + share("has_address", 22) + share("has_website", 12) + share("has_owner", 6) + share("location_known", 16) + share("business_type_known", 10)
    phone = clamp(100 * c("phone_quality"))
    phone = F.when(c("phone_type") == "MOBILE", clamp(phone - 5)).otherwise(phone)
    phone = F.when(c("area_matches"), clamp(phone + 6)).otherwise(phone)
    rows = df.withColumn("components", F.struct(source.alias("source"), clamp(steps + again).alias("corroboration"), clamp(fields).alias("fields"), phone.alias("phone")))
    old = c("newest") < as_of - F.expr("INTERVAL 730 DAYS")
    found = {
        "FAKE": (F.size("fake_signals") > 0) & ~c("is_synthetic"), "AREA_MISMATCH": ~c("area_matches"), "WEAK_SOURCES": F.coalesce(top, F.lit(0.0)) < 0.55,
        "SPAM": c("spam"), "NO_DATE": c("newest").isNull(), "STALE": old, "UNKNOWN_LOCATION": ~c("location_known"),
    }
    one = lambda code: F.when(found[code], F.struct(F.lit(code).alias("code"), F.lit(PENALTIES[code]).alias("amount")))
    rows = rows.withColumn("penalties", F.array_compact(F.array(*(one(k) for k in found))))
    x = c("components")
    total = settings.weight_source * x["source"] + settings.weight_corroboration * x["corroboration"] + settings.weight_fields * x["fields"] + settings.weight_phone * x["phone"]
    total = total - F.aggregate("penalties", F.lit(0), lambda a, p: a + p["amount"])
    total = F.when(c("relevance") < settings.relevance_gate, F.least(total, F.lit(25.0))).otherwise(total)
    rows = rows.withColumn("total", F.bround(clamp(total), 0).cast("int"))
    return rows.withColumn("band", band("total"))


def status(total, fake, synthetic, relevance, band_name, observations, settings: Settings = Settings()) -> Column:
    """The standing of a phone for its business."""
    t = _c(total)
    return (
        F.when((t == 0) & (_c(observations) == 0), "UNVERIFIED")
        .when((t < 20) | (_c(fake) & ~_c(synthetic)), "INVALID")
        .when(_c(relevance) < settings.relevance_gate, "QUARANTINED")
        .when(_c(band_name).isin("HIGH", "VERY_HIGH"), "VALID")
        .when(_c(band_name) == "MEDIUM", "PROBABLE")
        .otherwise("UNVERIFIED")
    )
