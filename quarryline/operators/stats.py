"""Counts for a dashboard, coverage of regions, and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conditional_counts(df: DataFrame, **cases: Column) -> DataFrame:
    """One row, one pass: how many rows each condition holds for; null doesn't."""
    return df.agg(*(F.count_if(case).alias(name) for name, case in cases.items()))


def dashboard(businesses: DataFrame, phones: DataFrame, as_of: Column) -> DataFrame:
    b = conditional_counts(
        businesses, businesses_total=F.col("status") != "MERGED", active=F.col("status") == "ACTIVE", quarantined=F.col("status") == "QUARANTINED",
        high_confidence=(F.col("status") == "ACTIVE") & (F.col("confidence") >= 70), new_24h=F.col("discovered_at") >= as_of - F.expr("INTERVAL 24 HOURS"),
    )
    p = phones.agg(F.count("*").alias("phones_total"), F.count_if(F.col("next_check_at").isNull() | (F.col("next_check_at") <= as_of)).alias("phones_due"))
    return b.join(p)  # one row each


def group_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(dimension, value, n) for several columns in one pass by grouping sets; null values count as ``(none)``."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias("value")) for c in columns))).alias("x"))
    return rows.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Exact; a row of one bigint a column."""
    return df.agg(*(F.countDistinct(c).alias(c) for c in columns))


def top_groups(df: DataFrame, column: str, most: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(most)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(F.lit(0.0))


def coverage(regions: DataFrame, places: DataFrame, records: DataFrame) -> DataFrame:
    """A row per region: its places, records, distinct places with records, and their share.

    regions: (region), places: (place, region), records: (place). All three are counted before they meet.
    """
    n = records.groupBy("place").agg(F.count("*").alias("records"))
    per = places.join(n, "place", "left").groupBy("region").agg(
        F.count("*").alias("places"), F.count("records").alias("covered"), F.coalesce(F.sum("records"), F.lit(0)).cast("bigint").alias("records")
    )
    out = regions.join(per, "region", "left").fillna(0, ["places", "covered", "records"])
    return out.withColumn("percent", percent(F.col("covered"), F.col("places"))).orderBy(F.desc("records"), F.asc("region"))


def having_shared(df: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """Keys that hold ``least`` different values or more."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n")).where(F.col("n") >= least)


def evidence_rollup(observations: DataFrame, *keys: str) -> DataFrame:
    """What confidence scores need of the observations of a pair: reliabilities, domains, count, newest, any spam."""
    one = observations.groupBy(*keys, "source_reliability").agg(
        F.count("*").alias("k"), F.max("observed_at").alias("newest"), F.max((F.col("status") == "SPAM").cast("int")).alias("spam")
    )
    domains = observations.groupBy(*keys).agg(F.countDistinct("url_domain").alias("domains"))
    # a value and how often it occurs stand for the list, so a pair seen a million times isn't gathered
    rolled = one.groupBy(*keys).agg(
        F.sum(F.col("source_reliability") * F.col("k")).alias("sum_reliability"), F.max("source_reliability").alias("max_reliability"), F.sum("k").alias("observations"),
        F.max("newest").alias("newest"), (F.max("spam") == 1).alias("spam"), F.array_sort(F.collect_set("source_reliability")).alias("reliabilities"),
    )
    return rolled.join(domains, list(keys))


def best_of(df: DataFrame, key: str, by: str, tie: str, fields: list[str]) -> DataFrame:
    """The row of the largest ``by`` of each key, the smallest ``tie`` among equals, by aggregation alone."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(F.col(by), (-F.col(tie)).alias("__t"))).alias("best"))
    return best.select(key, "best.*")


def verdicts(checks: dict[str, DataFrame]) -> DataFrame:
    """(name, passed): a check is a frame of offending rows and passes if it has none."""
    out = None
    for name, bad in checks.items():
        row = bad.limit(1).agg((F.count("*") == 0).alias("passed")).select(F.lit(name).alias("name"), "passed")
        out = row if out is None else out.unionByName(row)
    return out


def registry_summary(sources: DataFrame) -> DataFrame:
    """How many sources of each kind there are, are enabled, and need a key."""
    return sources.groupBy("kind").agg(F.count("*").alias("sources"), F.count_if("enabled").alias("enabled"), F.count_if("requires_key").alias("need_key"))


def full_stats(businesses: DataFrame, phones: DataFrame, observations: DataFrame, as_of: Column) -> DataFrame:
    """(section, value, n): totals, and the groups of businesses and phones, as one table."""
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit("totals").alias("section"), F.lit(name).alias("value"), "n")
    due = phones.where(F.col("next_check_at").isNull() | (F.col("next_check_at") <= as_of))
    parts = [total(businesses.where("status <> 'MERGED'"), "businesses"), total(phones, "phones"), total(observations, "observations"), total(due, "due")]
    parts.append(group_counts(businesses, "status", "confidence_band").withColumnRenamed("dimension", "section"))
    parts.append(group_counts(phones, "status", "type").select(F.concat(F.lit("phone_"), "dimension").alias("section"), "value", "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
