"""A work queue as snapshots: enqueue once, claim in order, retry with growing pauses, give back what expired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def backoff(attempts, base: int = 30, most: int = 3600) -> Column:
    """Seconds to wait after so many attempts: doubled each time up to an hour."""
    n = F.col(attempts) if isinstance(attempts, str) else attempts
    return F.least(F.lit(base) * F.pow(F.lit(2), F.greatest(n, F.lit(1)) - 1), F.lit(most)).cast("bigint")


def enqueue(items: DataFrame, arrived: DataFrame, as_of: Column) -> DataFrame:
    """Items after ``arrived(dedupe_key, kind, payload, priority)``: known ones stay, DEAD or FAILED ones start again, unknown ones are added."""
    one = arrived.groupBy("dedupe_key").agg(F.min(F.struct("priority", "kind", "payload")).alias("n"))
    rows = items.join(one, "dedupe_key", "full_outer")
    again = F.col("state").isin("DEAD", "FAILED") & F.col("n").isNotNull()
    fresh = F.col("state").isNull()
    start = fresh | again
    return rows.withColumns({
        "id": F.coalesce("id", F.xxhash64("dedupe_key")), "kind": F.coalesce("kind", "n.kind"), "payload": F.coalesce("payload", "n.payload"),
        "priority": F.coalesce("priority", "n.priority"), "state": F.when(start, "QUEUED").otherwise(F.col("state")), "attempts": F.when(start, 0).otherwise(F.col("attempts")),
        "max_attempts": F.coalesce("max_attempts", F.lit(3)), "available_at": F.when(start, as_of).otherwise(F.col("available_at")),
        "leased_until": F.when(~start, F.col("leased_until")), "created_at": F.coalesce("created_at", as_of), "updated_at": F.when(start, as_of).otherwise(F.col("updated_at")),
    }).select(items.columns)


def claimable(items: DataFrame, as_of: Column) -> DataFrame:
    return items.where(((F.col("state") == "QUEUED") & (F.col("available_at") <= as_of)) | ((F.col("state") == "LEASED") & (F.col("leased_until") < as_of)))


def claim(items: DataFrame, most: int, as_of: Column, lease_seconds: int = 300) -> tuple[DataFrame, DataFrame]:
    """The next ``most`` items by priority and id, and the queue with these leased."""
    taken = claimable(items, as_of).orderBy("priority", "id").limit(most)
    marked = items.join(taken.select("id").withColumn("__taken", F.lit(True)), "id", "left")
    mine = F.coalesce("__taken", F.lit(False))
    after = marked.withColumns({
        "state": F.when(mine, "LEASED").otherwise(F.col("state")), "attempts": F.col("attempts") + mine.cast("int"),
        "leased_until": F.when(mine, as_of + F.expr(f"INTERVAL {lease_seconds} SECONDS")).otherwise(F.col("leased_until")),
    }).select(items.columns)
    return taken, after


def settle(items: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """The queue after ``outcomes(id, ok, message)``: DONE, QUEUED again after a pause, or DEAD when attempts are used up."""
    rows = items.join(outcomes, "id", "left")
    done, failed = F.coalesce(F.col("ok"), F.lit(False)), F.col("ok") == F.lit(False)
    dead = failed & (F.col("attempts") >= F.col("max_attempts"))
    wait = F.timestamp_seconds(F.unix_seconds(as_of.cast("timestamp")) + backoff("attempts"))
    return rows.withColumns({
        "state": F.when(done, "DONE").when(dead, "DEAD").when(failed, "QUEUED").otherwise(F.col("state")), "error": F.when(failed, F.col("message")).otherwise(F.col("error")),
        "available_at": F.when(failed & ~dead, wait).otherwise(F.col("available_at")), "leased_until": F.when(~(done | F.coalesce(failed, F.lit(False))), F.col("leased_until")),
        "updated_at": F.when(F.col("ok").isNotNull(), as_of).otherwise(F.col("updated_at")),
    }).select(items.columns)


def release(items: DataFrame, as_of: Column) -> DataFrame:
    expired = (F.col("state") == "LEASED") & (F.col("leased_until") < as_of)
    return items.withColumns({"state": F.when(expired, "QUEUED").otherwise(F.col("state")), "leased_until": F.when(~expired, F.col("leased_until"))})


def purge_done(items: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    return items.where(~((F.col("state") == "DONE") & (F.col("updated_at") < as_of - F.expr(f"INTERVAL {hours} HOURS"))))


def stats(items: DataFrame) -> DataFrame:
    return items.groupBy("state").agg(F.count("*").alias("n"))


def dead_letters(items: DataFrame, most: int = 50) -> DataFrame:
    return items.where("state = 'DEAD'").orderBy(F.desc("updated_at"), F.desc("id")).limit(most)
