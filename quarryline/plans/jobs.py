"""Control rows of jobs: creation, progress, cancellation, and those that stopped saying they are alive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def created(jobs: DataFrame, kind: str, params: str, target: int, as_of: Column) -> DataFrame:
    row = jobs.sparkSession.range(1).select(
        *(
            {
                "id": F.xxhash64(F.lit(kind), F.lit(params), as_of), "kind": F.lit(kind), "name": F.concat(F.lit(kind + " "), F.date_format(as_of, "yyyy-MM-dd HH:mm")), "status": F.lit("PENDING"), "params": F.lit(params),
                "target": F.lit(target).cast("bigint"), "progress": F.lit(0.0), "cancel_requested": F.lit(False), "created_at": as_of, "updated_at": as_of,
            }.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in jobs.schema
        )
    )
    return jobs.unionByName(row)


def cancelled(jobs: DataFrame, job: int) -> DataFrame:
    mine = (F.col("id") == job) & F.col("status").isin("PENDING", "RUNNING")
    return jobs.withColumns({"cancel_requested": F.col("cancel_requested") | mine, "status": F.when(mine & (F.col("status") == "PENDING"), "CANCELLED").otherwise(F.col("status"))})


def progressed(jobs: DataFrame, job: int, done: int, total: int, as_of: Column) -> DataFrame:
    mine = F.col("id") == job
    share = min(1.0, done / total) if total else 0.0
    return jobs.withColumns({"progress": F.when(mine, F.lit(share)).otherwise(F.col("progress")), "heartbeat_at": F.when(mine, as_of).otherwise(F.col("heartbeat_at"))})


def stale(jobs: DataFrame, as_of: Column, minutes: int = 30) -> tuple[DataFrame, DataFrame]:
    """The jobs with those FAILED that run without a sign for so long, and an event for each."""
    old = (F.col("status") == "RUNNING") & (F.col("heartbeat_at") < as_of - F.expr(f"INTERVAL {minutes} MINUTES"))
    events = jobs.where(old).select(F.xxhash64("id", as_of).alias("id"), F.col("id").alias("job_id"), F.lit("ERROR").alias("level"), F.lit("STALE").alias("event"), F.lit("no heartbeat").alias("message"), F.lit(None).cast("string").alias("data"), as_of.alias("created_at"))
    return jobs.withColumns({"status": F.when(old, "FAILED").otherwise(F.col("status")), "error": F.when(old, "no heartbeat").otherwise(F.col("error"))}), events


def event(events: DataFrame, job: int | None, level: str, code: str, message: str, as_of: Column) -> DataFrame:
    """The events of jobs with one more; a message has 800 characters at most."""
    made = {
        "id": F.xxhash64(F.lit(job), F.lit(code), F.lit(message), as_of), "job_id": F.lit(job), "level": F.lit(level), "event": F.lit(code), "message": F.lit(message[:800]), "created_at": as_of,
    }
    row = events.sparkSession.range(1).select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema))
    return events.unionByName(row)
