"""Queries whose operators keep state by key over the batches of a stream, each with DuckDB SQL of what must come out in the end."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.directory import NOW, ctes
from quarryline.operators.catalog import BusinessFilter
from quarryline.operators.components import shared_path
from quarryline.registry import query, table
from quarryline.streaming import states


def sliced(rows: DataFrame, at: str, slices: int = 4, most: int = 250_000) -> DataFrame:
    """A stream of ``rows`` in as many batches, by equal stretches of time, in order; each is written by tasks of about ``most`` rows.

    All batches have the same number of files, since a stream tells them apart by that. Dealt in turn, a task that has as many rows as there are files
    leaves none of these empty; the smallest slice says how many that can be.
    """
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "slices")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    step = (high - low) / slices if low is not None else timedelta(0)
    ends = [low + k * step for k in range(1, slices)] if low is not None else []
    nth = sum(((F.col(at) >= F.lit(x)).cast("int") for x in ends), F.lit(0))
    sizes = dict(rows.where(F.col(at).isNotNull()).groupBy(nth.alias("k")).agg(F.count("*")).collect()) or {0: 0}
    files = max(1, min(min(sizes.values()) // rows.rdd.getNumPartitions(), -(-max(sizes.values()) // most)))
    for k in sorted(sizes):
        one = rows.where(nth == k) if ends else rows
        (one.repartition(files) if files > 1 else one.coalesce(1)).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def drained(stream: DataFrame, label: str, idle: bool = True) -> DataFrame:
    """What a stream appends until its source is read; a batch that comes again overwrites what it wrote.

    idle: whether a batch without rows follows, in which timers fire. State that expires by the clock would ask for such batches forever.
    """
    spark = stream.sparkSession
    path, schema, before = shared_path(spark, label), stream.schema, spark.conf.get(_IDLE, "true")

    def keep(batch: DataFrame, turn: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{turn}")

    spark.conf.set(_IDLE, str(idle).lower())
    try:
        started = stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_IDLE, before)
    started.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def _commands(spark, sf_dir):
    command = F.expr("CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'lease' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'complete' ELSE 'fail' END")
    e = table(spark, sf_dir, "events").where("user_id is not null").withColumn("ts", F.date_trunc("SECOND", F.col("ts").cast("timestamp")))
    return e.select((F.col("user_id") * 8).cast("string").alias("item"), F.col("event_id").alias("id"), command.alias("command"), "ts")


#: Items of the queue step by step: what is due is given back before a command, and after the last one if the newest command of all is later.
_LEASED = """WITH RECURSIVE c AS (SELECT CAST(user_id * 8 AS VARCHAR) AS item, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'lease' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS command,
 epoch_ms(date_trunc('second', ts)) AS t, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts), event_id) AS k FROM events WHERE user_id IS NOT NULL),
s AS (SELECT item, 0::BIGINT AS k, '' AS state, 0 AS attempts, 0::BIGINT AS until, 0::BIGINT AS turn FROM (SELECT DISTINCT item FROM c)
 UNION ALL SELECT item, k, CASE WHEN NOT hit THEN state WHEN command IN ('lease', 'heartbeat') THEN 'LEASED' WHEN command = 'complete' THEN 'DONE' WHEN command = 'fail' AND attempts >= 3 THEN 'DEAD' ELSE 'QUEUED' END,
  attempts + CASE WHEN hit AND command = 'lease' THEN 1 ELSE 0 END,
  CASE WHEN NOT hit THEN until WHEN command IN ('lease', 'heartbeat') THEN t + 7200000 WHEN command = 'fail' AND attempts < 3 THEN t + least(600000 * (1 << (attempts - 1)), 3600000) ELSE t END,
  turn + expired::INT + hit::INT
 FROM (SELECT *, CASE command WHEN 'enqueue' THEN state IN ('', 'DEAD') WHEN 'lease' THEN state = 'QUEUED' AND until <= t ELSE state = 'LEASED' END AS hit
  FROM (SELECT s.item, c.k, c.command, c.t, s.attempts, s.until, s.turn, s.state = 'LEASED' AND s.until <= c.t AS expired, CASE WHEN s.state = 'LEASED' AND s.until <= c.t THEN 'QUEUED' ELSE s.state END AS state
   FROM s JOIN c ON c.item = s.item AND c.k = s.k + 1))),
last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY k DESC) = 1), newest AS (SELECT max(t) AS top FROM c)
SELECT item, CASE WHEN state = 'LEASED' AND until < top THEN 'QUEUED' ELSE state END AS state, attempts, until, turn + (state = 'LEASED' AND until < top)::INT AS turns FROM last, newest WHERE turn > 0"""


@query(_LEASED)
def leased_items(spark, sf_dir):
    """The queue that a stream of commands leaves: leases of two hours, three attempts, pauses from ten minutes to an hour."""
    stream = sliced(_commands(states.with_state_store(spark), sf_dir), "ts")
    changes = drained(states.leases(stream, lease_seconds=7200, most_attempts=3, base_seconds=600, most_seconds=3600), "leases")
    last = changes.groupBy("item").agg(F.max_by(F.struct("state", "attempts", "until"), "turn").alias("x"), F.count("*").alias("turns"))
    return last.select("item", "x.state", "x.attempts", "x.until", "turns")


@query("""WITH e AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS url_hash, epoch_us(ts) // 1000 AS t, CASE WHEN event_type = 'view' THEN 200 WHEN event_type = 'error' THEN 503 END AS status FROM events WHERE user_id IS NOT NULL),
n AS (SELECT *, last_value(CASE WHEN status IS NOT NULL THEN {'t': t, 'status': status} END IGNORE NULLS) OVER (PARTITION BY url_hash ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM e)
SELECT url_hash, id, coalesce(held.t + 72 * 3600000 >= t AND held.status = 200, false) AS ok, CASE WHEN held.t + 72 * 3600000 >= t THEN held.t END AS fetched_at FROM n WHERE status IS NULL""")
def streamed_cache(spark, sf_dir):
    e = table(states.with_state_store(spark), sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("user_id is not null")
    status = F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "error", 503)
    stream = sliced(e.select(F.col("user_id").cast("string").alias("url_hash"), F.col("event_id").alias("id"), status.alias("status"), "ts"), "ts")
    return drained(states.cached_answers(stream), "answers", idle=False)


@query("""SELECT user_id, count(*) AS n, min(ts) AS oldest, max(ts) AS newest, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def bucketed_totals(spark, sf_dir):
    """Totals by user kept in a table of buckets; each batch of a stream rewrites the buckets of its users only."""
    from quarryline.streaming import buckets

    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(30,8)").alias("value"))
    kept = buckets.Buckets(spark, shared_path(spark, "buckets"), "user_id long, n long, oldest timestamp, newest timestamp, total decimal(38,8)", "user_id", 16)

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        new = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.sum("value").alias("total"))
        both = old.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"), F.sum("total").alias("total"))
        return both.withColumn("total", F.col("total").cast("decimal(38,8)"))

    buckets.fold(sliced(e, "ts"), kept, merge, shared_path(spark, "buckets-state")).awaitTermination()
    time = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return kept.read().select("user_id", "n", time("oldest"), time("newest"), F.round(F.col("total").cast("double"), 2).alias("total"))


@query(f"""WITH {ctes("businesses", "business_phones", "sources", "source_observations", "phones")} SELECT unnest(['csv', 'json']) AS format, count(*) AS row_count FROM businesses WHERE NOT is_synthetic AND status IN ('ACTIVE', 'QUARANTINED') AND province_name IN ('ASIA', 'EUROPE')""")
def recorded_exports(spark, sf_dir):
    """Exports whose rows are counted while they are written."""
    from quarryline import schemas
    from quarryline.queries_directory import _export_tables
    from quarryline.sources import export

    tables = _export_tables(spark, sf_dir)
    kept, records = BusinessFilter(provinces=("ASIA", "EUROPE"), limit=None), schemas.empty(spark, "export_records")
    for fmt in ("csv", "json"):
        records = export.recorded(records, export.rows(tables, kept), shared_path(spark, "export"), fmt, kept, F.expr(f"TIMESTAMP {NOW}"))
    return records.select("format", "row_count")


@query("""SELECT 'rows' AS what, count(*)::DOUBLE AS n FROM events UNION ALL SELECT 'kept.failed', count(*) FILTER (event_type = 'error' AND user_id IS NOT NULL) FROM events UNION ALL SELECT 'kept.seen', count(*) FROM events WHERE user_id IS NOT NULL""")
def observed_stream(spark, sf_dir):
    """Numbers of a stream's batches added up by a listener while the stream runs."""
    import time

    from quarryline.plans.metrics import Progress

    progress = Progress()
    spark.streams.addListener(progress)
    try:
        stream = sliced(table(spark, sf_dir, "events"), "ts").where("user_id is not null").observe("kept", F.count(F.lit(1)).alias("seen"), F.count_if(F.col("event_type") == "error").alias("failed"))
        path = shared_path(spark, "observed")
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):  # events reach a listener a little later
            if str(q.id) in progress.ended:
                break
            time.sleep(0.1)
        found = progress.totals(q.id)
    finally:
        spark.streams.removeListener(progress)
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(found.items())], "what string, n double")
