"""Continuous ingestion: repeats dropped within a watermark, batches folded into snapshots, windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Rows of a stream without those whose keys came before within ``late``; state older than that goes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, at: str, key: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by window and key; a window is final once the watermark passes it."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), key, "n")


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    w = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")


class Snapshots:
    """A table kept as versioned snapshot folders; the newest complete one is the table, so no job reads what it overwrites."""

    def __init__(self, spark, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.version = self._newest()

    def _newest(self) -> int:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max(done, default=0)

    def read(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{self.version}")

    def swap(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}")
        self.version += 1


def fold(stream: DataFrame, snapshots: Snapshots, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes ``merge(snapshot, batch)`` as the next snapshot for each micro-batch.

    ``merge`` has to be idempotent: a batch that is replayed after a failure is folded again.
    """

    def run(batch: DataFrame, _: int) -> None:
        snapshots.swap(merge(snapshots.read(), batch))

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
