"""A table in hashed buckets, of which an upsert rewrites only those that it touches.

Rows of a bucket are in a folder ``v=<version>/bucket=<bucket>`` of the version that last wrote it; a manifest, itself a small table, says
which version that is for each bucket. The newest complete manifest is the table, so readers see all of an upsert or nothing, a run that
fails leaves the table as it was, and a batch that comes again, known by its id, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_MANIFEST = "bucket int, version long, batch long"


class Buckets:
    """A table of ``schema`` below ``path`` by the hash of ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _of(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _versions(self) -> list[int]:
        """Versions whose manifest is complete, ascending."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS")))

    def manifest(self) -> dict[int, tuple[int, int]]:
        """The version of each bucket that has rows, and the batch that wrote it; at most as many as there are buckets."""
        versions = self._versions()
        if not versions:
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v={versions[-1]}").collect()
        return {r["bucket"]: (r["version"], r["batch"]) for r in rows}

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """The table, or those of its buckets."""
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, (v, _) in sorted(self.manifest().items()) if b >= 0 and (buckets is None or b in buckets)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch_id: int | None = None) -> int:
        """Replaces the buckets that ``batch`` touches by ``merge(rows of them, batch)``; how many these are.

        merge keeps rows in their bucket, so it must not change ``key``. A batch of an id that isn't above the last one's has been taken already.
        """
        held = self.manifest()
        last = max((b for _, b in held.values()), default=-1)
        if batch_id is not None and batch_id <= last:
            return 0
        touched = {r[0] for r in batch.select(self._of()).distinct().collect()}
        if not touched:
            return 0
        version = max(self._versions(), default=0) + 1
        merged = merge(self.read(touched), batch).withColumn("bucket", self._of())
        # a bucket is written by one task, or by several if adaptive execution splits it
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
        there = {r[0] for r in self.spark.read.schema(self.schema + ", bucket int").parquet(f"{self.path}/data/v={version}").select("bucket").distinct().collect()}
        now = {b: x for b, x in held.items() if b not in touched} | {b: (version, last if batch_id is None else batch_id) for b in touched & there}
        now[-1] = (version, last if batch_id is None else batch_id)  # the last batch, also if all it touched is empty now
        self.spark.createDataFrame([(b, v, x) for b, (v, x) in sorted(now.items())], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        return len(touched)

    def vacuum(self, keep: int = 2) -> int:
        """Drops manifests but the newest ``keep`` and what none of these refers to; how many folders of buckets went."""
        jvm, versions = self.spark._jvm, self._versions()
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}")
        kept = versions[-keep:]
        if not kept:
            return 0
        rows = self.spark.read.schema(_MANIFEST).parquet(*(f"{self.path}/manifest/v={v}" for v in kept)).collect()
        used, gone = {(r["version"], r["bucket"]) for r in rows}, 0
        for v in versions[:-keep] + kept:
            if not fs.exists(path(f"data/v={v}")):
                continue
            for s in fs.listStatus(path(f"data/v={v}")):
                name = s.getPath().getName()
                if name.startswith("bucket=") and (v, int(name[7:])) not in used:
                    fs.delete(s.getPath(), True)
                    gone += 1
        for v in versions[:-keep]:
            fs.delete(path(f"manifest/v={v}"), True)
        return gone


def fold(stream: DataFrame, table: Buckets, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Takes each batch of a stream into the table, once, until the source is read; older versions go."""

    def run(batch: DataFrame, turn: int) -> None:
        table.upsert(batch.persist(), merge, turn)
        batch.unpersist()
        table.vacuum(keep)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
