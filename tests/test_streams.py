"""Batches of streams that are made of tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarryline.operators.components import shared_path
from quarryline.queries_streams import sliced


def test_slices_are_batches_of_several_files(spark):
    start = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(k, start + timedelta(minutes=k if k < 2000 else 3 * k // 2)) for k in range(4000)] + [(4000, None)], "id long, ts timestamp")
    stream, seen = sliced(rows, "ts", most=300), []
    path = shared_path(spark, "test-slices")
    keep = lambda batch, turn: seen.append((batch.agg(F.min("ts"), F.max("ts"), F.count("*")).first(), batch.select(F.input_file_name()).distinct().count()))
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and sum(n for (_, _, n), _ in seen) == 4000
    assert all(a[1] < b[0] for (a, _), (b, _) in zip(seen, seen[1:]))
    assert all(files > 1 for _, files in seen)


def test_slices_without_rows_and_of_one_time(spark):
    at = datetime(2024, 1, 1)
    for rows in ([], [(1, None)], [(1, at), (2, at)]):
        stream, seen = sliced(spark.createDataFrame(rows, "id long, ts timestamp"), "ts"), []
        keep = lambda batch, turn: seen.extend(r.id for r in batch.collect())  # noqa: B023, E731
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", shared_path(spark, "test-slices")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(seen) == [r[0] for r in rows]
