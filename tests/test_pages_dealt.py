"""Result pages are dealt to all tasks, however few files they come from."""

from quarryline import queries_directory


def test_result_pages_are_dealt(spark, tmp_path):
    spark.createDataFrame([(k, f"part {k}", "TIN") for k in range(50)], "p_partkey long, p_name string, p_type string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = queries_directory.html_result_items(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = got.collect()
    assert len(rows) == 150 and {r.title for r in rows} == {f"part {k}" for k in range(50)}
