"""Candidates are dealt to all tasks before their terms are sought, however few bytes they have."""

from quarryline.plans import discovery


def test_candidates_are_dealt_before_they_are_scored(spark):
    columns = "cid long, name string, text string, address string, website string, phones array<string>, role string"
    rows = spark.createDataFrame([(k, f"shop {k}", "call 021", None, None, [], None) for k in range(50)], columns).coalesce(1)
    got = discovery._scored(rows, discovery.DEFAULT)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.cid for r in got.select("cid").collect()) == list(range(50))
