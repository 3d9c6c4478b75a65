from pyspark.sql import functions as F

from quarryline.functions import similarity
from quarryline.operators import dedup


def test_pairs_of_small_records_are_met_in_all_tasks(spark):
    """Blocks of few bytes make many pairs: joined by their size, all were compared in one task."""
    records = spark.range(600).select("id", F.array(F.concat(F.lit("k"), (F.col("id") % 60).cast("string"))).alias("keys"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables that are too large for it
    try:
        pairs = dedup.candidate_pairs(records, "keys")
        tasks = pairs.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(t.n for t in tasks) == 60 * 45 and len(tasks) == 4


def test_token_set_takes_a_text_apart_once_for_all_it_meets():
    texts = [f"north {k} harbour w{k * 7919} {'lane ' * (k % 3)}street {k % 5} end{k}" for k in range(20)]
    similarity._short_words.cache_clear()
    similarity._short_places.cache_clear()
    got = [similarity.token_set(a, b) for a in texts for b in texts]
    assert similarity._short_words.cache_info().misses == 20 and similarity._short_places.cache_info().misses <= 20
    for (a, b), n in zip([(a, b) for a in texts for b in texts], got, strict=True):
        x, y = set(a.split()), set(b.split())
        s, p, q = (" ".join(sorted(w)) for w in (x & y, x - y, y - x))
        if p and q:
            row = [0] * (len(q) + 1)
            for c in p:
                last = row[:]
                for k, d in enumerate(q):
                    row[k + 1] = last[k] + 1 if c == d else max(row[k], last[k + 1])
            together = 2 * (row[-1] + len(s) + 1) / (len(p) + len(q) + 2 * len(s) + 2)
            assert abs(n - max(together, 2 * len(s) / (2 * len(s) + 1 + len(p)), 2 * len(s) / (2 * len(s) + 1 + len(q)))) < 1e-12
        else:
            assert n == 1
