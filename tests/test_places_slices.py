"""Places of many texts in one task are handed on in several batches, each text's own."""

from pyspark.sql import functions as F

from quarryline.functions import geo


def test_places_of_many_texts_in_one_task(spark):
    names = spark.range(40).select(F.lit("city").alias("kind"), F.concat(F.lit("Kart"), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("county"), F.lit(None).cast("string").alias("province"))
    texts = spark.range(0, 1500, 1, 1).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.col("id") % 40), lambda k: F.concat(F.lit("Kart"), k.cast("string"))), " and ").alias("t"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.id: [p["name"] for p in r.found] for r in geo.places_in_texts(texts, names, "id", "t").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {k: [f"Kart{n}" for n in range(k % 40 + 1)] for k in range(1500)}
