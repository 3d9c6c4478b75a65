"""Robots files are taken apart once, however often their rules are read."""

from pyspark.sql import functions as F

from quarryline.sources import politeness


def test_robots_files_are_read_once(spark):
    bodies = [("a.ir", "User-agent: *\nDisallow: /x\nAllow: /x/*/y$\n"), ("b.ir", "User-agent: quarryline\nDisallow: /\n\nUser-agent: *\nAllow: /\n")]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(body):
        read.add(1)
        return body

    files = spark.createDataFrame(bodies, "domain string, body string").select("domain", counted("body").alias("body"))
    fetches = spark.createDataFrame([(1, "http://a.ir/x/1"), (2, "http://a.ir/x/1/y"), (3, "http://b.ir/"), (4, "http://c.ir/x")], "id long, url string")
    got = {r.id: r.allowed for r in politeness.allowed(fetches, politeness.robots_rules(files)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}
    assert read.value == len(bodies)
