"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to as many tasks as a shuffle has, for work that is long for each row: a small file is read by one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def looked_up(rows: DataFrame, found: DataFrame, key: str, n: str, most: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``found`` of their key but ``n``, where ``n`` says how many of ``rows`` a key has.

    Keys that at least one in ``most`` rows has, of which there are ``most`` at most, are broadcast; the others are joined by a
    shuffle, in which no key has a larger share of the rows than that.
    """
    total = found.agg(F.sum(n)).first()[0] or 0
    heavy, light = found.where(F.col(n) * most >= total).drop(n), found.where(F.col(n) * most < total).drop(n)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))
