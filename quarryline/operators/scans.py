"""Running values over ordered keys, in two levels: within blocks of a range-partitioned table, and over the blocks of each key.

Rows are dealt by ranges of key and order, so a key with a third of all rows has as many blocks as it needs. Within a block a window
runs over its rows; what goes from block to block is one summary row per key and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.operators.components import cut

_EARLIER = (W.unboundedPreceding, -1)


def in_blocks(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``__block``, which ascends with ``by`` and ``order``; written, so that blocks stay what they are."""
    return cut(rows.repartitionByRange(by, *order).withColumn("__block", F.spark_partition_id()), "blocks")


def within(by: str, order: list[str]) -> W:
    return W.partitionBy(by, "__block").orderBy(*order)


def _carried(blocked: DataFrame, summary: DataFrame, by: str, names: list[str]) -> DataFrame:
    """Each row with the values that ``summary(by, __block, *names)`` has for its key and block; a block of a key has no more rows than a task."""
    return blocked.join(summary.select(F.col(by).alias("__by"), F.col("__block").alias("__b"), *names), F.expr(f"`{by}` <=> __by and __block = __b"), "left").drop("__by", "__b")


def numbered(rows: DataFrame, by: str, order: list[str], name: str = "k") -> DataFrame:
    """``rows`` with their number, from 1, among those of the same ``by`` in ``order``."""
    blocked = in_blocks(rows, by, order)
    sizes = blocked.groupBy(by, "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(by).orderBy("__block").rowsBetween(*_EARLIER)), F.lit(0))
    out = _carried(blocked.withColumn("__k", F.row_number().over(within(by, order))), sizes.withColumn("__before", before), by, ["__before"])
    return out.withColumn(name, F.col("__k") + F.col("__before")).drop("__k", "__before", "__block")


def paced(rows: DataFrame, by: str, order: list[str], arrival: Column, gap: Column, name: str = "at") -> DataFrame:
    """``rows`` with the earliest moment each can go: not before it arrives, nor before ``gap`` after the one ahead of it in ``order``.

    arrival, gap: whole numbers of one unit; the gap is one for all rows of a ``by``. With s the sum of the gaps so far, the moment
    less s never falls along a key, so it is the running maximum of arrival less s, which blocks can be joined by.
    """
    blocked = in_blocks(rows.withColumns({"__arrival": arrival.cast("long"), "__gap": gap.cast("long")}), by, order)
    local = blocked.withColumn("__s", (F.row_number().over(within(by, order)) - 1) * F.col("__gap"))
    local = local.withColumn("__run", F.max(F.col("__arrival") - F.col("__s")).over(within(by, order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    blocks = local.groupBy(by, "__block").agg(F.sum("__gap").alias("__gaps"), F.max(F.col("__arrival") - F.col("__s")).alias("__most"))
    ahead = W.partitionBy(by).orderBy("__block").rowsBetween(*_EARLIER)
    blocks = blocks.withColumn("__shift", F.coalesce(F.sum("__gaps").over(ahead), F.lit(0)))
    blocks = blocks.withColumn("__from", F.max(F.col("__most") - F.col("__shift")).over(ahead))
    out = _carried(local, blocks, by, ["__shift", "__from"])
    moment = F.greatest(F.col("__run") - F.col("__shift"), F.coalesce("__from", F.col("__run") - F.col("__shift"))) + F.col("__shift") + F.col("__s")
    return out.withColumn(name, moment).drop("__arrival", "__gap", "__s", "__run", "__shift", "__from", "__block")


def streaks(rows: DataFrame, by: str, order: list[str], hit: Column, name: str = "streak") -> DataFrame:
    """``rows`` with how many of them in a row, up to this one, are hits; 0 for one that is none."""
    blocked = in_blocks(rows.withColumn("__hit", F.coalesce(hit, F.lit(False))), by, order)
    local = blocked.withColumn("__misses", F.count_if(~F.col("__hit")).over(within(by, order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    island = W.partitionBy(by, "__block", "__misses").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = local.withColumn("__k", F.count_if("__hit").over(island))
    blocks = local.groupBy(by, "__block").agg(F.count_if(~F.col("__hit")).alias("__m"), F.max_by(F.struct("__k"), F.struct("__misses", "__k")).getField("__k").alias("__tail"))
    # a block's tail goes on through the blocks after it that have no miss
    group = F.count_if(F.col("__m") > 0).over(W.partitionBy(by).orderBy("__block").rowsBetween(W.unboundedPreceding, W.currentRow))
    blocks = blocks.withColumn("__group", group)
    blocks = blocks.withColumn("__sum", F.sum("__tail").over(W.partitionBy(by, "__group").orderBy("__block").rowsBetween(W.unboundedPreceding, W.currentRow)))
    blocks = blocks.withColumn("__carry", F.coalesce(F.lag("__sum").over(W.partitionBy(by).orderBy("__block")), F.lit(0)))
    out = _carried(local, blocks, by, ["__carry"])
    value = F.when(F.col("__hit"), F.col("__k") + F.when(F.col("__misses") == 0, F.col("__carry")).otherwise(0)).otherwise(0)
    return out.withColumn(name, value).drop("__hit", "__misses", "__k", "__carry", "__block")
