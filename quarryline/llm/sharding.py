"""Extendible hashing: split rows into shards of bounded bytes by hash-prefix bits.

A directory of hash prefixes is grown from nothing: a bucket whose bytes pass
the limit is split on the next bit, others stay whole, until every bucket
fits. Only the histogram of bytes by prefix drives the splitting, so rows are
read twice (once for the histogram, once to look up their bucket) and never
moved for it. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.llm.common import written

BITS = 60
#: Bits that the directory is split by at once.
STEP = 12


def key_hash(*keys: str) -> Column:
    """60 bits of the md5 of the keys as text, each after an equals sign; a null key has no sign, so it differs from the empty string."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{k}`").cast("string")), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("bigint")


def _prefix(h: str, depth) -> Column:
    """The first ``depth`` bits of a hash as an integer."""
    return F.expr(f"shiftright({h}, {BITS} - {depth})") if isinstance(depth, str) else F.shiftright(h, BITS - depth)


def _leaves(cells: DataFrame, base: int, depth: int, limit: int) -> DataFrame:
    """(cell, local_depth): the shortest prefix of each cell, of ``base`` bits at least, that fits; null where even the cell is over the limit.

    cells: (cell, bytes, rows, lo, hi) at ``depth`` bits. The tree is split from the top, ``STEP`` bits at once: only cells whose
    prefix still is too large go on to the next bits, so a step has at most 2**STEP prefixes below one that was too large.
    """
    done, rest, first = None, cells, base == 0
    while base <= depth:
        to = min(depth, base + STEP)
        at = rest.withColumn("q", F.expr(f"shiftright(cell, {depth - to})"))
        sums = (F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        tree = at.groupBy("q").agg(*sums).withColumn("d", F.explode(F.sequence(F.lit(base), F.lit(to)))).withColumn("p", F.expr(f"shiftright(q, {to} - d)"))
        fits = tree.groupBy("d", "p").agg(*sums).where((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))).select("d", "p")
        # the first step has at most 2**(STEP + 1) prefixes, so they are sent to its rows
        best = tree.select("d", "p", "q").join(F.broadcast(fits) if first else fits, ["d", "p"]).groupBy("q").agg(F.min("d").alias("local_depth"))
        at = at.join(F.broadcast(best) if first else best, "q", "left").drop("q")
        found = at.select("cell", "local_depth") if to == depth else at.where("local_depth is not null").select("cell", "local_depth")
        done = found if done is None else done.unionByName(found)
        rest, base, first = at.where("local_depth is null").drop("local_depth"), to + 1, False
    return done


def directory(rows: DataFrame, limit: int, slack_bits: int = 6) -> list[tuple[int, DataFrame]]:
    """Levels of the directory: (bits, DataFrame(cell, local_depth)), each for the cells the one before left too large.

    rows: (h bigint, size bigint). The first level has about 2**slack_bits cells a shard, so that the histogram follows the
    count of shards, not of rows. A level's cells that still are over the limit and hold more than one hash go to the next
    level, another 2**slack_bits finer; 60 bits end it.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    depth = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + slack_bits)
    levels, base, left = [], 0, rows
    while True:
        cells = left.groupBy(_prefix("h", depth).alias("cell")).agg(
            F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        cells = written(_leaves(written(cells, "cells"), base, depth, limit), "directory")
        levels.append((depth, cells.where("local_depth is not null")))
        over = cells.where("local_depth is null")
        if depth == BITS or over.isEmpty():
            return levels
        left = left.withColumn("cell", _prefix("h", depth)).join(over.select("cell"), "cell", "left_semi").drop("cell")
        base, depth = depth + 1, min(BITS, depth + 2 * slack_bits)


def shard(df: DataFrame, keys: list[str], size: Column, limit: int) -> DataFrame:
    """Adds ``shard`` (its hash prefix as bits, ``""`` for the whole table), ``local_depth``, ``shard_page`` and ``row_bytes``.

    Every shard (prefix and page) holds at most ``limit`` bytes; only a single row that is larger by itself stands alone above
    it. Rows of one key have one hash and can't be told apart by bits: a bucket of a single hash over the limit is cut into
    pages by running bytes over blocks of 65,536 rows of an input partition, so a hot key never lands in one task. Null keys
    hash as a key of their own, null sizes count 0, an empty table gives no rows; a column of ``df`` that is called like an
    added one is replaced.
    """
    taken = {"shard", "local_depth", "shard_page", "row_bytes"}
    source = df.select([F.col(f"`{c}`") for c in df.columns if c not in taken])
    hashed = source.withColumns({"__h": key_hash(*keys), "row_bytes": F.coalesce(size.cast("bigint"), F.lit(0))})
    rest, out = hashed, None
    for depth, cells in directory(hashed.select(F.col("__h").alias("h"), F.col("row_bytes").alias("size")), limit):
        at = rest.withColumn("__cell", F.shiftright("__h", BITS - depth))
        joined = at.join(cells.withColumnsRenamed({"cell": "__cell"}), "__cell", "left").drop("__cell")
        part = joined.where("local_depth is not null")
        out = part if out is None else out.unionByName(part)
        rest = joined.where("local_depth is null").drop("local_depth")
    out = out.withColumn("shard", F.expr(f"substring(lpad(bin(__h), {BITS}, '0'), 1, local_depth)"))
    return _paged(out, limit).drop("__h")


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """``shard_page``: 0, but in buckets of one repeated hash over the limit the page of each row."""
    per_hash = rows.groupBy("__h").agg(F.sum("row_bytes").alias("b"), F.count("*").alias("n"))
    hot = written(per_hash.where((F.col("b") > limit) & (F.col("n") > 1)).select("__h"), "hot-hashes")
    if hot.isEmpty():
        return rows.withColumn("shard_page", F.lit(0).cast("bigint"))
    half = max(1, limit // 2)
    marked = rows.join(hot.withColumn("__hot", F.lit(True)), "__h", "left")
    marked = written(marked.withColumn("__tie", F.when(F.col("__hot"), F.monotonically_increasing_id())), "paged")
    small = marked.where(f"__hot and row_bytes <= {half}").withColumn("__block", F.shiftright("__tie", 16))
    sums = small.groupBy("__h", "__block").agg(F.sum("row_bytes").alias("__b"))
    before = F.sum("__b").over(W.partitionBy("__h").orderBy("__block")) - F.col("__b")
    small = small.join(sums.select("__h", "__block", before.alias("__start")), ["__h", "__block"])
    running = F.sum("row_bytes").over(W.partitionBy("__h", "__block").orderBy("__tie").rowsBetween(W.unboundedPreceding, -1))
    # a page takes the rows that start within half a limit: with the last row's half it still fits
    small = small.withColumn("shard_page", F.floor((F.col("__start") + F.coalesce(running, F.lit(0))) / half).cast("bigint"))
    large = marked.where(f"__hot and row_bytes > {half}").withColumn("shard_page", -1 - F.col("__tie"))
    cold = marked.where("__hot is null").withColumn("shard_page", F.lit(0).cast("bigint"))
    return cold.unionByName(large).unionByName(small.drop("__block", "__start")).drop("__hot", "__tie")
