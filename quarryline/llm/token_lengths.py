"""Token counts by an exact length histogram.

Documents are encoded once and aggregated by their count of tokens. Suffix
sums over that histogram answer, for every context limit at once, how many
documents and tokens there are, which quantile the limit is, and how many
tokens stay when every document is cut at it.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.llm.common import texts

#: Lengths of one block of the two-level sums.
BLOCK = 1024


@cache
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file; one per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def histogram(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(n_tokens, n_docs) over ``docs(text)``; null and empty texts have 0 tokens. Each task sends one row per length it met."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoding(path, pattern).encode_ordinary, Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                seen[len(encode(text))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["n_tokens", "n_docs"])

    counts = docs.select("text").mapInArrow(lengths, "n_tokens long, n_docs long")
    return counts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def summaries(hist: DataFrame) -> DataFrame:
    """A row per length L that occurs, as context limit L; no row for an empty histogram.

    docs_over, tokens_over: documents longer than L, and their tokens. docs_within, tokens_within: the others. quantile: the
    share of documents within L, so the first row with at least q is the q quantile. truncated_tokens: tokens left when every
    document is cut at L. For a limit between two lengths, the row below it holds, with docs_over * (limit - L) tokens more.
    Sums run within blocks of 1024 lengths and over the blocks' totals, so no task gets the whole histogram.
    """
    rows = hist.withColumns({"tokens": F.col("n_tokens") * F.col("n_docs"), "block": F.floor(F.col("n_tokens") / BLOCK)})
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = W.partitionBy(F.lit(0)).orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    totals = totals.select(
        "block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"),
    )
    longer = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(totals, "block").withColumns({
        "docs_over": F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("d_after"),
        "tokens_over": F.coalesce(F.sum("tokens").over(longer), F.lit(0)) + F.col("t_after"),
    })
    return rows.select(
        "n_tokens", "n_docs", "docs_over", "tokens_over",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_within"),
        (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_within"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
        (F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_tokens"),
    )


def quantile(summary: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share ``q`` of the documents doesn't pass."""
    return summary.where(F.col("quantile") >= q).agg(F.min("n_tokens")).first()[0]


def at_limit(summary: DataFrame, limit: int) -> dict[str, int]:
    """Totals at any context limit of at least 0, also one that no document has."""
    row = summary.where(F.col("n_tokens") <= limit).orderBy(F.desc("n_tokens")).first()
    if row is None:
        first = summary.orderBy("n_tokens").first()
        over = 0 if first is None else first["docs_over"] + first["n_docs"]
        tokens = 0 if first is None else first["tokens_over"] + first["n_tokens"] * first["n_docs"]
        return {"docs_within": 0, "tokens_within": 0, "docs_over": over, "tokens_over": tokens, "truncated_tokens": over * limit}
    names = ("docs_within", "tokens_within", "docs_over", "tokens_over")
    return {k: row[k] for k in names} | {"truncated_tokens": row["truncated_tokens"] + row["docs_over"] * (limit - row["n_tokens"])}
