"""The registered queries of the operators, with production parameters, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import (
    byte_bpe, conversation_trie, decontamination, html_extraction, line_dedup, ngram_join, quality, sharding, substring_dedup, token_file, token_lengths, transport_stream, vector_codes,
)
from quarryline.llm.common import table, written

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_lengths.summaries(written(token_lengths.histogram(docs, RANKS, PATTERN), "lengths"))


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return transport_stream.store(docs, "doc_id", F.col("text"), keep_media=False).drop("media")


def op4_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"))
    out = sharding.shard(docs, ["doc_id"], F.col("n_bytes"), SHARD_BYTES)
    return out.select("doc_id", F.col("row_bytes").alias("n_bytes"), "shard", F.col("local_depth").cast("bigint").alias("local_depth"), "shard_page")


OP4_SQL = f"""
WITH hashed AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n, ('0x' || substr(md5(coalesce('=' || doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
cut AS (SELECT doc_id, n, h, d, h >> (60 - d) AS p FROM hashed, range(0, 41) t(d)),
sums AS (SELECT *, sum(n) OVER (PARTITION BY d, p) AS b, min(h) OVER (PARTITION BY d, p) AS lo, max(h) OVER (PARTITION BY d, p) AS hi FROM cut),
best AS (SELECT doc_id, any_value(n) AS n, any_value(h) AS h, min(d) AS k FROM sums WHERE b <= {SHARD_BYTES} OR lo = hi GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, substr(lpad(bin(h), 60, '0'), 1, k::INT) AS shard, k::BIGINT AS local_depth, 0::BIGINT AS shard_page FROM best"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranking = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, ranking).select("doc_id", "held_out", "score", "predicted")


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), width=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.col("matches.item_id").alias("item_ids"), F.col("matches.similarity").alias("similarities"),
        F.col("matches.first_word").alias("first_words"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, min_docs=10, least=1).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(line) AS line, unnest(range(len(line))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS line FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY doc_id"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode(docs, byte_bpe.vocabulary(docs, RANKS, PATTERN), ["doc_id"], with_ids=False)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"))


def op11_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.stored(table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


#: CRC-32 by bits, prefixes as lists of hashes, and what is below a node by the prefixes of each node's list.
OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda u, v: xor(u >> 1, (u & 1) * 3988292384))) AS crc
  FROM (SELECT DISTINCT conv_id FROM turns)),
taken AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(crc, 4294967295) % 4 AS n FROM convs),
rebuilt AS (
  SELECT k.conv_id, t.i, t.h, t.words FROM taken k JOIN turns t ON t.conv_id = k.base AND t.i <= k.n
  UNION ALL SELECT k.conv_id, t.i, t.h, t.words FROM taken k JOIN turns t ON t.conv_id = k.conv_id AND t.i > k.n),
paths AS (SELECT k.conv_id, coalesce(list(r.h ORDER BY r.i) FILTER (WHERE r.i IS NOT NULL), []) AS hs, coalesce(list(r.words ORDER BY r.i) FILTER (WHERE r.i IS NOT NULL), []) AS ws
  FROM taken k LEFT JOIN rebuilt r ON r.conv_id = k.conv_id GROUP BY k.conv_id),
passed AS (SELECT conv_id, d, hs[:d] AS p, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS words, d = len(hs) AS is_end FROM paths, LATERAL (SELECT unnest(range(0, len(hs) + 1)) AS d)),
nodes AS (
  SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM passed GROUP BY p),
children AS (SELECT p[:len(p) - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.p = n.p),
below AS (SELECT p[:d] AS p, sum((n_convs - 1) * words) AS saved, sum((n_children = 0)::INT) AS leaves FROM own, LATERAL (SELECT unnest(range(0, len(own.p) + 1)) AS d) GROUP BY 1)
SELECT o.conv_id, o.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, o.n_convs, o.n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, o.ends_sha256
FROM own o JOIN below b ON b.p = o.p LEFT JOIN nodes a ON o.depth > 0 AND a.p = o.p[:len(o.p) - 1]"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """Assignment of all parts to all entries and integer means, written out for each round."""
    steps = []
    for k in range(3):
        steps.append(f"""
pairs{k} AS (SELECT v.row, v.part, v.x, b.entry, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts v JOIN book{k} b ON b.part = v.part),
near{k} AS (SELECT row, part, min({{'d': d, 'entry': entry}}) AS best, any_value(x) AS x FROM pairs{k} GROUP BY row, part)""")
        if k < 2:
            steps.append(f"""
sums{k} AS (SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM (SELECT part, best.entry AS entry, unnest(x) AS x, unnest(range(len(x))) AS pos FROM near{k}) GROUP BY ALL),
means{k} AS (SELECT part, entry, list(floor(s::DOUBLE / n)::BIGINT ORDER BY pos) AS x FROM sums{k} GROUP BY part, entry),
book{k + 1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m ON m.part = b.part AND m.entry = b.entry)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS (SELECT row, p AS part, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM kept, range(0, 16) t(p)),
book0 AS (SELECT part, row - 1 AS entry, x FROM parts WHERE row <= 64),{",".join(steps)},
coded AS (SELECT row, string_agg(lpad(lower(hex(best.entry)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near2 GROUP BY row),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS sha FROM book2)
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, b.sha AS codebooks_sha256 FROM kept k JOIN coded c ON c.row = k.row, books b"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_extendible_hashing": OP4_SQL, "op8_line_dedup": OP8_SQL, "op12_conversation_trie": OP12_SQL, "op13_vector_codes": _op13_sql()}
