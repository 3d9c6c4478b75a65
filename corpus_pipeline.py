"""A corpus from raw documents, stage by stage; each stage works on what its predecessor kept.

For all stages: ids are unique, a null text counts as empty, equal texts are judged alike, an empty table gives an empty table, and
columns other than those of documents are left out, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import byte_bpe, decontamination, line_dedup, ngram_join, quality
from quarryline.llm.common import table, written
from quarryline.llm.queries import PATTERN, RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good, unchanged; a score at the cut passes, empty texts are scored like others."""
    ranking = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs.select(COLUMNS), ranking).where("predicted = 1").select(COLUMNS)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them have; ``n_chars`` follows. All documents stay, if only as empty texts, null ones too."""
    out = line_dedup.dedup(docs.select(COLUMNS), min_docs=10, least=1)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates; texts without a word are classes of their own and stay."""
    found = ngram_join.classes(docs.select("doc_id", "text"))
    return docs.select(COLUMNS).join(found.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi")


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, unchanged; empty texts hold none, an empty benchmark rejects nothing."""
    found = decontamination.find(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("size(matches) = 0").select(COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and digests of the ids and of what they decode to; empty texts have no ids."""
    vocab = byte_bpe.vocabulary(docs, RANKS, PATTERN)
    return byte_bpe.encode(docs.select(COLUMNS), vocab, COLUMNS).drop("decoded")


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("n-gram Jaccard join", near_duplicate_filter),
    ("benchmark decontamination", benchmark_filter),
    ("byte-level BPE", encoding),
]
#: Classifier, similarity and encoding aren't SQL; each stage is tested against a brute-force version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
