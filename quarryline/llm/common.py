"""Helpers that the operators share: tables, written intermediates, word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a session of one machine that has none gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class WordHashes(dict):
    """64-bit hashes of words, remembered; emptied before it grows past half a million of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


class TokenHashes(dict):
    """The word hash of what stands between white space, a tuple of hashes if that is no or several words."""

    def __init__(self):
        super().__init__()
        self.words = WordHashes()

    def __missing__(self, token: str) -> int | tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        found = tuple(self.words[w] for w in WORD.findall(token))
        self[token] = out = found[0] if len(found) == 1 else found
        return out


def word_hashes(text: str, known: TokenHashes) -> np.ndarray:
    """Hashes of the lower-case words of a text, in order."""
    found = list(map(known.__getitem__, text.lower().split()))
    try:
        return np.fromiter(found, dtype=np.uint64, count=len(found))
    except (TypeError, ValueError):
        flat = []
        for x in found:
            if type(x) is int:
                flat.append(x)
            else:
                flat += x
        return np.array(flat, dtype=np.uint64)


_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words in order; fewer words make one shingle of them all, none make none."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _MUL + word_hashes[k : n - size + 1 + k]
        return mix(out + np.uint64(size))


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]
