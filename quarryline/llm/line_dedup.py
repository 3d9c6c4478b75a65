"""Line dedup over levelled sorted runs of line hashes.

A store keeps, for every line key seen so far, its 128-bit hash and the count
of documents that hold it, as runs sorted by hash on a few levels. A batch adds
one run to level 0; when a level has ``fanout`` runs they are merged into one
run of the next level, so each hash is rewritten logarithmically often. Keys
that have been found in enough documents are settled and go into runs of their
own: a batch is anti-joined with these first, so only keys that aren't settled
are counted on, and what it settles is added. Runs are dealt by hash and sorted
within, so both sides of the merges meet by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import new_path, texts

#: What is stripped from both ends of a line for its key.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Keys in more documents than one part in so many of all keys are looked up by broadcast; no more than so many can exist.
HEAVY = 100_000


def line_keys(text: str) -> list[bytes]:
    """The key of each line: stripped of blanks, A-Z lower-cased, as UTF-8."""
    return [x.strip(BLANK) for x in text.encode("utf-8", "surrogatepass").translate(_LOWER).split(b"\n")]


def _digests(text: str, least: int) -> list[bytes | None]:
    """A 16-byte digest per line, None for keys of fewer than ``least`` code points."""
    out = []
    for key in line_keys(text):
        short = len(key) < least or (least > 1 and len(key) < 4 * least and len(key.decode("utf-8", "surrogatepass")) < least)
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return out


def _longs(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    pairs = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))


def line_counts(docs: DataFrame, least: int = 1) -> DataFrame:
    """(h1, h2, n_docs): in how many rows of ``docs(text)`` each line key is; a row counts once for a key it repeats."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            found = list(counts)
            for i in range(0, len(found), 50_000):
                part = found[i : i + 50_000]
                h1, h2 = _longs(part)
                yield pa.RecordBatch.from_arrays([h1, h2, pa.array([counts[x] for x in part], pa.int64())], ["h1", "h2", "n"])
            counts.clear()

        for batch in batches:
            for text in texts(batch.column(0)):
                for d in {*_digests(text, least)} - {None}:
                    counts[d] = counts.get(d, 0) + 1
            if len(counts) > 300_000:
                yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(keys, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"))


class LineRuns:
    """The levelled store. Runs are Parquet folders below ``path``, sorted by (h1, h2) within hash ranges of h1."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        self.spark, self.path, self.fanout = spark, path or new_path(spark, "line-runs"), fanout
        self.levels: list[list[str]] = []
        self._made = 0

    def _write(self, counts: DataFrame) -> str:
        self._made += 1
        to = f"{self.path}/run-{self._made}"
        counts.sortWithinPartitions("h1", "h2").write.option("compression", "zstd").parquet(to)
        return to

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n_docs long").parquet(*runs)

    def add(self, counts: DataFrame) -> None:
        """Adds a batch's (h1, h2, n_docs) as a run, and compacts every level that is full."""
        self._put(self._write(counts), 0)

    def _put(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(self._read(self.levels[level]).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")))
            self.levels[level] = []
            self._put(merged, level + 1)

    def counts(self) -> DataFrame:
        """(h1, h2, n_docs) over all batches so far."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long")
        found = self._read(runs)
        return found if len(runs) == 1 else found.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))

    def take(self, counts: DataFrame, min_docs: int, settled: LineRuns) -> None:
        """Adds a batch's counts but for the keys that are ``settled``, and settles those now found in ``min_docs`` documents.

        A settled key stays at the count that it was settled with.
        """
        known = settled.counts().select("h1", "h2") if settled.levels else None
        self.add(counts if known is None else counts.join(known, ["h1", "h2"], "left_anti"))
        found = self.counts().where(F.col("n_docs") >= min_docs)
        settled.add(found if known is None else found.join(known, ["h1", "h2"], "left_anti"))

    def dedup_batch(self, docs: DataFrame, min_docs: int = 10, least: int = 1) -> DataFrame:
        """``docs`` without the lines found in ``min_docs`` documents of this and all earlier batches; then adds the batch.

        A line passes as long as it isn't frequent yet; with ``min_docs=2`` every line stays where it came first.
        """
        self.add(line_counts(docs, least))
        return drop_lines(docs, self.counts().where(F.col("n_docs") >= min_docs), least)


def _positions(docs: DataFrame, least: int, heavy) -> DataFrame:
    """(__row, at, h1, h2): a row per line with a key that isn't heavy."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = {None, *heavy.value}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, at, digests = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                    for k, d in enumerate(_digests(text, least)):
                        if d not in skip:
                            ids.append(doc), at.append(k), digests.append(d)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), *_longs(digests)], ["__row", "at", "h1", "h2"])

    return docs.select(F.col("doc_id").alias("__row"), "text").mapInArrow(lines, "__row long, at int, h1 long, h2 long")


def drop_lines(docs: DataFrame, frequent: DataFrame, least: int = 1) -> DataFrame:
    """``docs`` with ``text`` less its frequent lines, and ``n_lines``, ``n_dropped``, ``kept_sha256``.

    docs: doc_id (unique, not null), text, and any others. frequent: (h1, h2, n_docs), each key once. The heaviest keys, those
    that hold over a ``HEAVY``th of all frequent lines and so can't be more than that many, are broadcast and found in place;
    lines of the others are merge-joined, and none of those keys is in enough rows to weigh on a task. Null and empty texts
    are one empty line and stay as the empty text; a document may lose all its lines; repeated lines fall or stay together.
    Columns of ``docs`` that are called like an added one are replaced.
    """
    taken = {"n_lines", "n_dropped", "kept_sha256"}
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in taken])
    total = frequent.agg(F.sum("n_docs")).first()[0] or 0
    bar = max(1, total // HEAVY)
    found = frequent.where(F.col("n_docs") > bar).select("h1", "h2").collect()
    heavy = docs.sparkSession.sparkContext.broadcast([np.array([h1, h2], dtype="<i8").tobytes() for h1, h2 in found])
    lines = _positions(docs, least, heavy)
    gone = lines.join(frequent.where(F.col("n_docs") <= bar).select("h1", "h2"), ["h1", "h2"], "left_semi")
    gone = gone.groupBy("__row").agg(F.collect_list("at").alias("__gone"))
    joined = docs.withColumn("__row", F.col("doc_id")).join(gone.hint("shuffle_hash"), "__row", "left").drop("__row")
    columns = docs.columns
    kept = [c for c in columns if c != "text"]
    schema = joined.drop("__gone").schema.add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        always = {*heavy.value}
        for batch in batches:
            out, n_lines, n_dropped, sha = [], [], [], []
            for text, gone in zip(texts(batch.column("text")), batch.column("__gone").to_pylist(), strict=True):
                lines = text.split("\n")
                drop = {*(gone or ()), *(k for k, d in enumerate(_digests(text, least)) if d in always)}
                n_lines.append(len(lines)), n_dropped.append(len(drop))
                if drop:
                    text = "\n".join(x for k, x in enumerate(lines) if k not in drop)
                out.append(text)
                sha.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
            own = {c: batch.column(c) for c in kept} | {"text": pa.array(out, pa.string())}
            more = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([own[c] for c in columns] + more, names)

    return joined.mapInArrow(cut, schema)


def dedup(docs: DataFrame, min_docs: int = 10, least: int = 1, batches: int = 4) -> DataFrame:
    """``drop_lines`` of the keys in ``min_docs`` rows of ``docs`` or more, found in ``batches`` batches that go into the store one by one.

    A batch is every row whose id hashes to it, so each is an even share of every input file. Lines are judged after the last
    batch, since a key's tenth document may be there: the result doesn't depend on the batches.
    """
    runs, settled = LineRuns(docs.sparkSession), LineRuns(docs.sparkSession)
    for k in range(batches):
        runs.take(line_counts(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), least), min_docs, settled)
    return drop_lines(docs, settled.counts(), least)
