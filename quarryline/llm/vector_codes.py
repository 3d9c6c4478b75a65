"""Vector codes by integer codebooks and partial-distance search.

Components become integers, vectors are cut into parts, and each part position
has a codebook that rounds of assignment and integer means improve. A part's
nearest entry is found by partial distances: dimensions are taken in descending
variance of the codebook, and entries drop out by masks once what they have
accumulated exceeds the best complete distance so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import written
from quarryline.operators.joins import looked_up

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Rows whose distances are in memory at once, and entries between two updates of the best distance.
ROWS, STEP = 2048, 16
#: Components are held within this, and up to the second bound 64-bit sums of squares can't overflow; beyond it Python's integers are used.
MOST, SAFE = 1 << 62, 1 << 27
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """entries[p]: the codebook of part p, a row per entry."""

    entries: list[np.ndarray]
    dim: int

    @property
    def sha256(self) -> str:
        """Of all components in order, with commas between; of the empty text if there is no entry."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def integers(vectors: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x) of every component, held within +-2**62."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors.astype(np.float64) * scale), -float(MOST), float(MOST)).astype(np.int64)


def cut(whole: np.ndarray, parts: int = PARTS) -> list[np.ndarray]:
    """Equal consecutive parts of each row, which zeros fill up to a multiple of the parts."""
    width = -(-whole.shape[1] // parts)
    whole = np.pad(whole, ((0, 0), (0, width * parts - whole.shape[1])))
    return [whole[:, p * width : (p + 1) * width] for p in range(parts)]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point and its squared distance; of equally near ones the first.

    The entry nearest in the first dimension is measured completely. All entries then run through the other dimensions, ``STEP`` of
    them at a time, and stay while what they have accumulated doesn't exceed the best complete distance of their point.
    """
    if max((int(np.abs(x).max(initial=0)) for x in (points, entries)), default=0) > SAFE:
        points, entries = points.astype(object), entries.astype(object)
    index, distance = np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=points.dtype)
    mean_free = entries * len(entries) - entries.sum(axis=0)
    spread = (mean_free.astype(np.float64) ** 2).sum(axis=0)
    order = np.argsort(-spread, kind="stable")
    e = entries[:, order]
    for lo in range(0, len(points), ROWS):
        p = points[lo : lo + ROWS][:, order]
        first = (p[:, :1] - e[:, 0]) ** 2
        where = first.argmin(axis=1).astype(np.int64)
        best = ((p - e[where]) ** 2).sum(axis=1)
        for k in range(0, len(e), STEP):
            row, entry = np.nonzero(first[:, k : k + STEP] <= best[:, None])
            entry += k
            so_far = first[row, entry]
            for d in range(1, e.shape[1]):
                so_far = so_far + (p[row, d] - e[entry, d]) ** 2
                left = so_far <= best[row]
                row, entry, so_far = row[left], entry[left], so_far[left]
            if not len(row):
                continue
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            least = np.minimum.reduceat(so_far, starts)
            ties = np.flatnonzero(so_far == np.repeat(least, np.diff(starts, append=len(row))))
            firsts = ties[np.flatnonzero(np.diff(row[ties], prepend=-1))]  # entries ascend in a row
            at, found = row[firsts], entry[firsts]
            better = (least < best[at]) | ((least == best[at]) & (found < where[at]))
            best[at[better]], where[at[better]] = least[better], found[better]
        index[lo : lo + ROWS], distance[lo : lo + ROWS] = where, best
    return index, distance


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` whose ``embedding`` is there, isn't empty, and has finite components only."""
    return rows.where(F.size("embedding") > 0).where(F.forall("embedding", lambda x: (x - x) == 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def first_codebooks(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> Codebooks:
    """The parts of the vectors of the smallest ids, null ids last and equal ids by their vectors; these set the size of a vector."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()]
    one = rows.orderBy(*order).select("embedding").first()
    if one is None:
        return Codebooks([np.zeros((0, 0), dtype=np.int64)] * parts, 0)
    dim = len(one[0])
    firsts = rows.where(F.size("embedding") == dim).orderBy(*order).limit(entries).select("embedding").collect()
    return Codebooks(cut(integers(np.array([r[0] for r in firsts], dtype=np.float64)), parts), dim)


def improved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the integer mean, rounded down, of the parts nearest to it; entries without any stay.

    Tasks send a sum per entry they used. What reaches the driver is as large as the codebooks.
    """
    width = books.entries[0].shape[1]
    columns = [f"s{d}" for d in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = range(len(books.entries))
        sums = [np.zeros(e.shape, dtype=object) for e in books.entries]
        counts = [np.zeros(len(e), dtype=np.int64) for e in books.entries]
        for batch in batches:
            for p, points in zip(parts, cut(_matrix(batch.column(0), books.dim), len(books.entries)), strict=True):
                index, _ = nearest(points, books.entries[p])
                big = bool(len(points)) and int(np.abs(points).max()) > SAFE
                more = np.zeros(sums[p].shape, dtype=object if big else np.int64)
                np.add.at(more, index, points.astype(more.dtype))
                sums[p] = sums[p] + more.astype(object)
                counts[p] += np.bincount(index, minlength=len(counts[p]))
        used = [(p, k) for p in parts for k in np.flatnonzero(counts[p]).tolist()]
        arrays = [pa.array([p for p, _ in used], pa.int32()), pa.array([k for _, k in used], pa.int32()), pa.array([int(counts[p][k]) for p, k in used], pa.int64())]
        arrays += [pa.array([Decimal(int(sums[p][k, d])) for p, k in used], pa.decimal128(38, 0)) for d in range(width)]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "entry", "n", *columns])

    partial = rows.select("embedding").mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"{c} decimal(38,0)" for c in columns))
    totals = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).cast("decimal(38,0)").alias(c) for c in columns)).collect()
    out = [e.copy() for e in books.entries]
    for r in totals:
        out[r["part"]][r["entry"]] = [int(r[c]) // r["n"] for c in columns]
    return Codebooks(out, books.dim)


def train(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``rows(vec_id, embedding)`` after ``rounds`` over all of them."""
    books = first_codebooks(rows, entries, parts)
    if books.dim:
        rows = rows.where(F.size("embedding") == books.dim)
        for _ in range(rounds):
            books = improved(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` without ``embedding``, with ``code`` (two hex digits a part) and ``error``, the squared distances summed over the parts.

    Columns of these names in ``rows`` are replaced. An error past 64 bits is held at the largest long.
    """
    own = [c for c in rows.columns if c not in ("embedding", "code", "error")]
    digits = np.array([f"{k:02x}" for k in range(max((len(e) for e in books.entries), default=0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = np.full(batch.num_rows, ""), np.zeros(batch.num_rows, dtype=object)
            for points, e in zip(cut(_matrix(batch.column("embedding"), books.dim), len(books.entries)), books.entries, strict=True):
                index, distance = nearest(points, e)
                codes, error = np.char.add(codes, digits[index]), error + distance
            more = [pa.array(codes.tolist(), pa.string()), pa.array([min(int(x), _LONG) for x in error], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *more], [*own, "code", "error"])

    fields = [rows.schema[c] for c in own]
    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.where(F.size("embedding") == books.dim).select(*own, "embedding").mapInArrow(run, schema)


def decode(codes: DataFrame, books: Codebooks, scale: float = SCALE) -> DataFrame:
    """``codes`` with ``embedding``: the middle of what the entries' integers stand for."""
    entries = F.array(*(F.array(*(F.array(*(F.lit((int(x) + 0.5) / scale) for x in row)) for row in e)) for e in books.entries))
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("embedding", F.slice(F.concat(*(entries[p][at(p)] for p in range(len(books.entries)))), 1, books.dim))


def coded(rows: DataFrame, label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors ``rows(vec_id, embedding, <label>)`` that ``kept`` keeps.

    Vectors that are null or hold a null or a non-finite component are dropped, and so are empty ones and those that differ in
    size from the one of the smallest id, as no codebook fits them. Ids and vectors may repeat, each row is coded; null labels are
    one label; other columns are left out; without vectors there are no rows. Fewer vectors than entries make small codebooks.
    """
    vectors = kept(rows.select("vec_id", "embedding", F.coalesce(F.concat(F.lit("="), F.col(f"`{label}`").cast("string")), F.lit("")).alias("label")))
    books = train(vectors)
    codes = written(encode(vectors, books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    labels = codes.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("of_label"))
    out = looked_up(codes, written(labels, "labels"), "label", "of_label")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
