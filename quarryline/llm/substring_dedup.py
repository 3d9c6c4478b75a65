"""Exact removal of repeated substrings, by external suffix sorting of the stretches where repeats can be.

Every window of ``width`` bytes has an anchor: the leftmost of its short
substrings with the smallest hash. Equal windows have equal anchors at the same
place, so windows are dealt to shards by their anchors, consecutive windows of
one anchor as one stretch of text. Stretches of equal content are repeats as a
whole and one of them stands for all; anchors with a single stretch can hold no
repeat. Only the rest, different stretches around one anchor, is sorted, each
shard by ``suffix_sort``; two neighbours in the order with a common prefix of
``width`` are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import mix, written
from quarryline.llm.suffix_sort import repeated

#: Bytes of an anchor, and of text that is scanned at once.
ANCHOR, BLOCK = 32, 1 << 21
#: Bytes of stretches that are sorted at once, and different stretches of one anchor above which its windows are counted by hash instead.
SHARD, HOT = 4 << 20, 4_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _anchor_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each position, by doubling: a power of two."""
    h, step = mix(raw.astype(np.uint64) + np.uint64(1)), 1
    with np.errstate(over="ignore"):
        while step < size:
            h = h[:-step] * _MUL + (h[step:] ^ (h[step:] >> np.uint64(31)))
            step *= 2
    return mix(h)


def _window_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` consecutive values, from running minima within blocks of that size."""
    n = len(values)
    padded = np.full(-(-n // size) * size, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    grid = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - size + 1], ahead[size - 1 : n])


def stretches(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(anchor hash, first window, count of windows) of each stretch, and its content's hash."""
    anchors, firsts, counts = [], [], []
    windows = len(raw) - width + 1
    data = np.frombuffer(raw, dtype=np.uint8)
    for lo in range(0, windows, BLOCK):
        block = data[lo : lo + BLOCK + width - 1]
        hashes = _anchor_hashes(block, ANCHOR)
        # the hash's upper bits and the position: the smallest is the leftmost of the smallest
        ranked = (hashes & ~np.uint64((1 << 22) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        best = (_window_minimum(ranked, width - ANCHOR + 1) & np.uint64((1 << 22) - 1)).astype(np.int64)
        cuts = np.append(0, np.flatnonzero(np.diff(best)) + 1)
        anchors.append(hashes[best[cuts]])
        firsts.append(cuts + lo)
        counts.append(np.diff(np.append(cuts, len(best))))
    if not anchors:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, []
    first, count = np.concatenate(firsts), np.concatenate(counts)
    content = [xxhash.xxh3_64_intdigest(raw[a : a + n + width - 1]) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
    return np.concatenate(anchors).view(np.int64), first, count, content


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """(anchor, content, doc_id, first, n): the stretches of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                anchors, content, ids, firsts, counts = [], [], [], [], []
                for doc, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if raw is not None and len(raw) >= width:
                        anchor, first, n, own = stretches(raw, width)
                        anchors.append(anchor), firsts.append(first), counts.append(n), content.extend(own)
                        ids.append(np.full(len(first), doc, dtype=np.int64))
                if anchors:
                    arrays = [np.concatenate(anchors), np.array(content, dtype=np.uint64).view(np.int64), np.concatenate(ids), np.concatenate(firsts), np.concatenate(counts).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["anchor", "content", "doc_id", "first", "n"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, "anchor long, content long, doc_id long, first long, n int")


def _cut(rows: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(anchor, first, n, doc_id, body): the stretches' bytes, taken from the texts."""
    by_doc = rows.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "first", "n")).alias("parts"))
    joined = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).join(by_doc.hint("shuffle_hash"), "doc_id")
    body = F.expr(f"substring(raw, cast(p.first + 1 as int), p.n + {width - 1})")
    return joined.select("doc_id", "raw", F.explode("parts").alias("p")).select("doc_id", "p.anchor", "p.first", "p.n", body.alias("body"))


def _sorted_shards(rows: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """(doc_id, first, n) of runs of repeated windows in ``rows(doc_id, anchor, first, n, body)``, rows of an anchor sorted together.

    A task takes its anchors in order, some at a time up to ``shard_bytes``; its rows are sorted by anchor on disk by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            ids, firsts, counts = [], [], []
            for (doc, first, _), starts in zip(held, repeated([x[2] for x in held], width), strict=True):
                if len(starts):
                    cuts = np.append(0, np.flatnonzero(np.diff(starts) > 1) + 1)
                    ids.append(np.full(len(cuts), doc, dtype=np.int64))
                    firsts.append(starts[cuts] + first)
                    counts.append(np.diff(np.append(cuts, len(starts))).astype(np.int32))
            held.clear()
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, firsts, counts)], ["doc_id", "first", "n"])

        for batch in batches:
            for doc, anchor, first, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size > shard_bytes and anchor != last:
                    yield from flush()
                    size = 0
                held.append((doc, first, body))
                size, last = size + len(body), anchor
        if held:
            yield from flush()

    ordered = rows.repartition("anchor").sortWithinPartitions("anchor").select("doc_id", "anchor", "first", "body")
    return ordered.mapInArrow(run, "doc_id long, first long, n int")


def _counted(rows: DataFrame, width: int) -> DataFrame:
    """The same for anchors with very many stretches: windows are counted by 128-bit hash, which no anchor can make uneven."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                ids, at, digests = [], [], []
                for doc, first, body in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    n = len(body) - width + 1
                    digests += [xxhash.xxh3_128_digest(body[k : k + width]) for k in range(n)]
                    ids.append(np.full(n, doc, dtype=np.int64)), at.append(np.arange(first, first + n))
                two = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                arrays = [np.concatenate(ids), np.concatenate(at), np.ascontiguousarray(two[:, 0]), np.ascontiguousarray(two[:, 1])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["doc_id", "first", "h1", "h2"])

    windows = rows.select("doc_id", "first", "body").mapInArrow(run, "doc_id long, first long, h1 long, h2 long")
    windows = written(windows, "windows")
    again = windows.groupBy("h1", "h2").agg(F.count("*").alias("k")).where("k > 1").select("h1", "h2")
    return windows.join(again, ["h1", "h2"], "left_semi").select("doc_id", "first", F.lit(1).alias("n"))


def repeats(docs: DataFrame, width: int = 200, shard_bytes: int = SHARD, hot: int = HOT) -> DataFrame:
    """(doc_id, first, n): runs of windows of ``width`` bytes that also start elsewhere in ``docs(doc_id, text)``, this text included."""
    found = written(_scan(docs, width), "stretches")
    kinds = found.groupBy("anchor", "content", "n").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "first")).alias("one"))
    kinds = written(kinds, "kinds")
    per_anchor = kinds.groupBy("anchor").agg(F.count("*").alias("different"), F.sum("copies").alias("all")).where("all > 1")
    # repeated as a whole
    many = kinds.where("copies > 1").select("anchor", "content")
    whole = found.join(many, ["anchor", "content"], "left_semi").select("doc_id", "first", "n")
    # different stretches of one anchor: one of each kind is compared window by window
    rivals = kinds.join(per_anchor.where("different > 1").select("anchor", "different"), "anchor")
    rivals = rivals.select("anchor", F.col("one.doc_id").alias("doc_id"), F.col("one.first").alias("first"), "n", "different")
    bodies = _cut(rivals.select("anchor", "doc_id", "first", "n"), docs, width)
    hot_anchors = written(per_anchor.where(F.col("different") > hot).select("anchor"), "hot-anchors")
    bodies = written(bodies, "bodies")
    cold = bodies.join(hot_anchors, "anchor", "left_anti")
    partial = _sorted_shards(cold, width, shard_bytes)
    if not hot_anchors.isEmpty():
        partial = partial.unionByName(_counted(bodies.join(hot_anchors, "anchor", "left_semi"), width))
    return whole.unionByName(partial)


def cover(n_bytes: int, runs: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Maximal (start, end) of bytes that runs of windows (first, count) cover."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(runs):
        b = min(n_bytes, a + n - 1 + width)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, width: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans) for each row of ``docs(doc_id, text)``; doc_id is unique.

    Every byte under a repeated window goes, in all copies; what is repeated is judged on the input. Texts shorter than
    ``width`` bytes (null and empty ones too) stay whole; copies of a longer text go whole. ``kept`` is bytes: a cut may fall
    inside a character.
    """
    runs = repeats(docs, width).groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    joined = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).join(runs.hint("shuffle_hash"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = []
                for doc, raw, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = raw or b""
                    spans = cover(len(raw), [(x["first"], x["n"]) for x in found or ()], width)
                    kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)], strict=True))
                    rows.append({
                        "doc_id": doc, "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(spans),
                        "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept, "spans": [{"start": a, "end": b} for a, b in spans],
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>")


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
