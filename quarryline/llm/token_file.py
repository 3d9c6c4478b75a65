"""Token ids in fixed-width bit packing.

Documents are dealt to ranges of ``doc_id`` and encoded there in order. A range
is written as segments, rows of Parquet, so any store that Spark reaches will
do: the ids of all its documents, each in the minimum bits of the vocabulary,
cut into blocks of 4096 ids that begin at a byte, with the offsets of blocks
and documents beside them. A block is unpacked by numpy as a whole; a document
or a stretch of ids is read from the blocks that hold it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import new_path, texts

#: Ids of a block, and ids after which a segment ends with its document.
BLOCK, SEGMENT = 4096, 1 << 20
#: Words whose ids a process remembers, the first it meets, and characters of the longest of them.
MOST_WORDS, LONGEST_WORD = 1_000_000, 64
#: part, segment: where a segment stands; first, n_ids: its place among the part's ids; width: bits of an id; ends: where each document ends, from the
#: segment's first id; blocks: where each block begins in ``packed``, and its end.
SCHEMA = "part int, segment int, first long, n_ids long, width int, doc_ids array<long>, ends array<long>, blocks array<long>, packed binary"


def width_of(vocabulary: int) -> int:
    """Bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids, each in ``width`` bits, lowest bits first; the last byte is filled with zeros."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(packed: bytes | memoryview, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of what ``pack`` made."""
    if width in (8, 16, 32):
        return np.frombuffer(packed, dtype=f"<u{width // 8}", count=n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros((n, 32), dtype=np.uint8)
    out[:, :width] = bits
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


def pack_blocks(ids: np.ndarray, width: int) -> tuple[bytes, list[int]]:
    """All blocks of ``ids`` one after the other, and where each begins, with the end."""
    blocks = [pack(ids[lo : lo + BLOCK], width) for lo in range(0, len(ids), BLOCK)]
    return b"".join(blocks), [0, *np.cumsum([len(b) for b in blocks]).tolist()] if blocks else [0]


def read_ids(packed: bytes, blocks: list[int], width: int, n_ids: int, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of a segment of ``n_ids``; only the blocks that hold them are unpacked."""
    if n <= 0:
        return np.zeros(0, dtype="<u4")
    view, a, b = memoryview(packed), first // BLOCK, (first + n - 1) // BLOCK
    found = [unpack(view[blocks[k] : blocks[k + 1]], width, min(BLOCK, n_ids - k * BLOCK)) for k in range(a, b + 1)]
    return np.concatenate(found)[first - a * BLOCK : first - a * BLOCK + n]


@cache
def tokenizer(path: str):
    """The tokenizer of a file; one per process, without threads of its own."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts by a tokenizer whose pattern leaves out white space, so that what stands between white space is encoded by itself.

    Ids of such words are remembered, and those not met before are encoded by the library in one text, with a word between any two of
    them that is one id and in none of them. A tokenizer for which white space counts, which a probe shows, gets each text as it is.
    """

    #: A digit is a word of its own for such patterns; words that hold it are encoded alone.
    BETWEEN = "7"

    _WHITE = re.compile(r"[ \t\n\r\f\v]+")
    #: White space for Python, but not for the tokenizer's pattern.
    _ODD = re.compile(r"[\x1c-\x1f]")

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.words: dict[str, bytes] = {}
        of = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        between = of(self.BETWEEN)
        self.between = between[0]
        self.by_word = len(between) == 1 and of(f"the end,\n\t of it {self.BETWEEN} ") == [k for w in ("the", "end,", "of", "it", self.BETWEEN) for k in of(w)]
        self.folds = of("AÉ Éa") == of("aé éa")

    def encode(self, text: str) -> np.ndarray:
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if self.folds and (text.isascii() or self._western(text)):
            text = text.lower()  # as the tokenizer does; fewer words are new then
        words = [w for w in self._WHITE.split(text) if w] if self._ODD.search(text) else text.split()
        return np.frombuffer(b"".join(self._pieces(words[lo : lo + 100_000]) for lo in range(0, len(words), 100_000)), dtype="<u4")

    @staticmethod
    def _western(text: str) -> bool:
        """Whether all letters are of Latin-1, where normal forms and lower case have no special cases."""
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return False

    def _pieces(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            new = [w for w in set(words) if w not in self.words]
        more = {w: self._alone(w) for w in new if self.BETWEEN in w or len(w) > LONGEST_WORD}
        rest = [w for w in new if w not in more]
        for lo in range(0, len(rest), 10_000):
            more.update(self._together(rest[lo : lo + 10_000]))
        if len(self.words) < MOST_WORDS:
            self.words.update((w, b) for w, b in more.items() if len(w) <= LONGEST_WORD)
        return b"".join([more[w] if w in more else self.words[w] for w in words])

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _together(self, words: list[str]) -> dict[str, bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([f" {self.BETWEEN} ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(ids == self.between)
        if len(cuts) != len(words) - 1:
            return {w: self._alone(w) for w in words}
        data, starts = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()]
        return {w: data[a:b] for w, a, b in zip(words, starts, [*(4 * cuts).tolist(), len(data)], strict=True)}


@cache
def encoder(path: str) -> Encoder:
    """The encoder of a file; tasks of one process share what it remembers."""
    return Encoder(path)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, segment: int = SEGMENT) -> None:
    """Writes the ids of ``docs(doc_id, text)`` to ``path``, in ascending order of ``doc_id``, each document's followed by ``end_id``.

    Null ids come first, and rows of one id in the order of their texts' hashes; a null text is empty, other columns are left
    out, no documents make no segments. A document is never cut: a segment ends with the document that fills it, so it holds at
    most ``segment`` ids and a document more. Ranges are cut by id, hash and row, so rows of one id can be on many tasks.
    """
    enough = segment

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        width = width_of(max(words.tokenizer.get_vocab_size(), end_id + 1))
        end = np.array([end_id], dtype="<u4")
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        part, count, first, n = 0, 0, 0, 0

        def flush() -> pa.RecordBatch:
            all_ids = np.concatenate(held)
            packed, blocks = pack_blocks(all_ids, width)
            ends = np.cumsum([len(x) for x in held]).tolist()
            row = {"part": part, "segment": count, "first": first, "n_ids": len(all_ids), "width": width, "doc_ids": ids, "ends": ends, "blocks": blocks, "packed": packed}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for key, p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                part = p
                held.append(np.concatenate([words.encode(text), end]))
                ids.append(key)
                n += len(held[-1])
                if n >= enough:
                    yield flush()
                    count, first, n = count + 1, first + n, 0
                    held, ids = [], []
        if held:
            yield flush()

    arrow = pa.schema([
        ("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())), ("blocks", pa.list_(pa.int64())), ("packed", pa.binary()),
    ])
    keys = {"tie": F.xxhash64(F.coalesce("text", F.lit(""))), "row": F.monotonically_increasing_id()}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(keys)
    dealt = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    segments = dealt.select("doc_id", F.spark_partition_id().alias("part"), "text").mapInArrow(run, SCHEMA)
    segments.write.option("compression", "zstd").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments written to ``path``, with ``start``, the ids in all segments before.

    The ids of a part are summed from the two numbers of its segments; there are as many parts as tasks have written.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("first")).drop("base")


def documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array<int>]) of every document written to ``path``, read from the packed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                n = row["n_ids"].as_py()
                ids = read_ids(row["packed"].as_py(), row["blocks"].as_py(), row["width"].as_py(), n, 0, n)
                ends = row["ends"].values.to_numpy()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                data = memoryview(ids.tobytes())
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                for lo in range(0, len(ends), 1000):
                    hi = min(lo + 1000, len(ends))
                    out = [row["doc_ids"].values[lo:hi], pa.array(starts[lo:hi] + row["start"].as_py()), pa.array((ends - starts)[lo:hi]), pa.array(sums[lo:hi], pa.int64())]
                    if with_ids:
                        a = int(starts[lo])
                        offsets = np.concatenate([starts[lo:hi], ends[hi - 1 : hi]]) - a
                        out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids[a : int(ends[hi - 1])].astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = T.StructType.fromDDL(schema).fieldNames()
    return segments(spark, path).select("start", "n_ids", "width", "doc_ids", "ends", "blocks", "packed").mapInArrow(run, schema)


def stretches(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(key, start, ids): what ``wanted(key, first, n)`` asks for, ``n`` ids from the ``first`` of all, in the pieces that segments hold of it.

    Only blocks with wanted ids are unpacked. Stretches that go past the last id are shorter, such as hold no id have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, b = max(r["first"], r["start"]), min(r["first"] + r["n"], r["start"] + r["n_ids"])
                ids = read_ids(r["packed"], r["blocks"], r["width"], r["n_ids"], a - r["start"], b - a)
                yield pa.RecordBatch.from_pylist([{"key": r["key"], "start": a, "ids": ids.tolist()}], schema=arrow)

    arrow = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])
    stored = segments(spark, path).drop("first", "part", "segment", "doc_ids", "ends")
    asked = wanted.select(F.col("key").cast("long").alias("key"), F.col("first").cast("long").alias("first"), F.col("n").cast("long").alias("n")).where("n > 0")
    # segments are longer than SEGMENT ids but for a part's last: both sides meet in windows of that size, then by the exact bounds
    windows = lambda a, b: F.explode(F.sequence(F.floor(a / SEGMENT), F.floor(b / SEGMENT)))
    left = asked.withColumn("w", windows(F.col("first"), F.col("first") + F.col("n") - 1))
    meets = stored.select(F.col("start").alias("at"), "n_ids").withColumn("w", windows(F.col("at"), F.col("at") + F.col("n_ids") - 1))
    pairs = left.join(meets, "w").where("first < at + n_ids and at < first + n").select("key", "first", "n", "at").distinct()
    return pairs.join(stored, F.col("at") == F.col("start")).drop("at").select("key", "first", "n", "start", "n_ids", "width", "blocks", "packed").mapInArrow(run, "key long, start long, ids array<int>")


def stored(docs: DataFrame, tokenizer_path: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """``documents`` of ``docs`` written to a new folder below the shared one."""
    path = new_path(docs.sparkSession, "token-file")
    write(docs, path, tokenizer_path, end_id)
    return documents(docs.sparkSession, path, with_ids)
