"""Byte-level BPE: encode whole texts by a file of ranked merges, and decode ids.

Texts are split by the vocabulary's pattern. Each distinct word is encoded
once: Spark's higher-order functions fold the ranked merges over its array of
byte pieces, looking pairs up in a literal rank map. Texts are then encoded by
looking their words up; decoding concatenates the pieces of the ids.

The map goes into the plan as one literal: an array of small maps by the
hash of a piece, since Spark scans a map's keys one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import texts, written

#: Distinct words that are encoded ahead and sent to all tasks at most, the most frequent ones; bytes of a word at most.
HEAD, LONGEST = 300_000, 64
_BUCKETS = 1 << 15
_SEEN_MOST = 300_000
ADDED = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def splitter(pattern: str):
    """A function that gives the pattern's matches in a text.

    The usual pattern runs about twice as fast on ``re``, in classes that mean the same unless the text holds numerals that
    aren't decimal digits, or separators that only Python takes for white space; such texts go to ``regex``.
    """
    import regex

    general = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    if pattern != USUAL:
        return general.findall
    odd_one = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _odd_ranges()) + "]")
    fast = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    return lambda text: (general if not text.isascii() and odd_one.search(text) or _CONTROL.search(text) else fast).findall(text)


#: The pattern that texts are cut at spaces for, before it is matched.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CONTROL = re.compile("[\x1c-\x1f]")
#: A space beside other white space; where there is none, no match of the usual pattern crosses from before a space to after it.
_WIDE = re.compile(r"\s | \s")


def chunks(text: str, pattern: str = USUAL) -> list[str] | None:
    """What stands between the spaces of a text, if each of these and the space before it can be split by itself; else None."""
    return None if pattern != USUAL or _WIDE.search(text) else text.split(" ")


def spaced(part: str, split) -> list[str]:
    """The matches in a space and ``part``, which holds no space. Letters alone, or with one mark at their end, need no pattern."""
    if part.isalpha():
        return [" " + part]
    if part[-1:] in _MARKS and part[:-1].isalpha():
        return [" " + part[:-1], part[-1]]
    return split(" " + part)


_MARKS = frozenset(",.;:!?)")


def _odd_ranges() -> list[tuple[int, int]]:
    """Code points that ``re``'s classes take for another kind than Unicode does, as ranges."""
    out: list[tuple[int, int]] = []
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        kind = unicodedata.category(c)
        if kind in ("Nl", "No", "Cn") or c.isalnum() != (kind[0] == "L" or kind == "Nd"):
            if out and out[-1][1] == k - 1:
                out[-1] = (out[-1][0], k)
            else:
                out.append((k, k))
    return out


def rank_map(spark: SparkSession, path: str) -> Column:
    """The ranks as one literal: an array of maps, piece to rank, by the hash of the piece."""
    found = ranks_of(path)
    rows = pa.table({"piece": pa.array(found.keys(), pa.binary()), "rank": pa.array(found.values(), pa.int32())})
    pieces = spark.createDataFrame(rows).withColumn("bucket", _bucket(F.col("piece")))
    empty = spark.range(_BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    maps = pieces.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("piece", "rank"))).alias("m"))
    filled = empty.join(maps, "bucket", "left").select("bucket", F.coalesce("m", F.expr("cast(map() as map<binary,int>)")).alias("m"))
    in_order = F.array_sort(F.collect_list(F.struct("bucket", "m")), lambda a, b: a["bucket"] - b["bucket"])
    one = filled.agg(F.transform(in_order, lambda x: x["m"]).alias("ranks"))
    return _literal(one)


def _literal(one: DataFrame) -> Column:
    """The only value of a frame, an array, as a literal of the plan.

    The value stays in Spark's binary rows, so it prints as a name: a literal of 50,000 pieces that is spelled out in every
    description of the plan that the driver keeps would cost it megabytes for each.
    """
    jvm = one.sparkSession._jvm.org.apache.spark.sql
    kind = one._jdf.schema().apply(0).dataType()
    row = one._jdf.queryExecution().executedPlan().executeCollect()[0]
    return Column(jvm.classic.ExpressionUtils.column(jvm.catalyst.expressions.Literal(row.getArray(0), kind)))


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(_BUCKETS)).cast("int")


def encode_words(words: DataFrame, ranks: Column) -> DataFrame:
    """``words(word string, ...)`` with ``ids array<int>``: lowest rank first, leftmost first among equal ranks.

    The state of the fold is the pieces, the rank of each pair of neighbours (null: none) and the lowest of these; a step
    joins the pair and looks up only the two new neighbours. A word that is a piece itself is that piece.
    """
    look = lambda piece: f"get(v.ranks, cast(pmod(xxhash64({piece}), {_BUCKETS}) as int))[{piece}]"
    let = lambda name, fields, then: f"transform(array(named_struct({fields})), {name} -> {then})[0]"
    none, at = "cast(array() as array<int>)", "cast(a.at as int)"
    joined = f"concat(a.p[{at} - 1], a.p[{at}])"
    pieces = f"concat(slice(a.p, 1, {at} - 1), array({joined}), slice(a.p, {at} + 2, size(a.p)))"
    left = let("x", f"'w', concat(a.p[{at} - 2], {joined})", look("x.w"))
    right = let("x", f"'w', concat({joined}, a.p[{at} + 1])", look("x.w"))
    pairs = (
        f"concat(slice(a.r, 1, greatest({at} - 2, 0)), if({at} > 1, array({left}), {none}), "
        f"if({at} < size(a.r), array({right}), {none}), slice(a.r, {at} + 2, size(a.r)))"
    )
    step = let("a", "'at', array_position(acc.r, acc.m), 'p', acc.p, 'r', acc.r", let("t", f"'p', {pieces}, 'r', {pairs}", "named_struct('p', t.p, 'r', t.r, 'm', array_min(t.r))"))
    first = f"transform(sequence(1, size(b.p) - 1), i -> {let('x', "'w', concat(b.p[i - 1], b.p[i])", look('x.w'))})"
    fold = f"aggregate(b.p, named_struct('p', b.p, 'r', c.r, 'm', array_min(c.r)), (acc, i) -> if(acc.m is null, acc, {step}), acc -> acc.p)"
    merged = let("c", f"'r', if(size(b.p) > 1, {first}, {none})", f"transform({fold}, p -> {look('p')})")
    split = "'p', transform(sequence(1, octet_length(v.w)), i -> substring(v.w, i, 1))"
    ids = let("v", f"'ranks', __ranks, 'w', cast(word as binary)", f"if({look('v.w')} is not null, array({look('v.w')}), {let('b', split, merged)})")
    own = [F.col(f"`{c}`") for c in words.columns if c != "ids"]
    return words.select(*own, ranks.alias("__ranks")).select(*own, F.expr(ids).alias("ids"))


def encode_short(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one short word, with a scan for the lowest rank at each step."""
    if raw in ranks:
        return [ranks[raw]]
    none = 1 << 30
    pieces = [raw[i : i + 1] for i in range(len(raw))]
    pairs = [ranks.get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        k = pairs.index(low)
        pieces[k : k + 2] = [pieces[k] + pieces[k + 1]]
        del pairs[k]
        if k < len(pairs):
            pairs[k] = ranks.get(pieces[k] + pieces[k + 1], none)
        if k:
            pairs[k - 1] = ranks.get(pieces[k - 1] + pieces[k], none)
    return [ranks[p] for p in pieces]


def encode_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a word of any length: a heap of pairs over linked pieces, n log n for n bytes."""
    import heapq

    if raw in ranks:
        return [ranks[raw]]
    n = len(raw)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(raw[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(raw[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[raw[i : end[i]]] for i in range(n) if alive[i]]


def _each(column: pa.Array, step: int = 500) -> Iterator[str]:
    for lo in range(0, len(column), step):
        yield from texts(column.slice(lo, step))


def word_counts(docs: DataFrame, pattern: str, longest: int = LONGEST) -> DataFrame:
    """(word, n): the distinct words of ``docs(text)`` of at most ``longest`` bytes, with their occurrences, merged per task first."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen, parts = splitter(pattern), Counter(), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for part, n in parts.items():
                for w in spaced(part, split):
                    seen[w] += n
            parts.clear()
            found = [(w, n) for w, n in seen.items() if len(w) <= longest and len(w.encode("utf-8", "surrogatepass")) <= longest]
            for lo in range(0, len(found), 50_000):
                w, n = zip(*found[lo : lo + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64())], ["word", "n"])
            seen.clear()

        for batch in batches:
            for text in _each(batch.column(0)):
                cut = chunks(text, pattern)
                if cut is None:
                    seen.update(split(text))
                else:
                    seen.update(split(cut[0]))
                    parts.update(cut[1:])
                if len(seen) + len(parts) > _SEEN_MOST:
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above the smallest count that leaves at most ``most`` of them; ties fall out together."""
    by_n = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("k"))
    kept, bar = 0, 0
    for n, k in sorted(((r["n"], r["k"]) for r in by_n.collect()), reverse=True):
        if kept + k > most:
            bar = n
            break
        kept += k
    return counts.where(F.col("n") > bar)


class Vocabulary:
    """Encoded words as the tasks get them: one Arrow table in a broadcast of bounded size, a dictionary in each worker."""

    def __init__(self, path: str, pattern: str, head: pa.Table):
        self.path, self.pattern = path, pattern
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, head.schema) as out:
            out.write_table(head)
        self.blob = sink.getvalue().to_pybytes()

    def opened(self) -> tuple[dict[str, bytes], dict[bytes, int], list[bytes]]:
        known = _opened.get(len(self.blob))
        if known is None or known[0] != self.blob:
            table = pa.ipc.open_stream(self.blob).read_all()
            head = {}
            for batch in table.to_batches():
                head.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            ranks = ranks_of(self.path)
            pieces = [b""] * (max(ranks.values()) + 1)
            for piece, k in ranks.items():
                pieces[k] = piece
            _opened.clear()
            known = _opened[len(self.blob)] = (self.blob, head, ranks, pieces)
        return known[1:]


_opened: dict[int, tuple] = {}


def vocabulary(docs: DataFrame, path: str, pattern: str, head: int = HEAD) -> Vocabulary:
    """Encodes the ``head`` most frequent distinct words of ``docs(text)`` with the higher-order fold."""
    spark = docs.sparkSession
    counts = written(word_counts(docs, pattern), "words")
    chosen = most_frequent(counts, head).select("word").repartition(max(spark.sparkContext.defaultParallelism, head // 50_000))
    ids = encode_words(chosen, rank_map(spark, path))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.flatten().to_numpy().astype("<u4").tobytes(), lists.offsets.to_numpy() * 4
            at = at - at[0]
            raw = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["word", "raw"])

    return Vocabulary(path, pattern, ids.select("word", "ids").mapInArrow(packed, "word string, raw binary").toArrow())


def encode(docs: DataFrame, vocab: Vocabulary, keep: list[str], with_ids: bool = True) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and ``ids`` and ``decoded`` if asked.

    Words outside the vocabulary's head (rare or long ones) are folded where they stand, by the same merges. Null and empty
    texts have no ids. Map only; rows stay as they are, also repeated ones. ``decoded`` is what the ids decode to, not the text.
    Columns of ``keep`` that are called like an added one are replaced by it.
    """
    keep = [c for c in keep if c not in ADDED[: None if with_ids else 3]]
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, ranks, pieces = shared.value.opened()
        split, own = splitter(shared.value.pattern), {}

        class Parts(dict):
            """Ids of what stands after a space, with the space; emptied before it holds too many."""

            def __missing__(self, part: str) -> bytes:
                raw = b"".join([head.get(w) or rare(w) for w in spaced(part, split)])
                if len(part) <= LONGEST:
                    if len(self) > _SEEN_MOST:
                        self.clear()
                    self[part] = raw
                return raw

        known = Parts()

        def encoded(text: str) -> bytes:
            cut = chunks(text, shared.value.pattern)
            if cut is None:
                return b"".join([head.get(w) or rare(w) for w in split(text)])
            first = b"".join([head.get(w) or rare(w) for w in split(cut[0])])
            return first + b"".join(map(known.__getitem__, cut[1:]))

        def rare(word: str) -> bytes:
            raw = own.get(word)
            if raw is None:
                fold = encode_short if len(word) <= LONGEST else encode_long
                raw = np.array(fold(word.encode("utf-8", "surrogatepass"), ranks), dtype="<u4").tobytes()
                if len(word) <= LONGEST:
                    if len(own) > _SEEN_MOST:
                        own.clear()
                    own[word] = raw
            return raw

        for batch in batches:
            n, sha, back_sha, all_ids, all_back = [], [], [], [], []
            for text in _each(batch.column("text")):
                raw = encoded(text)
                back = decode(np.frombuffer(raw, dtype="<u4"), pieces)
                n.append(len(raw) // 4), sha.append(hashlib.sha256(raw).hexdigest()), back_sha.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(raw, dtype="<i4")), all_back.append(back)
            more = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back_sha, pa.string())]
            more += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_back, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more], [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])])

    own = docs.select([F.col(f"`{c}`") for c in keep]).schema
    schema = own.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "binary")
    return docs.select([F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])]).mapInArrow(run, schema)


def decode(ids, pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, ids.tolist()))


def decoded(df: DataFrame, ids: str, path: str, to: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the column ``ids`` stands for: its pieces concatenated. Null gives null, unknown ids nothing."""
    spark = df.sparkSession
    found = ranks_of(path)
    hexed = [b"".hex()] * (max(found.values()) + 1)
    for piece, k in found.items():
        hexed[k] = piece.hex()
    table = _literal(spark.createDataFrame(pa.table({"pieces": pa.array([hexed], pa.list_(pa.string()))})))
    own = [F.col(f"`{c}`") for c in df.columns if c != to]
    rows = df.select(*own, table.alias("__pieces"))
    return rows.select(*own, F.unhex(F.array_join(F.transform(ids, lambda k: F.get("__pieces", k)), "")).alias(to))
