"""Benchmark decontamination by SimHash windows and exact weighted-shingle similarity.

Items get a 64-bit SimHash of their weighted shingles, the same bag that is
compared in the end. Windows of an item's size in words slide over each
document; windows whose fingerprint is within the radius of an item's are
candidates, found by multi-index Hamming blocks: the 64 bits are cut into four
blocks, so fingerprints within the radius differ by at most a quarter of it in
one block at least. Items are stored under all block values next to their own,
windows ask for all values next to theirs, and the two meet. Candidates are
verified by the exact weighted similarity of word shingles.

A shingle of weight w that a bag holds n times counts sqrt(w * n) in a
fingerprint. So the cosine of two bags of similarity J is at least
2J / (1 + J) whatever the weights are, and a bit differs with a probability of
about acos(2J / (1 + J)) / pi at most: at 0.8, 9.7 of 64 bits are expected to
differ, with a deviation of 2.9.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import TokenHashes, mix, shingle_hashes, texts, word_hashes, written

#: Words of a shingle, least similarity, and bits that fingerprints may differ in: three deviations more than are expected at this similarity.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 19
#: Bits more for items with all their weight on fewer shingles than this.
MORE, FEW = 5, 12
#: Bytes of benchmark text that are sent to every task at once at most.
MOST_ITEM_BYTES = 16 << 20
BLOCKS, BLOCK_BITS = 4, 16
_BITS = np.arange(64, dtype=np.uint64)


#: Hashes of a shingle whose signs are added up: with one alone, bits of small bags would be ties too often.
_SALTS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """For each bit the sum of +1 or -1 by that bit of each of three hashes."""
    with np.errstate(over="ignore"):
        bits = [((mix(hashes + salt)[:, None] >> _BITS) & np.uint64(1)).astype(np.int64) for salt in _SALTS]
    return 2 * sum(bits) - len(_SALTS)


def _packed(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=-1, dtype=np.uint64)


def _value(weights: np.ndarray, times: np.ndarray) -> np.ndarray:
    """What shingles of these weights count that a bag holds so many times; integers, so that sums don't depend on their order."""
    return np.rint(65536 * np.sqrt(weights * times)).astype(np.int64)


def fingerprint(shingles: np.ndarray, weights: np.ndarray) -> int:
    """SimHash of one bag of shingles, ``weights`` by shingle."""
    kinds, first, times = np.unique(shingles, return_index=True, return_counts=True)
    return int(_packed((_signs(kinds) * _value(weights[first], times)[:, None]).sum(axis=0)))


def window_fingerprints(shingles: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of all runs of ``size`` shingles, by running sums of what enters a run and what leaves it.

    A shingle that a run has already adds the difference of two square roots, so its place in the run counts.
    """
    n = len(shingles)
    order = np.lexsort((np.arange(n), shingles))
    group = np.zeros(n, dtype=np.int64)
    group[order] = np.cumsum(np.concatenate([[0], np.diff(shingles[order].view(np.int64)) != 0]))
    key = group * (n + 1) + np.arange(n)
    ordered, at = key[order], np.empty(n, dtype=np.int64)
    at[order] = np.arange(n)
    before = at - np.searchsorted(ordered, np.maximum(key - size + 1, group * (n + 1)))  # the same shingle among the size - 1 before
    after = np.searchsorted(ordered, np.minimum(key + size, (group + 1) * (n + 1))) - at  # and from here on within the run that begins here
    signs = _signs(shingles)
    enters = signs * (_value(weights, before + 1) - _value(weights, before))[:, None]
    leaves = signs * (_value(weights, after) - _value(weights, after - 1))[:, None]
    sums = np.cumsum(enters, axis=0)[size - 1 :]
    sums[1:] -= np.cumsum(leaves[: n - size], axis=0)
    return _packed(sums)


def near(most: int) -> np.ndarray:
    """All block values with at most ``most`` bits set: what a value is changed by to get those next to it."""
    values = np.arange(1 << BLOCK_BITS, dtype=np.uint16)
    return values[np.bitwise_count(values) <= most]


def block(prints: np.ndarray, k: int) -> np.ndarray:
    return (prints >> np.uint64(BLOCK_BITS * k)).astype(np.uint16)


@dataclass
class Items:
    """The benchmark as every task gets it."""

    ids: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    shingles: list[Counter] = field(default_factory=list)
    weights: dict[int, float] = field(default_factory=dict)  # of shingles; those of no item weigh 1
    radius: int = RADIUS
    index: _Index | None = None

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], radius: int = RADIUS, spread: dict[int, int] | None = None) -> Items:
        """Shingles weigh the less the more items hold them: 1 for a shingle of one item, 1/k for one of k. Empty items match nothing.

        spread: how many items of the whole benchmark hold a shingle, where that is more than one; without it, of these rows.
        """
        out, known, own = cls(radius=radius), TokenHashes(), Counter()
        for k, text in sorted(rows, key=lambda r: r[0]):
            hashes = word_hashes(text or "", known)
            if len(hashes):
                out.ids.append(k), out.words.append(hashes)
                out.shingles.append(Counter(shingle_hashes(hashes, SHINGLE).tolist()))
                own.update(out.shingles[-1].keys())
        out.weights = {s: 1 / n for s, n in (own if spread is None else spread).items() if n > 1 and s in own}
        return out

    def prepared(self) -> _Index:
        """The index, made once in a process."""
        if self.index is None:
            self.index = _Index(self)
        return self.index


class _Index:
    """Items by size in words: fingerprints, Hamming blocks, and which shingles any item has."""

    def __init__(self, items: Items):
        self.items = items
        self.all_shingles = np.array(sorted({s for c in items.shingles for s in c}), dtype=np.uint64)
        self.table = np.zeros(1 << 22, dtype=bool)  # by the lower bits: most shingles of a document are told apart by one look
        self.table[self.all_shingles & np.uint64((1 << 22) - 1)] = True
        self.totals = [sum(n * items.weights.get(s, 1.0) for s, n in c.items()) for c in items.shingles]
        sizes = defaultdict(list)
        for k, words in enumerate(items.words):
            sizes[len(words)].append(k)
        self.by_size = dict(sizes)
        self.shared = np.array(sorted(items.weights), dtype=np.uint64)
        self.shared_weights = np.array([items.weights[s] for s in self.shared.tolist()], dtype=np.float64)
        own = [shingle_hashes(w, SHINGLE) for w in items.words]
        self.prints = np.array([fingerprint(s, self.weights_of(s)) for s in own], dtype=np.uint64)
        self.radius = {n: items.radius + (MORE if any(self._few(k) for k in members) else 0) for n, members in sizes.items()}
        self.stored = {n: near(r // BLOCKS // 2) for n, r in self.radius.items()}
        self.asked = {n: near(r // BLOCKS - r // BLOCKS // 2) for n, r in self.radius.items()}
        self.tables = {n: [self._table(np.array(members), k, self.stored[n]) for k in range(BLOCKS)] for n, members in sizes.items()}
        self.widths = sorted({min(SHINGLE, n) for n in sizes})
        self.sizes_of: dict[int, set[int]] = {}
        for k, c in enumerate(items.shingles):
            for s in c:
                self.sizes_of.setdefault(s, set()).add(len(items.words[k]))

    def weights_of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.ones(len(shingles))
        if len(self.shared):
            at = np.minimum(np.searchsorted(self.shared, shingles), len(self.shared) - 1)
            found = self.shared[at] == shingles
            out[found] = self.shared_weights[at[found]]
        return out

    def _few(self, item: int) -> bool:
        """Whether an item's weight is on so few shingles that its bits vary more; that of a single one can only be equal."""
        weights = [n * self.items.weights.get(s, 1.0) for s, n in self.items.shingles[item].items()]
        return len(weights) > 1 and sum(weights) ** 2 < FEW * sum(w * w for w in weights)

    def _table(self, members: np.ndarray, k: int, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block values, sorted, and the item stored under each."""
        values = (block(self.prints[members], k)[:, None] ^ stored).ravel()
        order = np.argsort(values, kind="stable")
        return values[order], np.repeat(members, len(stored))[order]

    def candidates(self, prints: np.ndarray, size: int, step: int = 2048) -> list[tuple[int, int]]:
        """(window, item) pairs within the radius, each once."""
        found: set[tuple[int, int]] = set()
        radius, ahead = self.radius[size], self.asked[size]
        for lo in range(0, len(prints), step):
            some = prints[lo : lo + step]
            for k, (values, members) in enumerate(self.tables[size]):
                asked = (block(some, k)[:, None] ^ ahead).ravel()
                first = np.searchsorted(values, asked, "left")
                n = np.searchsorted(values, asked, "right") - first
                window = np.repeat(np.arange(len(asked)) // len(ahead), n)
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                item = members[at]
                close = np.bitwise_count(some[window] ^ self.prints[item]) <= radius
                found.update(zip((window[close] + lo).tolist(), item[close].tolist(), strict=True))
        return sorted(found)

    def similarity(self, shingles: list[int], item: int) -> float:
        """Weighted Jaccard of two bags of shingles: the weight of what both have over the weight of what either has."""
        own, weights = self.items.shingles[item], self.items.weights
        both = mine = 0.0
        for s, n in Counter(shingles).items():
            w = weights.get(s, 1.0)
            mine += n * w
            both += min(n, own.get(s, 0)) * w
        return both / (self.totals[item] + mine - both)

    def matches(self, hashes: np.ndarray, least: float) -> dict[int, tuple[float, int]]:
        """Items found in a document of these words: the best similarity and the window's first word.

        Only windows that hold a shingle of some item of their size can be similar to one, so fingerprints are made for
        those. Where the document is shorter than an item, its window is the whole document.
        """
        best: dict[int, tuple[float, int]] = {}
        n = len(hashes)
        by_size: dict[int, list[int]] = defaultdict(list)
        of_width = {k: shingle_hashes(hashes, k) for k in self.widths if k <= n}
        for shingles in of_width.values():
            for h in np.flatnonzero(self.table[shingles & np.uint64((1 << 22) - 1)]).tolist():
                for size in self.sizes_of.get(int(shingles[h]), ()):
                    by_size[size].append(h)
        for size, at in by_size.items():
            width, k = min(size, n), min(SHINGLE, size)
            # a hit is in the windows that start up to a window before it: marked by where these begin and end
            marks, hits = np.zeros(n - width + 2, dtype=np.int32), np.array(at)
            np.add.at(marks, np.maximum(hits - (width - k), 0), 1)
            np.add.at(marks, np.minimum(hits, n - width) + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            prints = self._windows(of_width[k], starts, width - k + 1)
            for window, item in self.candidates(prints, size):
                a = int(starts[window])
                got = self.similarity(of_width[k][a : a + width - k + 1].tolist(), item)
                if got >= least and got > best.get(item, (0.0, 0))[0]:
                    best[item] = (got, a)
        return best

    def _windows(self, shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the windows of ``size`` shingles at ``starts``, stretch of windows by stretch."""
        out = np.zeros(len(starts), dtype=np.uint64)
        cuts = np.flatnonzero(np.diff(starts) > size) + 1
        for group in np.split(np.arange(len(starts)), cuts):
            for lo in range(0, len(group), 4096):
                g = starts[group[lo : lo + 4096]]
                first, last = int(g[0]), int(g[-1]) + size
                some = shingles[first:last]
                out[group[lo : lo + 4096]] = window_fingerprints(some, self.weights_of(some), size)[g - first]
        return out


def shared_shingles(items: DataFrame) -> DataFrame:
    """(item_id, shared array<struct<s, n>>): the shingles of each item of ``items(item_id, text)`` that several items hold, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenHashes()
        for batch in batches:
            own = [np.unique(shingle_hashes(word_hashes(text, known), SHINGLE)).view(np.int64) for text in texts(batch.column(1))]
            ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(own) if own else [], pa.int64())], ["item_id", "s"])

    rows = items.select("item_id", "text").mapInArrow(run, "item_id long, s long")
    several = rows.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(several, "s").groupBy("item_id").agg(F.collect_set(F.struct("s", "n")).alias("shared"))


def load_items(benchmark: DataFrame, most_bytes: int = MOST_ITEM_BYTES, radius: int = RADIUS) -> Iterator[Items]:
    """The benchmark in pieces of at most ``most_bytes`` of text, one at a time, so that what the driver and a task hold is bounded.

    Shingles are weighed over the whole benchmark, wherever it is cut. Repeated items stay, each with its own id; a single item
    above the bound is a piece of its own; items of null id are left out, since no match could name them.
    """
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    rows = sized.join(shared_shingles(sized), "item_id", "left").select("item_id", "text", "shared").orderBy("item_id")
    held: list[tuple[int, str]] = []
    spread: dict[int, int] = {}
    size = 0
    for row in rows.toLocalIterator():
        more = len(row["text"].encode("utf-8", "surrogatepass"))
        if held and size + more > most_bytes:
            yield Items.of(held, radius, spread)
            held, size, spread = [], 0, {}
        held.append((row["item_id"], row["text"]))
        spread.update((x["s"] & 0xFFFFFFFFFFFFFFFF, x["n"]) for x in row["shared"] or ())
        size += more
    yield Items.of(held, radius, spread)


def find(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, most_bytes: int = MOST_ITEM_BYTES) -> DataFrame:
    """``docs`` with ``matches array<struct<item_id, similarity, first_word>>``, best first by item id; map only.

    Empty and null texts match nothing. Equal texts have equal matches, rows may repeat. Very long texts are scanned whole, in
    stretches. A column ``matches`` in ``docs`` is replaced; an empty benchmark leaves it empty. The benchmark goes to the tasks in
    pieces of bounded size; if there are several, the documents are written after each, so that a task holds one at a time.
    """
    out, shared = None, None
    for items in load_items(benchmark, most_bytes, radius):
        if out is not None:
            out = written(out, "matched")
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(items)
        out = _matched(docs if out is None else out, shared, least, out is not None)
    return out


def _matched(docs: DataFrame, shared, least: float, again: bool) -> DataFrame:
    """``docs`` with the matches of one piece of the benchmark, after those of the pieces before it."""
    before = docs
    own = [c for c in docs.columns if c != "matches"]
    docs = before.select([F.col(f"`{c}`") for c in own])
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType())]))
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value.prepared(), TokenHashes()
        for batch in batches:
            found = []
            for text, old in zip(texts(batch.column("text")), batch.column("matches").to_pylist() if again else [[]] * batch.num_rows, strict=True):
                rows = [{"item_id": index.items.ids[k], "similarity": got, "first_word": a} for k, (got, a) in index.matches(word_hashes(text, known), least).items()]
                found.append(sorted([*old, *rows], key=lambda r: (r["item_id"], r["first_word"])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(found, arrow)], [*own, "matches"])

    return (before if again else docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("matches", kind)]))
