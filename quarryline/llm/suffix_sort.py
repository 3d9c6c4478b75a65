"""Suffix sorting by induction, with queues on disk.

Suffixes that are smaller than their neighbours on both sides ("leftmost
smaller") are sorted first: their substrings by one induction, their order by
recursion on the string of their ranks, which is sorted in memory by doubling
once its alphabet is large. A second induction derives all other suffixes. An
induction is two sweeps over the alphabet in which every bucket of a priority
queue gives its suffixes in order, and hands each suffix's predecessor to a
later bucket; whole waves of a bucket are handled at once. The text is mapped
from disk and buckets spill to disk past a bound, so that a shard may be
larger than memory.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


class BucketQueue:
    """A priority queue of suffix positions by first byte, in order of arrival within one; spills past ``most`` entries held."""

    def __init__(self, folder: str, most: int = 4_000_000):
        self.folder, self.most, self.held = tempfile.mkdtemp(dir=folder), most, 0
        self.memory: list[list[np.ndarray]] = [[] for _ in range(257)]
        self.files: list[list[str]] = [[] for _ in range(257)]
        self.made = 0

    def push(self, keys: np.ndarray, positions: np.ndarray) -> None:
        """Adds positions to the buckets of their keys; those of one key keep their order."""
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, positions = keys[order], positions[order]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for first, part in zip(np.concatenate(([0], cuts)), np.split(positions, cuts), strict=True):
            self.memory[int(keys[first])].append(part)
        self.held += len(positions)
        if self.held > self.most:
            self._spill()

    def _spill(self) -> None:
        for key, parts in enumerate(self.memory):
            if parts:
                self.made += 1
                path = os.path.join(self.folder, f"bucket-{key}-{self.made}.npy")
                np.save(path, np.concatenate(parts))
                self.files[key].append(path)
                parts.clear()
        self.held = 0

    def pop(self, key: int) -> list[np.ndarray]:
        """All that the bucket holds, in order of arrival, and empties it."""
        out = []
        for path in self.files[key]:
            out.append(np.load(path))
            os.unlink(path)
        self.files[key] = []
        out += self.memory[key]
        self.held -= sum(map(len, self.memory[key]))
        self.memory[key] = []
        return out


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last one isn't."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # last position of each run
    small = np.zeros(len(ends), dtype=bool)
    small[:-1] = text[ends[:-1]] < text[ends[:-1] + 1]
    return np.repeat(small, np.diff(np.append(-1, ends)))


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, folder: str, queue_most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The larger and the smaller suffixes by bucket, induced from ``seeds`` in their order."""
    n = len(text)
    larger: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 257
    smaller = list(larger)
    queue, given = BucketQueue(folder, queue_most), BucketQueue(folder, queue_most)
    given.push(text[seeds], seeds)
    queue.push(text[n - 1 :], np.array([n - 1]))  # the last suffix is the least of its bucket

    def hand_on(wave: np.ndarray, kind: bool) -> None:
        before = wave[wave > 0] - 1
        before = before[small[before] == kind]
        queue.push(text[before], before)

    for key in range(257):
        waves = []
        while parts := queue.pop(key):
            wave = np.concatenate(parts)
            waves.append(wave)
            hand_on(wave, False)
        if waves:
            larger[key] = np.concatenate(waves)
        for part in given.pop(key):
            hand_on(part, False)
    for key in range(256, -1, -1):
        waves = []
        while parts := queue.pop(key):
            wave = np.concatenate(parts)
            waves.append(wave)
            hand_on(wave, True)
        if waves:
            smaller[key] = np.concatenate(waves)[::-1]
        hand_on(larger[key][::-1], True)
    return larger, smaller


def _doubling(ranks: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of ranks, by sorting on twice as many of them each time."""
    n, step = len(ranks), 1
    rank = ranks.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while step < n:
        second = np.zeros(n, dtype=np.int64)
        second[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.zeros(n, dtype=np.int64)
        fresh[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        rank = fresh
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    return order


def suffix_order(text: np.ndarray, folder: str, queue_most: int = 4_000_000) -> np.ndarray:
    """Positions of all suffixes of ``text`` (values 0 to 256) in their order; a suffix sorts before its extensions."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = _types(text)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(seeds) > 1:
        larger, smaller = _induce(text, small, seeds, folder, queue_most)
        is_seed = np.zeros(n + 1, dtype=bool)
        is_seed[seeds] = True
        by_part = np.concatenate([x[is_seed[x]] for x in smaller])
        del larger, smaller
        length = np.zeros(n, dtype=np.int64)
        length[seeds] = np.append(np.diff(seeds) + 1, n - seeds[-1] + 1)  # with the next seed's first value
        ranks = np.zeros(n, dtype=np.int64)
        ranks[by_part] = np.cumsum(np.append(0, ~_same(text, by_part[:-1], by_part[1:], length)))
        reduced = ranks[seeds]
        if int(reduced.max()) + 1 < len(seeds):
            seeds = seeds[suffix_order(reduced, folder, queue_most) if reduced.max() < 257 else _doubling(reduced)]
        else:
            seeds = by_part
    larger, smaller = _induce(text, small, seeds, folder, queue_most)
    return np.concatenate([x for pair in zip(larger, smaller, strict=True) for x in pair])


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the substrings at a and b, of these lengths, are equal."""
    n = len(text)
    same = length[a] == length[b]
    at = np.flatnonzero(same)
    step = 0
    while len(at):
        x, y = a[at] + step, b[at] + step
        inside = (x < n) & (y < n)
        differ = np.ones(len(at), dtype=bool)
        differ[inside] = text[x[inside]] != text[y[inside]]
        ended = step >= length[a[at]] - 1
        differ &= ~(ended & ~inside & (x == y))
        same[at[differ]] = False
        at = at[~differ & ~ended]
        step += 1
    return same


def repeated(strings: list[bytes], width: int, queue_most: int = 4_000_000) -> list[np.ndarray]:
    """For each string the starts of those of its substrings of ``width`` bytes that occur elsewhere in any of them."""
    sizes = np.array([len(s) + 1 for s in strings])
    starts = np.append(0, np.cumsum(sizes))
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "text")
        text = np.memmap(path, dtype=np.uint16, mode="w+", shape=(int(starts[-1]),)) if len(strings) else np.zeros(0, np.uint16)
        for s, at in zip(strings, starts, strict=False):
            text[at : at + len(s)] = np.frombuffer(s, dtype=np.uint8)
            text[at : at + len(s)] += 1  # 0 ends a string
        order = suffix_order(text, folder, queue_most)
        room = np.repeat(starts[1:] - 1, sizes) - np.arange(int(starts[-1]))  # bytes to the end of the string
        order = order[room[order] >= width]
        same = common(text, order[:-1], order[1:], width)
        hit = np.zeros(int(starts[-1]) + 1, dtype=bool)
        hit[order[:-1][same]] = True
        hit[order[1:][same]] = True
        del text
    return [np.flatnonzero(hit[a : b - 1]) for a, b in zip(starts, starts[1:], strict=False)]


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the common prefix of the suffixes at a and b, which both have ``width`` values left, is as long."""
    same = np.ones(len(a), dtype=bool)
    at = np.arange(len(a))
    # the far end differs first for strings that are alike by chance, so a few probes come before the full comparison
    for step in [width - 1, width // 2, width // 4, *range(width)]:
        if not len(at):
            break
        ok = text[a[at] + step] == text[b[at] + step]
        same[at[~ok]] = False
        at = at[ok]
    return same
