"""Shingle sets of texts and their MinHash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

from quarryline.llm.common import TokenHashes, shingle_hashes, word_hashes

#: Shingles of one step of a signature, which bounds memory for very long texts.
_STEP = 2048


def shingle_set(text: str, known: TokenHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` lower-case words; a shorter text is one run, one without words none."""
    return np.unique(shingle_hashes(word_hashes(text, known), size))


class MinHash:
    """``trees`` signatures of ``depth`` values each, from multiply-shift hashes with fixed odd factors."""

    def __init__(self, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.factors = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """(trees, depth) smallest hash of the set under each function; an empty set has the largest values."""
        low = np.full(self.trees * self.depth, np.uint64(0xFFFFFFFFFFFFFFFF))
        with np.errstate(over="ignore"):
            for at in range(0, len(shingles), _STEP):
                values = shingles[at : at + _STEP, None] * self.factors
                values += self.offsets
                np.minimum(low, values.min(axis=0), out=low)
        return low.reshape(self.trees, self.depth)


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())
