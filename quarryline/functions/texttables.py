"""Token-set similarity of many texts with many others at once: the same numbers as ``similarity.token_set``."""

from __future__ import annotations

import numpy as np

#: A table has up to so many places, and up to so many bits over all its characters; a longer text has one of its own.
_PLACES, _BITS = 1 << 18, 1 << 28


def _number(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Text:
    """The words of a text, sorted, each once; and the same joined."""

    def __init__(self, text: str):
        self.words = sorted(set(text.split()))
        self.joined = " ".join(self.words)
        self.n = len(self.joined)


class _Table:
    """Texts one after the other in the bits of one integer, a place that is never matched after each: the places of each character, and those of each word of a text."""

    def __init__(self, texts: list[_Text]):
        self.starts = np.concatenate([[0], np.cumsum([t.n + 1 for t in texts])])
        codes = np.full(self.starts[-1], -1, np.int64)
        for t, at in zip(texts, self.starts.tolist(), strict=False):
            codes[at : at + t.n] = _codes(t.joined)
        self.full = _number(codes >= 0)
        self.places = {chr(c): _number(codes == c) for c in np.unique(codes).tolist() if c >= 0}
        # the places of a word are those of the space before it, too; the place after a text is as of one more
        self.known: dict[str, int] = {}
        ids, spans, self.begins = [], [], []
        for t in texts:
            self.begins.append(len(ids))
            for k, w in enumerate(t.words):
                ids.append(self.known.setdefault(w, len(self.known)))
                spans.append(len(w) + (k > 0))
            ids.append(-1)
            spans.append(1)
        self.begins, self.ids, self.spans = np.array([*self.begins, len(ids)]), np.array(ids), np.array(spans)
        self.at = np.cumsum(self.spans) - self.spans
        self.length = np.array([len(w) for w in self.known], np.int64)
        self.have = np.zeros((len(self.known) + 1, len(texts)), bool)
        self.have[self.ids, np.repeat(np.arange(len(texts)), np.diff(self.begins))] = True
        self.words = np.array([len(t.words) for t in texts])
        self.without: dict[int, int] = {}

    def _without(self, word: int) -> int:
        """The places of the texts that don't have a word."""
        found = self.without.get(word)
        if found is None:
            found = _number(np.repeat(~self.have[word], np.diff(self.starts))) & self.full
            if (len(self.without) + 1) * int(self.starts[-1]) <= _BITS:
                self.without[word] = found
        return found

    def _rest(self, y: _Text, ids: list[int | None], x: int) -> list[int]:
        """The places at which each character of ``y`` is met in the first ``x`` texts, by the words that ``y`` doesn't share with the text of a place."""
        there = np.zeros(len(self.known) + 1, bool)
        there[[k for k in ids if k is not None]] = True
        last, begins = self.begins[x], self.begins[:x]
        left = ~there[self.ids[:last]]
        flags = np.repeat(left, self.spans[:last])
        # what is left begins with a word, not with the space before it
        lead = np.minimum.reduceat(np.where(left, np.arange(last), last), begins)
        flags[self.at[lead[lead != begins]]] = False
        kept, seen, out, of = _number(flags) & self.full, 0, [], self.places.get
        for k, w in enumerate(ids):
            own = kept if w is None else kept & self._without(w)
            if seen:
                out.append(of(" ", 0) & own & seen)
            out += [of(c, 0) & own for c in y.words[k]] if own else []
            if seen != self.full:
                seen |= self.full if w is None else self._without(w)
        return out

    def met(self, y: _Text, x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ``y`` and each of the first ``x`` texts: the longest common subsequence of the words they don't share, how many they share, and the characters of these."""
        ids = [self.known.get(w) for w in y.words]
        found = [k for k in ids if k is not None]
        have = self.have[found, :x].astype(np.int32)
        count, chars = have.sum(0), (self.length[found][:, None] * have).sum(0)
        row = full = self.full & (1 << int(self.starts[x])) - 1
        # texts of which one has all words of the other need no comparison
        apart = (count > 0) & (count < len(ids)) & (count < self.words[:x])
        for m in self._rest(y, ids, x) if apart.any() else [self.places[c] for c in y.joined if c in self.places]:
            hit = row & m
            row = (row + hit | row ^ hit) & full
        ended = (row ^ full).to_bytes(-(-int(self.starts[x]) // 8), "little")
        bits = np.unpackbits(np.frombuffer(ended, np.uint8), bitorder="little")
        return np.add.reduceat(bits, self.starts[:x], dtype=np.int64), count, chars


def _grouped(texts: list[_Text]) -> list[tuple[int, int]]:
    """Texts that one table has: from, to."""
    most = min(_PLACES, _BITS // (1 + len(set().union(*(t.joined for t in texts)))))
    out, at, places = [], 0, 0
    for k, t in enumerate(texts):
        if k > at and places + t.n + 1 > most:
            out.append((at, k))
            at, places = k, 0
        places += t.n + 1
    return [*out, (at, len(texts))]


def _shorter(xs: list[_Text], ys: list[_Text], less: int) -> np.ndarray:
    """Of all x that have at least ``less`` characters less than y what they have in common with it; both are sorted by length and have words."""
    out, lengths = np.zeros((3, len(xs), len(ys)), np.int64), np.array([t.n for t in xs])
    for begin, end in _grouped(xs):
        table = _Table(xs[begin:end])
        for k, y in enumerate(ys):
            x = int(np.searchsorted(lengths[begin:end], y.n - less, "right"))
            if x:
                out[:, begin : begin + x, k] = table.met(y, x)
    return out


def token_sets(xs: list[str], ys: list[str], same: bool = False) -> np.ndarray:
    """``similarity.token_set`` of each of ``xs`` with each of ``ys``, which are the same list if ``same``: a text is compared with all that aren't longer at once."""
    out = np.zeros((len(xs), len(ys)))
    a, b = ([(k, t) for k, t in sorted(enumerate(map(_Text, ts)), key=lambda x: x[1].n) if t.words] for ts in (xs, ys))
    if not a or not b:
        return out
    (i, left), (j, right) = (([k for k, _ in s], [t for _, t in s]) for s in (a, b))
    n_x, n_y = np.array([t.n for t in left])[:, None], np.array([t.n for t in right])[None]
    one = _shorter(left, right, 0)
    other = (one if same else _shorter(right, left, 1)).transpose(0, 2, 1)
    n, count, chars = np.where(n_x <= n_y, one, other)
    whole = (count == np.array([len(t.words) for t in left])[:, None]) | (count == np.array([len(t.words) for t in right])[None])
    p, q, s = n_x - chars - count, n_y - chars - count, chars + count - 1
    shared, rest = s + 1, np.where(whole, 1, p + q)
    with np.errstate(divide="ignore", invalid="ignore"):  # where no word is shared
        met = np.maximum(np.maximum(2 * (2 * n / rest * rest / 2 + shared) / np.where(whole, 1, p + q + 2 * shared), 2 * s / (2 * s + 1 + p)), 2 * s / (2 * s + 1 + q))
    out[np.ix_(i, j)] = np.where(whole, 1.0, np.where(count > 0, met, 2 * n / (n_x + n_y)))
    return out
