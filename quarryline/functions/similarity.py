"""Similarity of names and the comparison of two business records."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions.lexicon import GENERIC_TOKENS
from quarryline.functions.text import _c, name_key, normalize_fa
from quarryline.functions.texttables import token_sets
from quarryline.functions.urls import is_generic_host, registrable_domain
from quarryline.session import Settings


#: Up to so many characters a text's places are remembered: records of a chunk come again with each record they meet.
_SHORT = 2000


def _made_places(a: str) -> dict[str, int]:
    """Of each character the places where it is, as the bits of one integer; long texts by numpy, since bit by bit takes time with the square of the length."""
    if len(a) > 256:
        codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
        return {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes)}
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    return places


_short_places, _long_places = lru_cache(maxsize=512)(_made_places), lru_cache(maxsize=8)(_made_places)


def _places(a: str) -> dict[str, int]:
    return (_short_places if len(a) <= _SHORT else _long_places)(a)


def _shared_start(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _matched(places: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of ``b`` and a text of ``n`` characters, row by row in the bits of one integer, a row per character of ``b``."""
    row = full = (1 << n) - 1
    for m in [places[c] for c in b if c in places]:
        hit = row & m
        row = (row + hit | row - hit) & full
    return n - row.bit_count()


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: what both begin and end with, and the rest by ``_matched``, the longer by its places."""
    if len(a) < len(b):
        a, b = b, a
    start = _shared_start(a, b)
    end = _shared_start(a[start:][::-1], b[start:][::-1])
    rest = b[start : len(b) - end]
    if not rest:
        return start + end
    places = {c: m >> start for c, m in _places(a).items()} if start else _places(a)
    return start + end + _matched(places, len(a) - start - end, rest)


def indel(a: str, b: str) -> float:
    """1 less the share of insertions and deletions that turn ``a`` into ``b``: twice the longest common subsequence over both lengths."""
    if not a or not b:
        return float(not a and not b)
    return 2 * _lcs(a, b) / (len(a) + len(b))


def _made_words(text: str) -> tuple[frozenset[str], list[str], str, dict[str, int]]:
    """The words of a text, the same sorted and joined, and of each the places it has there, with the space before it."""
    order = sorted(set(text.split()))
    places, at = {}, 0
    for w in order:
        before = 1 if at else 0
        places[w] = (1 << len(w) + before) - 1 << at - before
        at += len(w) + 1
    return frozenset(order), order, " ".join(order), places


_short_words = lru_cache(maxsize=512)(_made_words)


def _words(text: str) -> tuple[frozenset[str], list[str], str, dict[str, int]]:
    return (_short_words if len(text) <= _SHORT else _made_words)(text)


def _lcs_of_rest(a: tuple, only: list[str], p: str, q: str) -> int:
    """``_lcs`` of ``q`` and ``p``, which are the words ``only`` of ``a``: by the places of all its words, where those of the others match nothing."""
    _, order, text, at = a
    if len(text) > _SHORT:
        return _lcs(p, q)
    kept = 0
    for w in only:
        kept |= at[w]
    # what is left begins with a word, not with the space before it
    if only[0] != order[0]:
        kept &= kept - 1
    return _matched({c: m & kept for c, m in _places(text).items()}, len(text), q)


def token_set(a: str | None, b: str | None) -> float:
    """Token-set similarity, 0 to 1: what both share, with and without the rest of each side, compared by ``indel``."""
    x, y = _words(a or ""), _words(b or "")
    if not x[0] or not y[0]:
        return 0.0
    both = x[0] & y[0]
    if not both:
        return indel(x[2], y[2])
    if len(both) in (len(x[0]), len(y[0])):
        return 1.0
    only_a, only_b = [w for w in x[1] if w not in both], [w for w in y[1] if w not in both]
    s, p, q = sum(map(len, both)) + len(both) - 1, " ".join(only_a), " ".join(only_b)
    shared = s + 1
    # 2 * n / m * m / 2: as by ``indel``, to the last bit
    n = _lcs_of_rest(x, only_a, p, q) if len(p) >= len(q) else _lcs_of_rest(y, only_b, q, p)
    lcs = 2 * n / (len(p) + len(q)) * (len(p) + len(q)) / 2
    together = 2 * (lcs + shared) / (len(p) + len(q) + 2 * shared)
    with_a, with_b = 2 * s / (2 * s + 1 + len(p)), 2 * s / (2 * s + 1 + len(q))
    return max(together, with_a, with_b)


#: Names repeat, so pairs of them do; a process remembers the last ones, short texts only.
_remembered = lru_cache(maxsize=1 << 15)(token_set)


def _similarity(x: str | None, y: str | None) -> float:
    return (_remembered if len(x or "") + len(y or "") <= 200 else token_set)(x, y)


def _token_sets(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def token_set_ratio(a, b) -> Column:
    return F.pandas_udf(_token_sets, "double")(_c(a), _c(b))


def distinctive_tokens(name, generic: tuple[str, ...] = tuple(GENERIC_TOKENS)) -> Column:
    """Words of a name of three characters at least that aren't digits or general words."""
    words = F.split(F.lower(normalize_fa(name, "remove")), "(?U)[\\s\u200c\u200f\\-_.،,()/\\\\]+")
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$"))
    return F.array_distinct(F.array_except(kept, F.array(*map(F.lit, generic))))


def core(name, generic: tuple[str, ...] = tuple(GENERIC_TOKENS)) -> Column:
    return F.array_join(F.array_sort(distinctive_tokens(name, generic)), " ")


def phone_similarity(a, b) -> Column:
    """1 if phones are shared, 0.6 if two of one length differ in a digit, else 0."""
    one_off = lambda x, y: (F.length(x) == F.length(y)) & (
        F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: (p != q).cast("int")), F.lit(0), lambda s, v: s + v) == 1
    )
    near = F.exists(_c(a), lambda x: F.exists(_c(b), lambda y: one_off(x, y)))
    return F.when(F.arrays_overlap(_c(a), _c(b)), 1.0).when(near, 0.6).otherwise(0.0)


def compare(pairs: DataFrame, generic: tuple[str, ...] = tuple(GENERIC_TOKENS), settings: Settings = Settings()) -> DataFrame:
    """``pairs`` with score, verdict (merge, review or null) and reasons of the records in its columns a_* and b_*: name, city, address, domain, phones."""
    rows = compared(pairs.withColumns({f"__{s}_{k}": x for s in "ab" for k, x in sides(f"{s}_", generic).items()}), settings)
    return rows.drop(*(x for x in rows.columns if x.startswith("__")))


def sides(before: str = "", generic: tuple[str, ...] = tuple(GENERIC_TOKENS)) -> dict[str, Column]:
    """What is compared of a record in the columns ``before``*: keys of name, city and address, the core, the domain."""
    keys = {k: name_key(f"{before}{k}") for k in ("name", "city", "address")}
    return keys | {"core": core(f"{before}name", generic), "own": registrable_domain(f"{before}domain")}


def own_host(own) -> Column:
    """A domain that can be shared by one business only, else null."""
    return F.when(~is_generic_host(own), _c(own))


def compared(keyed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``keyed`` with score, verdict and reasons by its columns __a_* and __b_*, which are of ``sides``, and a_phones, b_phones.

    Only names, cores and addresses are compared in Python; the ladder of rules is columns.
    """
    c = F.col
    same_domain = F.coalesce((c("__a_own") == c("__b_own")) & ~is_generic_host("__a_own"), F.lit(False))
    with_core = (c("__a_core") != "") & (c("__b_core") != "")
    rows = keyed.withColumns({
        "__shared": F.coalesce(F.arrays_overlap("a_phones", "b_phones"), F.lit(False)), "__dom": same_domain,
        "__raw": token_set_ratio("__a_name", "__b_name"), "__core": F.when(with_core, token_set_ratio("__a_core", "__b_core")),
        "__addr": F.when((c("__a_address") != "") & (c("__b_address") != ""), token_set_ratio("__a_address", "__b_address")).otherwise(0.0),
        "__city": (c("__a_city") == c("__b_city")) & (c("__a_city") != ""), "__city_unknown": (c("__a_city") == "") | (c("__b_city") == ""),
        "__exact": (c("__a_name") == c("__b_name")) & (c("__a_name") != ""),
    })
    return laddered(rows, settings)


#: What ``laddered`` judges a pair by.
SIGNALS = T.StructType([T.StructField(k, t) for t, ks in ((T.BooleanType(), "__shared __dom __city __city_unknown __exact"), (T.DoubleType(), "__raw __core __addr")) for k in ks.split()])


def _known_similarity(texts: pa.Array, n: int, at: int, same: bool):
    """Similarity of a text of the first ``n`` with one of those from ``at`` on, made once for all that have the same two."""
    coded = pc.dictionary_encode(pc.fill_null(texts, ""))
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    left, x_of = np.unique(codes[:n], return_inverse=True)
    right, y_of = np.unique(codes[at:], return_inverse=True)
    table = [None]

    def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        i, j = x_of[x], y_of[y - at]
        if table[0] is None:
            # few of all pairs are compared one by one
            asked = np.unique(i * len(right) + j) if len(x) < len(left) * len(right) else None
            if asked is not None and (len(asked) <= 8 or len(asked) * 8 < len(left) * len(right)):
                found = np.array([_similarity(words[left[k // len(right)]], words[right[k % len(right)]]) for k in asked.tolist()], float)
                return found[np.searchsorted(asked, i * len(right) + j)]
            table[0] = token_sets([words[k] for k in left], [words[k] for k in right], same)
        return table[0][i, j]

    return codes, of


def signals_of(met):
    """The columns of ``SIGNALS`` for pairs of the records of a meeting, which have what ``sides`` names, the domain as of ``own_host``, and phones."""
    column = lambda k: met.rows.column(k)
    (name, raw), (core_, cores), (address, addresses) = (_known_similarity(column(k), met.n, met.at, met.same) for k in ("name", "core", "address"))
    city, own = (pc.dictionary_encode(column(k)).indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("city", "own"))
    lengths = {k: pc.fill_null(pc.utf8_length(column(k)), 0).to_numpy(zero_copy_only=False) > 0 for k in ("name", "core", "address", "city")}

    def of(x: np.ndarray, y: np.ndarray) -> list:
        there = {k: v[x] & v[y] for k, v in lengths.items()}
        cored, placed = there["core"], there["address"]
        similar = lambda f, ok: _where(f, x, y, ok)
        flags = [met.overlap("phones", x, y), (own[x] == own[y]) & (own[x] >= 0), (city[x] == city[y]) & there["city"], ~there["city"], (name[x] == name[y]) & there["name"]]
        return [*map(pa.array, flags), pa.array(raw(x, y)), pa.array(similar(cores, cored), mask=~cored), pa.array(similar(addresses, placed))]

    return of


def _where(f, x: np.ndarray, y: np.ndarray, ok: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    if ok.any():
        out[ok] = f(x[ok], y[ok])
    return out


def laddered(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``rows`` with score, verdict and reasons by the columns of ``SIGNALS``."""
    c = F.col
    rows = rows.withColumn("__name", F.when(c("__core") < 0.75, F.least(c("__raw"), 0.35 + 0.64 * c("__core"))).otherwise(c("__raw")))
    name, addr, ok = c("__name"), c("__addr"), c("__city") | c("__city_unknown")
    at_least = lambda x: c("__core").isNull() | (c("__core") >= x)
    anchor = c("__shared") | c("__dom") | (addr >= 0.85) | (c("__exact") & ok) | (F.coalesce(c("__core"), F.lit(0.0)) >= 0.88) & ok
    rung = lambda condition, x: F.when(condition, F.lit(x)).otherwise(0.0)
    score = F.greatest(
        rung(c("__shared") & ((name >= 0.72) | (addr >= 0.70) | c("__exact")), 0.90), rung(c("__dom"), 0.85), rung(ok & (name >= 0.90) & at_least(0.80), 0.88),
        rung(ok & (name >= 0.80) & at_least(0.70), 0.70), rung(ok & (F.coalesce(c("__core"), F.lit(0.0)) >= 0.95) & (name >= 0.50), 0.66),
        rung((name >= 0.95) & (addr >= 0.85), 0.92), 0.45 * name + 0.25 * addr + F.when(c("__city"), 0.20).otherwise(0.0),
    )
    rows = rows.withColumn("score", F.least(F.lit(1.0), F.bround(F.when(anchor, score).otherwise(F.least(score, F.lit(0.55))), 4)))
    verdict = F.when(c("score") >= settings.merge_at, "merge").when(c("score") >= settings.review_at, "review")
    said = {
        "shared phone": c("__shared"), "shared domain": c("__dom"), "equal name": c("__exact"), "equal core": F.coalesce(c("__core"), F.lit(0.0)) >= 0.95, "alike address": addr >= 0.85,
        "different core": c("__core") < 0.75, "no anchor": ~anchor,
    }
    rows = rows.withColumn("reasons", F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(False)), F.lit(k)) for k, x in said.items()))))
    return rows.withColumn("verdict", verdict)
