"""Text normalisation as columns: digits, white space, Persian letters, comparison keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are equated, dropped or spaced.
PERSIAN_DIGITS, ARABIC_DIGITS, ASCII_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "0123456789"
ZERO_WIDTH = "​‌‍‎‏﻿"
ZWNJ, TATWEEL, NBSP = "‌", "ـ", " "
DIACRITICS = "ًٌٍَُِّْٰٕٓٔ"
LETTERS_FROM, LETTERS_TO = "يىﻯكﻙۀةؤإأٱئ", "یییککههوااای"
LAM_ALEF = ("ﻻ", "لا")
LEGAL_SUFFIXES = (
    "سهامی خاص", "سهامی عام", "با مسئولیت محدود", "مسئولیت محدود", "تعاونی", "خصوصی", "محدود", "شرکت", "موسسه", "مؤسسه", "بازرگانی", "تجارت", "گروه",
    "صنایع", "کارخانه",
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f) -> Column:
    """``f`` of an expression that it uses many times, evaluated once; plain nesting would copy it into the plan each time."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def to_ascii_digits(s) -> Column:
    """Persian and Arabic-Indic digits as ASCII; the length stays."""
    return F.translate(_c(s), PERSIAN_DIGITS + ARABIC_DIGITS, ASCII_DIGITS * 2)


def has_persian(s) -> Column:
    return F.coalesce(_c(s).rlike("[؀-ۿ]"), F.lit(False))


def collapse_ws(s) -> Column:
    """Runs of white space as one space, trimmed; null is empty."""
    return F.btrim(F.regexp_replace(F.coalesce(_c(s), F.lit("")), r"(?U)[\s\x{a0}]+", " "))


def remove_zero_width(s) -> Column:
    return F.translate(_c(s), ZERO_WIDTH, "")


def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def nfc(s) -> Column:
    """Canonical composition; texts in it already pass unchanged."""
    return F.pandas_udf(_nfc, "string")(_c(s))


def normalize_fa(s, zwnj: str = "keep", digits: bool = True, strip: bool = True, composed: bool = True) -> Column:
    """Equates Arabic and Persian letters, drops diacritics and tatweel. ``composed=False`` composes first, in Python."""
    x = F.coalesce(_c(s), F.lit(""))
    x = x if composed else nfc(x)
    x = F.replace(F.translate(x, LETTERS_FROM + DIACRITICS + TATWEEL, LETTERS_TO), F.lit(LAM_ALEF[0]), F.lit(LAM_ALEF[1]))
    if zwnj == "space":
        x = F.translate(x, ZWNJ, " ")
    elif zwnj == "remove":
        x = F.translate(x, ZWNJ, "")
    else:
        x = F.translate(x, ZERO_WIDTH.replace(ZWNJ, ""), "")
    x = to_ascii_digits(x) if digits else x
    x = F.translate(x, NBSP, " ")
    return collapse_ws(x) if strip else x


def light_key(s) -> Column:
    """Lower-case word characters only."""
    return F.regexp_replace(F.lower(normalize_fa(s, "remove")), "(?U)[^\\w؀-ۿ]+", "")


def name_key(s, suffixes: tuple[str, ...] = LEGAL_SUFFIXES) -> Column:
    """``light_key`` less one legal suffix, the longest that leaves three characters at least."""
    return let(light_key(s), lambda key: _less_suffix(key, suffixes))


def _less_suffix(key: Column, suffixes: tuple[str, ...]) -> Column:
    out = None
    for suffix in sorted({x.translate({ord(a): b for a, b in zip(LETTERS_FROM, LETTERS_TO, strict=True)}).replace(" ", "") for x in suffixes}, key=lambda x: (-len(x), x)):
        fits = key.endswith(suffix) & (F.length(key) - len(suffix) >= 3)
        cut = F.substring(key, F.lit(1), F.length(key) - len(suffix))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return key if out is None else out.otherwise(key)


def search_text(s) -> Column:
    return normalize_fa(s, "space")


def truncate(s, n: int) -> Column:
    """At most ``n`` characters, the last an ellipsis if something is cut."""
    x = F.coalesce(_c(s), F.lit(""))
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("…"))).otherwise(x)


def digits_only(s) -> Column:
    return F.regexp_replace(to_ascii_digits(F.coalesce(_c(s), F.lit(""))), r"[^0-9]", "")


def no_space(s) -> Column:
    return F.regexp_replace(normalize_fa(s, "remove"), "(?U)[\\s‌ -]+", "")


def snippet_around(s, start, end, window: int = 90) -> Column:
    """The characters from ``window`` before ``start`` (0-based) to ``window`` after ``end``, collapsed."""
    left = F.greatest(_c(start) - window, F.lit(0))
    return collapse_ws(F.substring(_c(s), left + 1, _c(end) + window - left))


def strip_html(s) -> Column:
    """Text of a page by replacement: dropped elements, comments, line ends at blocks, tags as spaces, the common references decoded."""
    x = F.coalesce(_c(s), F.lit(""))
    for pattern, to in (
        (r"(?is)<(script|style|noscript|svg|template)\b[^>]*>.*?</\1\s*>", " "),
        (r"(?s)<!--.*?-->", " "),
        (r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n"),
        (r"(?s)<[^>]+>", " "),
    ):
        x = F.regexp_replace(x, pattern, to)
    for name, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(to))
    return x


def clean_name(s) -> Column:
    """A name without its label and punctuation at the ends; null if it can't be one: too short or long, mostly digits."""
    x = F.regexp_replace(collapse_ws(s), r"^[\s\-–—:،.]+|[\s\-–—:،.]+$", "")
    return let(x, _usable_name)


def _usable_name(x: Column) -> Column:
    x = F.regexp_replace(x, "^(نام|عنوان|نام شرکت|نام کسب\\s*وکار)\\s*[:：]\\s*", "")
    digits = F.length(digits_only(x))
    phone = to_ascii_digits(x).rlike(r"(?:\+98|0098|0)[0-9\s\-.()]{8,}[0-9]")
    ok = F.length(x).between(3, 200) & ~((digits >= 7) & (digits >= 0.6 * F.length(x))) & ~phone
    return F.when(ok, x)


def is_meaningfully_different(current, new, attribute: str) -> Column:
    """Whether a later value contradicts the first one: by domain, by name key, or for addresses by neither holding the other."""
    from quarryline.functions.urls import registrable_domain

    if attribute == "website":
        return ~registrable_domain(current).eqNullSafe(registrable_domain(new))
    a, b = name_key(current), name_key(new)
    if attribute == "address":
        return (a != b) & ~F.contains(a, b) & ~F.contains(b, a)
    return a != b
