"""Topical relevance and spam as columns over a lexicon."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.lexicon import DEFAULT, Lexicon, Terms
from quarryline.functions.text import _c, let, search_text


def _java(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~-])", r"\\\1", text)


def term_pattern(term: str) -> str:
    """A pattern that finds the term's words in order, whatever separates them, as whole words."""
    parts = [_java(p) for p in term.replace("‌", " ").split()]
    return r"(?iU)(?<!\w)" + r"[\s\-_\x{200c}]*".join(parts) + r"(?!\w)"


def folded(text) -> Column:
    """A text in lower case as patterns without regard to case see it."""
    return F.lower(F.translate(_c(text), "ſıİ", "sii"))


def holds(text, low, term: str) -> Column:
    """Whether a text holds a term. ``low`` is the text ``folded``: most terms aren't in a text, and a search for their parts tells so without the pattern."""
    parts = [p.lower() for p in term.replace("\u200c", " ").split()]
    return reduce(lambda a, b: a & b, (F.contains(_c(low), F.lit(p)) for p in parts), F.lit(True)) & _c(text).rlike(term_pattern(term))


def _spellings(term: str) -> list[str]:
    """The ways a term can stand in a text whose words are parted by single blanks: each two of its words together, apart, or with an underscore."""
    out = [""]
    for k, part in enumerate(term.replace("\u200c", " ").lower().split()):
        out = [x + gap + part for x in out for gap in (("", " ", "_") if k else ("",))]
    return out


def _plain_term(term: str) -> bool:
    return re.fullmatch(r"[^\W_]+(?:[ \u200c]+[^\W_]+)*", term) is not None


def found_terms(text, terms: tuple[str, ...], low=None) -> Column:
    """Those of ``terms`` that a text holds, by one pass over its words.

    Words and runs of as many words as some term has are looked up among the spellings of all terms; runs are made only where the first word of
    a longer term is there. An underscore beside white space belongs to its word. Terms of other characters than letters and digits are sought by
    their patterns.
    """
    near = folded(text) if low is None else _c(low)
    if not terms:
        return F.array().cast("array<string>")
    plain, odd = [t for t in terms if _plain_term(t)], [t for t in terms if not _plain_term(t)]
    ways = [(w, t) for t in plain for w in _spellings(t)]
    out = F.array_compact(F.array(*(F.when(holds(text, near, t), F.lit(t)) for t in odd))) if odd else F.array().cast("array<string>")
    if not ways:
        return out
    most = max(w.count(" ") for w, _ in ways) + 1
    single, several = sorted({w for w, _ in ways if " " not in w}), sorted({w for w, _ in ways if " " in w})
    strings = lambda xs: F.array(*map(F.lit, xs))
    by_way: dict[str, list[str]] = {}
    for w, t in ways:
        by_way.setdefault(w, []).append(t)
    of_way = F.create_map(*(c for w, ts in by_way.items() for c in (F.lit(w), strings(ts))))
    words = F.split(F.regexp_replace(F.regexp_replace(F.translate(near, "\u200c", " "), "_+", "_"), r"(?U)[^\w\s-]+", " | "), r"(?U)[\s-]+")

    def runs(t: Column) -> Column:
        of = lambda n: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " ")))
        return F.concat(*(F.coalesce(of(n), F.array().cast("array<string>")) for n in range(2, most + 1)))

    def found(t: Column) -> Column:
        met = F.array_intersect(t, strings(single)) if single else F.array().cast("array<string>")
        if several:
            firsts = sorted({w.split(" ")[0] for w in several})
            met = F.concat(met, F.when(F.arrays_overlap(t, strings(firsts)), F.array_intersect(runs(t), strings(several))).otherwise(F.array().cast("array<string>")))
        return F.array_distinct(F.flatten(F.transform(met, lambda w: of_way[w])))

    return F.concat(let(words, found), out)


def matched_terms(text, group: Terms, low=None) -> Column:
    """The distinct terms of a group that a text holds, in the order of the group."""
    return _in_order(found_terms(text, tuple(t for t, _ in group), low), group)


def _in_order(found: Column, group: Terms) -> Column:
    terms = list(dict.fromkeys(t for t, _ in group))
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.array_contains(found, t)) if terms else F.array().cast("array<string>")


def weight_of(found, group: Terms) -> Column:
    """Sum of the weights of a group's terms that are among those found."""
    if not group:
        return F.lit(0.0)
    items = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(float(w)).alias("w")) for t, w in group))
    total = F.aggregate(items, F.lit(0.0), lambda s, x: s + F.when(F.array_contains(_c(found), x["t"]), x["w"]).otherwise(0.0))
    return F.when(F.size(_c(found)) == 0, 0.0).otherwise(total)


def weight(text, group: Terms, low=None) -> Column:
    """Sum of the weights of the terms that a text holds; how often doesn't count."""
    return let(found_terms(text, tuple(t for t, _ in group), low), lambda found: weight_of(found, group)) if group else F.lit(0.0)


def score_relevance(df, name: str, body: str, lexicon: Lexicon = DEFAULT, query_category: str | None = None, query_role: str | None = None):
    """``df`` with relevance (0 to 100), category, role and spam_terms, by the terms in a name and in a body of text."""
    rows = df.withColumns({"__n": search_text(name), "__b": search_text(body)})
    groups = [*lexicon.categories.values(), *lexicon.roles.values(), lexicon.negatives, lexicon.signals, lexicon.spam]
    terms = tuple(dict.fromkeys(t for g in groups for t, _ in g))
    rows = rows.withColumns({"__nf": found_terms("__n", terms), "__bf": found_terms("__b", terms)})
    in_name, in_body = (lambda g: weight_of("__nf", g)), (lambda g: weight_of("__bf", g))
    cats = {k: 2.2 * in_name(t) + 0.8 * in_body(t) for k, t in lexicon.categories.items()}
    roles = {k: 2.0 * in_name(t) + 0.6 * in_body(t) for k, t in lexicon.roles.items()}
    rows = rows.withColumns({f"__c_{k}": v for k, v in cats.items()} | {f"__r_{k}": v for k, v in roles.items()})
    best = F.greatest(F.lit(0.0), F.lit(0.0), *(F.col(f"__c_{k}") for k in cats))
    best_role = F.greatest(F.lit(0.0), F.lit(0.0), *(F.col(f"__r_{k}") for k in roles))
    first = lambda tag, names, top: F.coalesce(*(F.when((F.col(f"__{tag}_{k}") == top) & (top > 0), F.lit(k)) for k in names))
    rows = rows.withColumns({"__best": best, "category": first("c", cats, best), "__negative": in_body(lexicon.negatives) + 1.5 * in_name(lexicon.negatives)})
    rows = rows.withColumns({"__signal": in_body(lexicon.signals), "__spam": in_body(lexicon.spam), "spam_terms": F.slice(F.array_sort(_in_order(F.col("__bf"), lexicon.spam)), 1, 8)})
    wanted = F.col(query_category) if query_category else F.lit(None).cast("string")
    raw = (
        2.2 * F.least(F.col("__best"), F.lit(22.0)) + 1.2 * F.least(F.col("__signal"), F.lit(12.0)) + F.when(F.col("category").isNotNull(), 10.0).otherwise(0.0)
        + F.when((F.col("__n") != "") & (F.col("__best") > 0), 8.0).otherwise(0.0) + F.when(F.col("category") == wanted, 6.0).otherwise(0.0)
        - 6.0 * F.col("__negative") - 12.0 * F.col("__spam")
    )
    score = F.when((F.col("__n") == "") & (F.col("__b") == ""), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.bround(raw, 0).cast("int"))))
    role = F.coalesce(first("r", roles, best_role), F.col(query_role) if query_role else F.lit(None).cast("string"), F.lit("UNKNOWN"))
    rows = rows.withColumns({"relevance": score, "role": role})
    return rows.drop(*(c for c in rows.columns if c.startswith("__")))


def spam_flags(text, links=None, phones=None, lexicon: Lexicon = DEFAULT, spam=None) -> Column:
    """Codes of what makes a page likely spam: its terms, many links in little text, many phones. ``spam``: the weight of its spam terms, where that is known."""
    t = search_text(text)
    links, phones = F.lit(0) if links is None else _c(links), F.lit(1) if phones is None else _c(phones)
    w = weight(t, lexicon.spam) if spam is None else _c(spam)

    def flags(n: Column, w: Column) -> Column:
        out = F.array(
            F.when(w > 0, F.lit("spam_terms")), F.when(w >= 10, F.lit("spam_density")), F.when((links > 250) & (n < 2500), F.lit("many_links")),
            F.when(phones >= 25, F.lit("many_phones")).when((phones >= 12) & (n < 1200), F.lit("dense_phones")),
        )
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_compact(out))

    # terms are sought once, not for each flag that asks for their weight
    return let(F.struct(F.length(t).alias("n"), w.alias("w")), lambda x: flags(x["n"], x["w"]))
