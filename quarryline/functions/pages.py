"""Business candidates in pages: structured data, listing blocks, and the page as a whole."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import phones as P
from quarryline.functions.fingerprint import signature
from quarryline.functions.text import _c, clean_name, collapse_ws

# Kinds of organisations, elements that hold one entry of a listing, headings, hosts of profiles, markers of addresses.
ORGANISATIONS = (
    "organization", "localbusiness", "store", "corporation", "wholesaler", "distributor", "manufacturer", "pharmacy", "medicalbusiness",
    "healthandbeautybusiness", "beautysalon", "foodestablishment", "onlinestore", "professionalservice", "ngo", "company", "retail",
)
ENTRY_TAGS = ("article", "li", "tr", "section")
ENTRY_CLASSES = ("item", "card", "company", "business", "result", "listing", "ads", "ad-")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "strong", "b", "dt")
SOCIAL = ("instagram.com", "t.me", "telegram.me", "facebook.com", "twitter.com", "x.com", "linkedin.com", "aparat.com", "youtube.com", "wa.me")
ADDRESS_LABELS = ("آدرس", "نشانی", "ادرس")
ADDRESS_MARKERS = ("آدرس", "نشانی", "خیابان", "بلوار", "کوچه", "پلاک", "میدان", "جاده", "بزرگراه", "شهرک", "استان", "شهرستان", "فاز", "طبقه")
_STOP = r"تلفن|همراه|موبایل|فکس|نمابر|وب\s*سایت|ایمیل|ساعات|کد\s*پستی"
_FAST_PHONE = re.compile(r"0\d{2}[\s\-.]?\d{7,8}|\+?98\d{10}|09\d{9}")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Element]:
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out.append(e)
            elif e.tag not in ("script", "style", "noscript", "template"):
                todo.extend(reversed(e.children))
        return " ".join(" ".join(out).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {})
        self.stack = [self.root]

    def updatepos(self, i, j):
        return j  # nobody asks for lines and columns

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(e)
        if tag not in _VOID:
            self.stack.append(e)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def tree(html: str) -> Element:
    parser = _Tree()
    parser.feed(html or "")
    return parser.root


def selected(root: Element, kinds: list[tuple[str | None, str | None, str | None]]) -> Iterator[Element]:
    """Elements below ``root``, in order, of any of the kinds (inside, tag, class); inside is a tag, or a tag and a class with a dot."""

    def fits(e: Element, tag: str | None, name: str | None) -> bool:
        return (not tag or e.tag == tag) and (not name or name in e.attrs.get("class", "").split())

    todo = [(c, ()) for c in reversed(root.children) if isinstance(c, Element)]
    while todo:
        e, above = todo.pop()
        for inside, tag, name in kinds:
            outer, _, outer_name = (inside or "").partition(".")
            if fits(e, tag, name) and (not inside or any(fits(x, outer, outer_name) for x in above)):
                yield e
                break
        todo.extend((c, (*above, e)) for c in reversed(e.children) if isinstance(c, Element))


def json_ld(root: Element) -> list[dict]:
    """Objects of a page's structured data, lists and graphs laid flat; blocks that don't parse are passed over."""
    out: list[dict] = []
    for e in root.walk():
        if e.tag == "script" and "ld+json" in e.attrs.get("type", ""):
            try:
                todo = [json.loads(re.sub(r",\s*([}\]])", r"\1", "".join(c for c in e.children if isinstance(c, str))))]
            except ValueError:
                continue
            while todo:
                x = todo.pop(0)
                if isinstance(x, list):
                    todo = x + todo
                elif isinstance(x, dict):
                    out.append(x)
                    todo = list(x["@graph"]) + todo if isinstance(x.get("@graph"), list) else todo
    return out


def _many(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def organisation(x: dict) -> dict | None:
    """The candidate that an object describes, None unless it is an organisation."""
    kinds = " ".join(str(k).lower() for k in _many(x.get("@type")))
    if not any(k in kinds for k in ORGANISATIONS):
        return None
    listed = []
    for field in ("telephone", "phone", "contactPoint"):
        for v in _many(x.get(field)):
            listed += [str(n) for n in _many(v.get("telephone"))] if isinstance(v, dict) else [str(v)]
    place = next((a for a in _many(x.get("address"))), None)
    parts = [place.get(k) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode")] if isinstance(place, dict) else [place]
    person = next((p for k in ("founder", "owner", "employee") for p in _many(x.get(k))), None)
    return {
        "name": x.get("name") or x.get("legalName"), "text": " \n ".join(listed), "address": "، ".join(str(p) for p in parts if p) or None, "website": x.get("url"),
        "owner": person.get("name") if isinstance(person, dict) else person, "social": [str(u) for u in _many(x.get("sameAs"))][:8],
        "city": place.get("addressLocality") if isinstance(place, dict) else None,
    }


def _links(e: Element) -> tuple[str | None, list[str]]:
    """The first link to an own site, and up to five profiles."""
    from urllib.parse import urlparse

    site, social = None, []
    for a in e.walk():
        if a.tag == "a" and a.attrs.get("href", "").startswith(("http://", "https://")):
            host = (urlparse(a.attrs["href"]).hostname or "").removeprefix("www.")
            if any(host == s or host.endswith("." + s) for s in SOCIAL):
                social.append(a.attrs["href"])
            elif site is None and host:
                site = a.attrs["href"]
    return site, social[:5]


def _heading(e: Element) -> str | None:
    for kind in HEADINGS:
        for x in e.walk():
            if x.tag == kind and (t := x.text()):
                return t
    for x in e.walk():
        if any(c in ("title", "name") for c in x.attrs.get("class", "").split()) and (t := x.text()):
            return t
    return None


def _is_entry(e: Element) -> bool:
    return e.tag in ENTRY_TAGS or e.tag == "div" and any(c in e.attrs.get("class", "") for c in ENTRY_CLASSES)


def page_title(root: Element) -> str | None:
    """The main heading, a brand, a site name, or the start of the title."""
    for e in root.walk():
        if e.tag == "h1" and (t := e.text()):
            return t[:200]
    for e in root.walk():
        if any(c in ("site-title", "brand") for c in e.attrs.get("class", "").split()) or e.attrs.get("itemprop") == "name":
            if t := e.text():
                return t[:200]
        if e.tag == "meta" and e.attrs.get("property") == "og:site_name" and e.attrs.get("content"):
            return " ".join(e.attrs["content"].split())
    title = next((t for e in root.walk() if e.tag == "title" and (t := e.text())), "")
    return re.split(r"[|\-–—:]", title)[0].strip()[:200] or None


def entries(root: Element, selector: str | None = None) -> list[tuple[Element, str]]:
    """(element, text) of the entries of a listing: the innermost ones that hold a phone, each text once.

    selector: "tag.class" of the entries of a known directory, else those of the usual tags and classes.
    """
    tag, _, name = (selector or "").partition(".")
    is_entry = (lambda e: (not tag or e.tag == tag) and (not name or name in e.attrs.get("class", "").split())) if selector else _is_entry
    order: list[tuple[Element, int | None]] = []  # parents first, with the entry each stands in
    todo: list[tuple[Element, int | None]] = [(root, None)]
    while todo:
        e, above = todo.pop()
        here = above
        if e is not root and is_entry(e):
            here = len(order)
            order.append((e, above))
        todo.extend((c, here) for c in reversed(e.children) if isinstance(c, Element))
    texts = [e.text() for e, _ in order]
    has_phone = [bool(_FAST_PHONE.search(t.translate(P._TO_ASCII))) for t in texts]
    holds_one = [False] * len(order)
    for k in range(len(order) - 1, -1, -1):
        above = order[k][1]
        if above is not None and (has_phone[k] or holds_one[k]):
            holds_one[above] = True
    found = {t: e for (e, _), t, phone, inner in reversed(list(zip(order, texts, has_phone, holds_one, strict=True))) if phone and not inner and 12 <= len(t) <= 900}
    return [(e, t) for t, e in reversed(found.items())]


def candidates_of(html: str, most: int | None = None, selector: str | None = None) -> list[dict]:
    """What may be businesses in a page: structured data, entries of a listing (``most`` of all in all, None: every one), else the page."""
    root = tree(html)
    out = [o | {"kind": "JSON_LD", "hint": 85} for x in json_ld(root) if (o := organisation(x))]
    for e, t in entries(root, selector):
        if most is not None and len(out) >= most:
            break
        site, social = _links(e)
        out.append({"name": _heading(e), "text": t, "address": None, "website": site, "owner": None, "social": social, "city": None, "kind": "DIRECTORY_ENTRY", "hint": 70})
    if not out or len(out) == 1 and not out[0]["name"]:
        t = root.text()
        site, social = _links(root)
        out.append({"name": page_title(root), "text": t, "address": None, "website": site, "owner": None, "social": social, "city": None, "kind": "PAGE_TEXT", "hint": 60})
    listed = "".join(" \n " + e.attrs["href"][4:] for e in root.walk() if e.tag == "a" and e.attrs.get("href", "").lower().startswith("tel:"))
    if len(out) == 1 and listed:
        out[0]["text"] += listed  # a page of one candidate owns its telephone links
    return out


_CANDIDATE = "array<struct<name: string, text: string, address: string, website: string, owner: string, social: array<string>, city: string, kind: string, hint: int>>"


def _finder(most: int | None, selector: str | None):
    @F.pandas_udf(_CANDIDATE)
    def found(html: pd.Series) -> pd.Series:
        return pd.Series([candidates_of(x, most, selector) for x in html])

    return found


def titles(html) -> Column:
    """``page_title`` of stored pages."""

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return pd.Series([page_title(tree(x)) for x in html], dtype=object)

    return run(_c(html))


def address_from_text(text) -> Column:
    """What follows a label of an address, up to a stop word; else what stands around a marker of one."""
    t = collapse_ws(text)
    out = []
    for label in ADDRESS_LABELS:
        part = F.split(F.regexp_extract(t, f"{label}(.{{0,240}})", 1), _STOP)[0]
        part = collapse_ws(F.regexp_replace(part, r"^[ :：\-،.]+", ""))
        out.append(F.when(F.length(part) >= 8, F.substring(part, 1, 300)))
    for marker in ADDRESS_MARKERS:
        at = F.locate(marker, t)
        part = collapse_ws(F.substring(t, F.greatest(F.lit(1), at - 40), F.lit(240)))
        out.append(F.when((at > 0) & (F.length(part) >= 10), F.substring(part, 1, 300)))
    return F.coalesce(*out)


def looks_like_address(text) -> Column:
    return (F.length(_c(text)) >= 8) & F.coalesce(_c(text).rlike("|".join(ADDRESS_MARKERS)), F.lit(False))


def owner_name(text) -> Column:
    """A published owner or manager: one to four words without digits."""
    one = lambda pattern: F.nullif(collapse_ws(F.regexp_extract(_c(text), pattern + r"\s*[:：]?\s*([\x{0600}-\x{06FF}\s]{3,45})", 1)), F.lit(""))
    fits = lambda x: F.when((F.size(F.split(x, " ")) <= 4) & ~x.rlike("[0-9۰-۹]"), x)
    return F.coalesce(fits(one("(?:مدیر\\s*عامل|مدیرعامل|مالک|صاحب)")), fits(one("(?:مسئول\\s*فروش|مدیر\\s*فروش)")))


def extract(pages: DataFrame, area: str | None = None, plan: P.PhonePlan = P.PLAN, gazetteer=None, most: int | None = None, selector: str | None = None) -> DataFrame:
    """Candidates of ``pages(url, html)``: cid, url, name, phones, address, owner, website, social, city, kind, hint, signature.

    Only the tree is walked in Python; names, addresses, owners and phones are columns, and equal candidates of a page are one, the
    best kind of them. With a gazetteer a candidate without a city takes the one that its text names.
    """
    from quarryline.operators.components import cut
    from quarryline.operators.joins import dealt

    found = _finder(most, selector)
    rows = dealt(pages.select("url", *([area] if area else []), "html"), "url")
    rows = rows.select("url", *([area] if area else []), F.posexplode(found("html")).alias("nth", "c"))
    # read twice below, so it is written; the pages are walked once
    rows = cut(rows.select("url", *([area] if area else []), "nth", "c.*").withColumn("cid", F.xxhash64("url", "nth")), "found")
    listed = P.find_phones(rows, "text", "cid", area, plan).where("reason is null").groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "e164"))), lambda x: x["e164"]).alias("phones"))
    out = rows.join(listed, "cid", "left").withColumns({
        "name": clean_name("name"), "phones": F.coalesce("phones", F.array().cast("array<string>")), "address": F.coalesce("address", address_from_text("text")),
        "owner": F.coalesce("owner", owner_name("text")),
    })
    if gazetteer is not None:
        from quarryline.functions.geo import locate

        out = out.withColumn("city", F.coalesce("city", locate(pages.sparkSession, gazetteer, F.concat_ws(" ", "address", "text"))["city"]))
    out = out.withColumn("signature", signature("name", "city", "phones"))
    kept = out.groupBy("url", "signature").agg(F.max_by(F.struct("cid", "name", "phones", "address", "owner", "website", "social", "city", "kind", "hint", "text"), F.struct("hint", (-F.col("nth")).alias("t"))).alias("x"))
    return kept.select("url", "signature", "x.*")


def search_candidates(items: DataFrame, key: str, area: str | None = None, plan: P.PhonePlan = P.PLAN) -> DataFrame:
    """(key, name, phones, text, website, kind, hint) of result items ``items(key, title, snippet, url)`` that hold a phone; others give none."""
    text = collapse_ws(F.concat(F.coalesce("title", F.lit("")), F.lit(" . "), F.coalesce("snippet", F.lit(""))))
    rows = items.withColumn("__text", text)
    found = P.find_phones(rows, "__text", key, area, plan).where("reason is null").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "e164"))), lambda x: x["e164"]).alias("phones"))
    out = rows.join(found, key)
    return out.select(key, clean_name("title").alias("name"), "phones", F.col("__text").alias("text"), F.col("url").alias("website"), F.substring("snippet", 1, 500).alias("snippet"), F.lit("SEARCH_SNIPPET").alias("kind"), F.lit(45).alias("hint"))
