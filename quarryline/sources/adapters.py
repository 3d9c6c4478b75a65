"""Sources as adapters: what a stored answer of each is made of, one contract for those here and those that users add."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import pages as pages_of
from quarryline.functions import phones as P
from quarryline.functions.fingerprint import signature
from quarryline.functions.text import clean_name, collapse_ws
from quarryline.sources import search

#: What an item says of a business by itself, without a page being read.
LISTED = "struct<name: string, phones: array<string>, address: string, owner: string, city: string, province: string, website: string>"
ITEMS = f"source_key string, query_text string, page int, rank int, url string, title string, snippet string, listed {LISTED}"


@dataclass(frozen=True)
class Adapter:
    """A source. ``items`` makes of stored answers ``(source_key, query_text, page, url, body)`` rows with these columns and rank, url, title, snippet and, if it
    knows them, listed; what it leaves out is null. ``url_of`` is where a query's page is asked for, with ``{query}`` and ``{page}``."""

    key: str
    kind: str
    items: Callable[[DataFrame], DataFrame]
    reliability: float = 0.65
    requires_key: bool = False
    max_page: int | None = None
    url_of: str | None = None


class Adapters:
    """Adapters by key, in the order in which they were added; one that is added again replaces the older."""

    def __init__(self, adapters: Iterable[Adapter] = ()):
        self._known: dict[str, Adapter] = {}
        for a in adapters:
            self.add(a)

    def add(self, adapter: Adapter) -> Adapters:
        self._known[adapter.key] = adapter
        return self

    def __getitem__(self, key: str) -> Adapter:
        return self._known[key]

    def registry(self, spark) -> DataFrame:
        """(turn, key, kind, reliability, requires_key), as ``search.resolve`` takes it."""
        rows = [(k, a.key, a.kind, float(a.reliability), a.requires_key) for k, a in enumerate(self._known.values())]
        return spark.createDataFrame(rows, "turn int, key string, kind string, reliability double, requires_key boolean")

    def items(self, answers: DataFrame) -> DataFrame:
        """The items (see ``ITEMS``) of all answers, each by its source's adapter; answers of unknown sources, or of pages past a source's last, give none."""
        parts = []
        for a in self._known.values():
            own = answers.where(F.col("source_key") == a.key)
            own = own.where(F.col("page") <= a.max_page) if a.max_page else own
            parts.append(_shaped(a.items(own)))
        return reduce(DataFrame.unionByName, parts) if parts else _shaped(answers.limit(0))


def _shaped(rows: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in rows.sparkSession.createDataFrame([], ITEMS).schema}
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


def _exploded(answers: DataFrame, items: Column) -> DataFrame:
    return answers.select("source_key", "query_text", "page", F.explode(items).alias("i")).select("source_key", "query_text", "page", "i.*")


def _open_map(answers: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = search.overpass_items(answers.select("source_key", "query_text", "page", "body"))
    listed = F.struct("name", F.array("phone").alias("phones"), "address", none.alias("owner"), "city", none.alias("province"), "website")
    return rows.select("source_key", "query_text", "page", "rank", "url", F.col("name").alias("title"), F.concat_ws(" ", "phone", "address").alias("snippet"), listed.alias("listed"))


def listing_adapter(key: str, url_of: str, selector: str | None = None, kind: str = "BUSINESS_DIRECTORY", reliability: float = 0.65, most: int | None = None) -> Adapter:
    """A directory whose result pages list businesses; ``selector`` says which elements are entries, otherwise they are recognised."""
    if "{query}" not in url_of:
        raise ValueError(f"the address of {key} has to name {{query}}")

    def items(answers: DataFrame) -> DataFrame:
        own = answers.select("source_key", "query_text", "page", "url", "body")
        found = pages_of.extract(own.select("url", F.col("body").alias("html")), selector=selector, most=most).where("name is not null")
        rows = found.join(own.drop("body"), "url")
        place = F.struct("source_key", "query_text", "page")
        first = rows.groupBy(place.alias("k")).agg(F.array_sort(F.collect_list(F.struct("cid", "url", "name", "phones", "address", "owner", "city", "website", "text"))).alias("found"))
        out = first.select("k.*", F.posexplode("found").alias("at", "c"))
        listed = F.struct("c.name", "c.phones", "c.address", "c.owner", "c.city", F.lit(None).cast("string").alias("province"), "c.website")
        return out.select("source_key", "query_text", "page", (F.col("at") + 1).alias("rank"), "c.url", F.col("c.name").alias("title"), F.substring("c.text", 1, 500).alias("snippet"), listed.alias("listed"))

    return Adapter(key, kind, items, reliability, url_of=url_of)


def configured(spark, path: str) -> list[Adapter]:
    """The adapters of the directories that a configuration file enables and whose addresses name ``{query}``."""
    rows = search.directory_configs(spark, path).collect()  # a configuration has a few rows
    return [
        listing_adapter(r["key"], r["search_url"], r["list_selector"], r["kind"] or "BUSINESS_DIRECTORY", 0.65 if r["reliability"] is None else r["reliability"])
        for r in rows if "{query}" in r["search_url"]
    ]


def built_in() -> Adapters:
    """The sources of this library, in their order."""
    api = lambda key: lambda answers: search.api_items(answers.drop("url"), key)
    html = lambda key: lambda answers: _exploded(answers, search.html_items("body", key))
    made = {
        **{k: api(k) for k in ("BING_API", "GOOGLE_CSE", "SERPAPI")}, "SEARX": lambda answers: _exploded(answers, search.searx_items("body")),
        **{k: html(k) for k in ("DUCKDUCKGO", "BING_HTML", "MOJEEK")}, "OVERPASS": _open_map,
    }
    return Adapters(Adapter(k, s["kind"], made[k], s["reliability"], s["requires_key"], s.get("max_page")) for k, s in search.SOURCES.items() if k in made)


def candidates(items: DataFrame, plan: P.PhonePlan = P.PLAN) -> DataFrame:
    """Candidates of items, as ``pages.extract`` gives those of pages, with the item's source_key: what an item lists is taken as it is, otherwise its title and snippet are read.

    Phones are those listed or else those in title and snippet; an item that lists nothing and has no phone gives none. ``kind`` and ``hint`` say how much a
    candidate is worth as evidence: 78 for what is listed, 45 for what was read.
    """
    text = collapse_ws(F.concat_ws(" . ", "title", "snippet"))
    rows = items.withColumns({"cid": F.xxhash64("source_key", "query_text", "page", "rank", "url"), "__read": text, "__told": F.array_join(F.coalesce("listed.phones", F.array().cast("array<string>")), " ; ")})
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("start", "e164"))), lambda x: x["e164"])
    phones = lambda column, name: P.find_phones(rows, column, "cid", None, plan).where("reason is null").groupBy("cid").agg(in_order.alias(name))
    out = rows.join(phones("__told", "__a"), "cid", "left").join(phones("__read", "__b"), "cid", "left")
    is_listed = F.col("listed").isNotNull()
    out = out.withColumns({
        "name": F.when(is_listed, F.coalesce("listed.name", "title")).otherwise(clean_name("title")), "phones": F.coalesce("__a", "__b", F.array().cast("array<string>")),
        "kind": F.when(is_listed, "DIRECTORY_ENTRY").otherwise("SEARCH_SNIPPET"), "hint": F.when(is_listed, 78).otherwise(45),
        "website": F.when(is_listed, F.col("listed.website")).otherwise(F.col("url")),
    }).where(is_listed | (F.size("phones") > 0))
    return out.select(
        "source_key", "query_text", "page", "url", "cid", "name", "phones", "listed.address", "listed.owner", "website", F.array().cast("array<string>").alias("social"), "listed.city", "listed.province", "kind", "hint",
        F.col("__read").alias("text"), signature("name", F.col("listed.city"), "phones").alias("signature"),
    )
