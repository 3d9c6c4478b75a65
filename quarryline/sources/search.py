"""Search results as rows: stored API answers and result pages of search engines, fixture corpora, open data, directories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.functions.pages import selected, tree
from quarryline.functions.text import normalize_fa

ITEM = "rank int, url string, title string, snippet string"
# How the pages of each API are asked for, and how far its results are trusted.
SOURCES = {
    "BING_API": {"kind": "SEARCH_ENGINE", "reliability": 0.85, "path": "$.webPages.value", "fields": ("url", "name", "snippet"), "requires_key": True},
    "GOOGLE_CSE": {"kind": "SEARCH_ENGINE", "reliability": 0.88, "path": "$.items", "fields": ("link", "title", "snippet"), "requires_key": True},
    "SERPAPI": {"kind": "SEARCH_ENGINE", "reliability": 0.85, "path": "$.organic_results", "fields": ("link", "title", "snippet"), "requires_key": True},
    "SEARX": {"kind": "SEARCH_ENGINE", "reliability": 0.65, "path": "$.results", "fields": ("url", "title", "content"), "requires_key": False},
    "DUCKDUCKGO": {"kind": "SEARCH_ENGINE", "reliability": 0.62, "max_page": 5, "requires_key": False},
    "BING_HTML": {"kind": "SEARCH_ENGINE", "reliability": 0.62, "max_page": 5, "requires_key": False},
    "MOJEEK": {"kind": "SEARCH_ENGINE", "reliability": 0.60, "max_page": 4, "requires_key": False},
    "OVERPASS": {"kind": "OPEN_DATA", "reliability": 0.82, "requires_key": False},
    "FIXTURE": {"kind": "FIXTURE", "reliability": 0.70, "requires_key": False},
}


def registry(spark) -> DataFrame:
    """(turn, key, kind, reliability, requires_key) of the known sources, in order."""
    rows = [(k, key, s["kind"], float(s["reliability"]), s["requires_key"]) for k, (key, s) in enumerate(SOURCES.items())]
    return spark.createDataFrame(rows, "turn int, key string, kind string, reliability double, requires_key boolean")


def resolve(sources: DataFrame, wanted: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """Available sources, those wanted of them if any are; ``keys`` are those whose key is at hand. Unknown names fall out."""
    out = sources.where(~F.col("requires_key") | (F.col("key").isin(*keys) if keys else F.lit(False)))
    return out.where(F.col("key").isin(*wanted)) if wanted else out


def page_offset(source: str, page: int, per_page: int) -> int:
    """The offset that a page starts at, as each API counts."""
    return {"BING_API": (page - 1) * min(per_page, 50), "GOOGLE_CSE": (page - 1) * 10 + 1, "SERPAPI": (page - 1) * 10, "BING_HTML": (page - 1) * 10 + 1}.get(source, page)


def api_items(answers: DataFrame, source: str, body: str = "body") -> DataFrame:
    """``answers`` exploded to result items: rank from 1, url, title, snippet; answers that are no JSON give none."""
    s = SOURCES[source]
    url, title, snippet = s["fields"]
    items = F.from_json(F.get_json_object(body, s["path"]), f"array<struct<{url}: string, {title}: string, {snippet}: string>>")
    rows = answers.select("*", F.posexplode(items).alias("at", "item"))
    return rows.select(*[c for c in answers.columns if c != body], (F.col("at") + 1).alias("rank"), F.col(f"item.{url}").alias("url"), F.col(f"item.{title}").alias("title"), F.col(f"item.{snippet}").alias("snippet")).where("url is not null")


# The elements of a result page that hold one result, its link and its text, as (inside an element, tag, class), the first kind that is there.
RESULTS = {
    "DUCKDUCKGO": ([(None, None, "result"), (None, None, "web-result")], [(None, "a", "result__a"), ("h2", "a", None), (None, "a", None)], [(None, None, "result__snippet"), (None, "div", None)]),
    "BING_HTML": ([(None, "li", "b_algo")], [("h2", "a", None), (None, "a", None)], [(None, "p", None), (None, None, "b_caption")]),
    "MOJEEK": ([("ul.results-standard", "li", None), (None, "li", "result")], [(None, "a", "ob"), (None, "a", "title"), ("h2", "a", None)], [(None, "p", "s"), (None, None, "s")]),
    "SEARX": ([(None, "article", "result"), (None, "div", "result")], [("h3", "a", None), (None, "a", "url")], [(None, "p", "content")]),
}


def html_items(body, source: str) -> Column:
    """Result items of stored result pages of a search engine, ranked from 1; results without a link give none."""
    blocks, links, texts = RESULTS[source]

    @F.pandas_udf(f"array<struct<{', '.join(p.replace(' ', ': ') for p in ITEM.split(', '))}>>")
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            items = []
            for block in selected(tree(page), blocks):
                link = next((e for kind in links for e in selected(block, [kind]) if e.attrs.get("href")), None)
                text = next((e for kind in texts for e in selected(block, [kind])), None)
                if link is not None:
                    items.append((len(items) + 1, link.attrs["href"], link.text(), text.text() if text is not None else ""))
            out.append(items)
        return pd.Series(out)

    return run(F.col(body) if isinstance(body, str) else body)


def searx_items(body) -> Column:
    """Result items of an answer that is JSON or, where it isn't, a result page."""
    text = F.col(body) if isinstance(body, str) else body
    listed = F.from_json(F.get_json_object(text, "$.results"), "array<struct<url: string, title: string, content: string>>")
    found = F.transform(listed, lambda x, k: F.struct((k + 1).alias("rank"), x["url"].alias("url"), x["title"].alias("title"), x["content"].alias("snippet")))
    return F.when(listed.isNotNull(), F.filter(found, lambda x: x["url"].isNotNull())).otherwise(html_items(text, "SEARX"))


def unwrapped(url) -> Column:
    """A result link without its redirect."""
    u = F.col(url) if isinstance(url, str) else url
    target = F.regexp_extract(u, r"[?&]uddg=([^&]+)", 1)
    return F.when(target != "", F.try_url_decode(target)).when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)


def first_answer(answers: DataFrame, key: str, instance: str, items: str) -> DataFrame:
    """Of several instances of a source the first one, in order, that gave items."""
    return answers.where(F.size(items) > 0).groupBy(key).agg(F.min_by(items, instance).alias(items))


def rank_fixture(pages: DataFrame, query: str, haystack: str, key: str, page: int = 1, per_page: int = 10) -> DataFrame:
    """Pages by how many of the query's words they hold, 2 points each, ties by key: the rows of one page of results."""
    words = [w for w in dict.fromkeys(query.lower().split()) if len(w) >= 2]
    score = sum((F.when(F.contains(F.col(haystack), F.lit(w)), 2).otherwise(0) for w in words[1:]), F.when(F.contains(F.col(haystack), F.lit(words[0])), 2).otherwise(0)) if words else F.lit(0)
    size = max(5, per_page)
    # no rank beyond the page is needed, so the page is cut out before ranks are ranked
    top = pages.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), key).limit(page * size)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)).cast("bigint"))
    return ranked.where(F.col("rank") > (page - 1) * size)


def find_page(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """``wanted(url)`` with the stored body of that URL, else of the first URL that ends in the same last part."""
    last = lambda c: F.element_at(F.split(F.regexp_replace(c, r"/+$", ""), "/"), -1)
    exact = wanted.join(pages.select("url", F.col("body").alias("exact")), "url", "left")
    by_last = pages.groupBy(last(F.col("url")).alias("last")).agg(F.min_by("body", "url").alias("near"))
    return exact.withColumn("last", last(F.col("url"))).join(by_last, "last", "left").select("url", F.coalesce("exact", "near").alias("body"))


# Shop kinds of the open map by category.
SHOP_TAGS = {"DETERGENT": ("chemist", "houseware", "wholesale"), "HYGIENE": ("chemist", "medical_supply"), "COSMETIC": ("cosmetics", "perfumery", "beauty"), "CELLULOSE": ("stationery", "wholesale")}


def overpass_query(category: str, city: str | None, province: str | None) -> str | None:
    """The query for shops of a category in a place; None without one."""
    area = city or province
    if not area:
        return None
    tags = "|".join(SHOP_TAGS.get(category, ("wholesale",)))
    return f'[out:json][timeout:60];area["name"="{area}"]->.a;nwr["shop"~"^({tags})$"](area.a);out center tags;'


def overpass_items(answers: DataFrame, body: str = "body") -> DataFrame:
    """Elements of stored answers that have a name and a phone."""
    e = F.from_json(F.get_json_object(body, "$.elements"), "array<struct<id: bigint, type: string, tags: map<string, string>>>")
    rows = answers.select(*[c for c in answers.columns if c != body], F.posexplode(e).alias("at", "e"))
    tag = lambda *names: F.coalesce(*(F.col("e.tags")[n] for n in names))
    street = F.concat_ws(" ", tag("addr:street"), tag("addr:housenumber"))
    out = rows.select(
        *[c for c in answers.columns if c != body], (F.col("at") + 1).alias("rank"), tag("name", "name:fa", "operator").alias("name"), tag("phone", "contact:phone", "contact:mobile").alias("phone"),
        F.coalesce(tag("addr:full"), F.nullif(street, F.lit(""))).alias("address"), tag("addr:city").alias("city"), tag("website", "contact:website").alias("website"),
        F.concat(F.lit("https://www.openstreetmap.org/"), F.col("e.type"), F.lit("/"), F.col("e.id").cast("string")).alias("url"),
    )
    return out.where("name is not null and phone is not null")


def directory_configs(spark, path: str) -> DataFrame:
    """Enabled directories of a JSON file: a list, or an object with one; those without a key or a search URL fall out."""
    fields = "key string, name string, kind string, reliability double, search_url string, list_selector string, enabled boolean, notes string"
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    listed = F.coalesce(F.from_json(F.get_json_object("v", "$.directories"), f"array<struct<{fields.replace(' ', ': ').replace(',:', ',')}>>"), F.from_json("v", f"array<struct<{fields.replace(' ', ': ').replace(',:', ',')}>>"))
    return text.select(F.explode(listed).alias("d")).select("d.*").where("coalesce(enabled, true) and key is not null and search_url is not null")


def directory_url(template, query, page) -> Column:
    return F.replace(F.replace(F.col(template), F.lit("{query}"), F.url_encode(F.col(query))), F.lit("{page}"), F.col(page).cast("string"))


def restricted_queries(tasks: DataFrame, domains: list[str], most: int = 3) -> DataFrame:
    """Each query once for each of the first domains, restricted to it."""
    return tasks.withColumn("domain", F.explode(F.array(*map(F.lit, domains[:most])))).withColumn("query_text", F.concat(F.lit("site:"), "domain", F.lit(" "), "query_text"))


def fixture_haystack(*columns: str) -> Column:
    return F.lower(normalize_fa(F.concat_ws(" ", *columns), "space"))
