"""URLs as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.text import _c, let

# Second-level names that registrars sell below, and hosts that say nothing about who owns a page.
SECOND_LEVEL = ("co", "com", "net", "org", "gov", "ac", "sch", "id", "or", "ne")
GENERIC_HOSTS = (
    "instagram.com", "t.me", "telegram.me", "facebook.com", "wa.me", "whatsapp.com", "youtube.com", "twitter.com", "x.com", "linkedin.com", "aparat.com",
    "pinterest.com", "google.com", "bing.com", "duckduckgo.com", "mojeek.com", "wikipedia.org", "digikala.com", "basalam.com", "bamilo.com", "divar.ir",
    "sheypoor.com", "openstreetmap.org", "nominatim.openstreetmap.org", "overpass-api.de", "yellowpages.ir", "tejarat.ir", "hamgardi.net", "sna.ir", "isna.ir",
)


def domain_of(url) -> Column:
    """The host: lower case, without port, dots at the ends and ``www.``; null if there is none."""
    x = F.btrim(_c(url))
    host = F.regexp_extract(x, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://|//)?(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\\\s]+)", 1)
    host = F.regexp_replace(F.lower(F.btrim(host, F.lit("."))), r"^www\.", "")
    return F.when(host != "", host)


def registrable_domain(url, second_level: tuple[str, ...] = SECOND_LEVEL) -> Column:
    """The last two labels of the host, three if the last but one is a second-level name; addresses stay."""
    return let(domain_of(url), lambda host: _registrable(host, second_level))


def _registrable(host: Column, second_level: tuple[str, ...]) -> Column:
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, F.lit(n)), ".")
    address = host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") | host.startswith("[")
    return F.when(address | (F.size(labels) <= 2), host).when(F.element_at(labels, -2).isin(*second_level), last(3)).otherwise(last(2))


def is_generic_host(domain, hosts: tuple[str, ...] = GENERIC_HOSTS) -> Column:
    return F.coalesce(_c(domain).isin(*hosts), F.lit(False))


def url_hash_key(url) -> Column:
    return F.sha1(F.lower(F.btrim(F.coalesce(_c(url), F.lit("")))))


def tel_link_targets(html) -> Column:
    """Targets of telephone links, unquoted."""
    found = F.regexp_extract_all(F.coalesce(_c(html), F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']\s*tel:([^\"']+)"), F.lit(1))
    return F.transform(found, lambda x: F.try_url_decode(F.replace(F.btrim(x), F.lit("+"), F.lit("%2B"))))


def is_probably_html(content_type, body) -> Column:
    kind, start = F.lower(F.coalesce(_c(content_type), F.lit(""))), F.lower(F.substring(F.coalesce(_c(body), F.lit("")), 1, 512))
    return F.contains(kind, F.lit("html")) | F.contains(start, F.lit("<html")) | F.contains(start, F.lit("<!doctype html"))


def absolute_url(base, href) -> Column:
    """``href`` resolved against ``base``; null for scripts, mail and anchors."""
    return F.pandas_udf(_joined, "string")(_c(base), _c(href))


def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    def one(b: str | None, h: str | None) -> str | None:
        h = (h or "").strip()
        if not h or h.lower().startswith(("javascript:", "mailto:", "#")):
            return None
        try:
            return urljoin(b or "", h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)
