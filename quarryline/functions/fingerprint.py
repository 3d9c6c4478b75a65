"""Fingerprints and blocking keys as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.text import _c, name_key
from quarryline.functions.urls import domain_of, is_generic_host, registrable_domain


def _trimmed(x) -> Column:
    return F.lower(F.btrim(F.coalesce(_c(x).cast("string"), F.lit(""))))


def hashed(*parts, length: int = 32) -> Column:
    """The first hex digits of the sha1 of the parts, trimmed and lower-cased, joined by U+0001; null is empty."""
    return F.substring(F.sha1(F.concat_ws("\u0001", *(_trimmed(p) for p in parts))), 1, length)


def business_fingerprint(name, city, domain, phone) -> Column:
    """By name (and city), else by an own domain, else by phone, else by what there is; nulls of the last enter as "None"."""
    key, own = name_key(name), registrable_domain(domain)
    phone_ = F.coalesce(_c(phone), F.lit(""))
    none = lambda x: F.coalesce(_c(x).cast("string"), F.lit("None"))
    return (
        F.when(key != "", F.concat(F.lit("b:"), hashed(key, name_key(city))))
        .when(own.isNotNull() & ~is_generic_host(own), F.concat(F.lit("d:"), hashed(own)))
        .when(phone_ != "", F.concat(F.lit("p:"), hashed(phone_)))
        .otherwise(F.concat(F.lit("x:"), hashed(none(name), none(city), none(domain), none(phone))))
    )


def _sha32(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\u0001", *(F.coalesce(p, F.lit("")) for p in parts))), 1, 32)


def phone_fingerprint(e164) -> Column:
    return F.concat(F.lit("ph:"), _sha32(_c(e164)))


def query_fingerprint(source, text) -> Column:
    return _sha32(_c(source), F.lower(F.btrim(_c(text))))


def observation_fingerprint(url, phone, business) -> Column:
    return _sha32(domain_of(url), _c(url), _c(phone), _c(business))


def signature(name, city, phones) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", name_key(name), F.coalesce(_c(city), F.lit("")), F.array_join(F.array_sort(_c(phones)), ","))), 1, 16)


def blocking_keys(name, city, domain, phones, address) -> Column:
    """Keys under which records are compared: starts of the name, name and city, domain, phones, start of the address."""
    return keys_of(name_key(name), name_key(city), registrable_domain(domain), phones, name_key(address))


def keys_of(name, city, domain, phones, address) -> Column:
    """``blocking_keys`` of what is made already: ``name_key`` of name, city and address, ``registrable_domain`` of the domain."""
    key, place, own, street = map(_c, (name, city, domain, address))
    listed = F.coalesce(_c(phones), F.array().cast("array<string>"))
    part = lambda ok, tag, *x: F.when(ok, F.concat(F.lit(tag), *x))
    own_keys = F.array(
        part(key != "", "n:", F.substring(key, 1, 14)),
        part(key != "", "n2:", F.substring(key, 1, 6)),
        part((key != "") & (place != ""), "nc:", F.substring(key, 1, 12), F.lit("|"), F.substring(place, 1, 8)),
        part(own.isNotNull() & ~is_generic_host(own), "d:", own),
        part(F.length(street) >= 10, "a:", F.substring(street, 1, 16)),
    )
    return F.array_distinct(F.concat(F.array_compact(own_keys), F.transform(listed, lambda p: F.concat(F.lit("p:"), p))))
