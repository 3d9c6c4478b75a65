"""Queries that run the functions on texts, phones, places, pages and names on inputs made of the provided tables, with the DuckDB SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.directory import NATIONAL, ctes, directory
from quarryline.functions import fingerprint, geo, pages, phones, relevance, similarity, text, urls
from quarryline.functions.lexicon import Lexicon
from quarryline.operators import upsert
from quarryline.registry import query, table

_RAW = "concat('  شركة ', c_name, ' ‌يک‌تا ۀ', translate(CAST(c_custkey AS STRING), '0123456789', '۰۱۲۳۴۵۶۷۸۹'), ' ', translate(CAST(c_custkey % 7 AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩'), ' ـّ  ')"
_MAPPED = f"translate(translate({{x}}, '{text.LETTERS_FROM}', '{text.LETTERS_TO}'), '{text.PERSIAN_DIGITS}{text.ARABIC_DIGITS}', '{text.ASCII_DIGITS * 2}')"
_PLAIN = f"regexp_replace({_MAPPED.format(x=_RAW)}, '[{text.DIACRITICS}{text.TATWEEL}]', '', 'g')"
_SPACED = r"trim(regexp_replace(translate({x}, chr(160), ' '), '\s+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT c_custkey, {_PLAIN} AS t FROM customer) SELECT c_custkey, {_SPACED.format(x="t")} AS kept, {_SPACED.format(x="translate(t, chr(8204), ' ')")} AS spaced, {_SPACED.format(x="replace(t, chr(8204), '')")} AS removed,
 regexp_replace(lower(replace(t, chr(8204), '')), '[^a-z0-9_\\x{{0600}}-\\x{{06ff}}]', '', 'g') AS light, regexp_replace(replace(t, chr(8204), ''), '[\\s\\x{{a0}}]', '', 'g') AS dense FROM t""")
def persian_texts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_RAW} AS t")
    light = text.light_key("t")
    return c.select("c_custkey", text.normalize_fa("t").alias("kept"), text.search_text("t").alias("spaced"), text.normalize_fa("t", "remove").alias("removed"), light.alias("light"), text.no_space("t").alias("dense"))


@query(f"""SELECT c_custkey, translate(translate({_RAW}, '{text.PERSIAN_DIGITS}{text.ARABIC_DIGITS}', '{text.ASCII_DIGITS * 2}'), '#', '#') AS digits, CASE WHEN c_custkey % 2 = 0 THEN true ELSE false END AS persian,
 replace({_RAW}, chr(8204), '') AS narrow FROM customer""")
def digits_and_marks(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_RAW} AS t", "c_name")
    return c.select("c_custkey", text.to_ascii_digits("t").alias("digits"), text.has_persian(F.when(F.col("c_custkey") % 2 == 0, F.col("t")).otherwise(F.col("c_name"))).alias("persian"), text.remove_zero_width("t").alias("narrow"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')) WHEN 1 THEN concat('xy', 'شرکت') ELSE regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') END AS key FROM part""")
def suffixless_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' شرکت') WHEN 1 THEN 'xy شرکت' ELSE concat(p_name, ' مسئولیت محدود') END AS n")
    return p.select("p_partkey", text.name_key("n").alias("key"))


@query("SELECT p_partkey, trim(regexp_replace(substr(concat(p_name, ' counted ', p_type, ' and more of it'), greatest(p_size - 10, 0) + 1, p_size + 2 + 10 - greatest(p_size - 10, 0)), '\\s+', ' ', 'g')) AS snippet FROM part")
def snippets(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_name, ' counted ', p_type, ' and more of it') AS t", "p_size AS a", "p_size + 2 AS b")
    return p.select("p_partkey", text.snippet_around("t", "a", "b", 10).alias("snippet"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE NULL END AS name FROM part""")
def clean_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE p_partkey % 5 WHEN 0 THEN concat(' - ', p_name, ' : ') WHEN 1 THEN concat('نام شرکت: ', p_name) WHEN 2 THEN 'ab' WHEN 3 THEN concat('x ', p_partkey, ' 98765432101') ELSE concat(p_name, ' 0912 345 6789') END AS n"
    )
    return p.select("p_partkey", text.clean_name("n").alias("name"))


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AS name_differs, o_orderkey % 2 = 1 AS site_differs, o_orderkey % 4 = 3 AS address_differs FROM orders""")
def contradictions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderpriority AS a", "if(o_orderkey % 3 = 0, 'other name', concat(' ', lower(o_orderpriority))) AS b", "'http://www.shop.ir/x' AS s", "if(o_orderkey % 2 = 1, 'https://else.ir', 'https://m.shop.ir') AS t",
        "'road 5, town' AS p", "if(o_orderkey % 4 = 3, 'lane 9', if(o_orderkey % 4 = 2, 'road 5', 'road 5, town, west')) AS q",
    )
    d = text.is_meaningfully_different
    return o.select("o_orderkey", d("a", "b", "name").alias("name_differs"), d("s", "t", "website").alias("site_differs"), d("p", "q", "address").alias("address_differs"))


@query(r"SELECT c_custkey, substr(sha1(concat(regexp_replace(lower(c_name), '[^a-z0-9_]', '', 'g'), '|', c_mktsegment, '|', CASE WHEN c_custkey % 2 = 0 THEN concat('1', c_custkey, ',', '2', c_custkey) ELSE concat('2', c_custkey) END)), 1, 16) AS signature FROM customer")
def candidate_signatures(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "c_mktsegment", "if(c_custkey % 2 = 0, array(concat('2', c_custkey), concat('1', c_custkey)), array(concat('2', c_custkey))) AS p")
    return c.select("c_custkey", fingerprint.signature("c_name", "c_mktsegment", "p").alias("signature"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 = 1 THEN concat('shop', CAST(c_custkey AS VARCHAR), '.ir') WHEN c_custkey % 4 = 2 THEN 't.me' END AS domain, CASE WHEN c_custkey % 4 = 2 THEN concat('+98', CAST(c_custkey AS VARCHAR)) END AS phone FROM customer)
SELECT c_custkey, CASE WHEN name IS NOT NULL THEN concat('b:', substr(sha1(concat(regexp_replace(lower(name), '[^a-z0-9_]', '', 'g'), chr(1))), 1, 32)) WHEN domain IS NOT NULL AND domain <> 't.me' THEN concat('d:', substr(sha1(domain), 1, 32))
 WHEN phone IS NOT NULL THEN concat('p:', substr(sha1(phone), 1, 32)) ELSE concat('x:', substr(sha1(concat('none', chr(1), 'none', chr(1), 'none', chr(1), 'none')), 1, 32)) END AS fp FROM c""")
def fingerprint_rungs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "if(c_custkey % 4 = 0, c_name, null) AS n", "CASE c_custkey % 4 WHEN 1 THEN concat('http://www.shop', c_custkey, '.ir/a') WHEN 2 THEN 'https://t.me/x' END AS d", "if(c_custkey % 4 = 2, concat('+98', c_custkey), null) AS p")
    return c.select("c_custkey", fingerprint.business_fingerprint("n", F.lit(None).cast("string"), "d", "p").alias("fp"))


@query("""SELECT o_orderkey, substr(sha1(concat('site.ir', chr(1), 'http://www.site.ir/', CAST(o_orderkey AS VARCHAR), chr(1), CASE WHEN o_orderkey % 2 = 0 THEN 'p' ELSE '' END, chr(1), 'b')), 1, 32) AS observation,
 substr(sha1(concat('S', chr(1), lower(o_orderpriority))), 1, 32) AS query FROM orders""")
def evidence_fingerprints(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat('http://www.site.ir/', o_orderkey) AS u", "if(o_orderkey % 2 = 0, 'p', null) AS p", "concat(' ', o_orderpriority, ' ') AS q")
    return o.select("o_orderkey", fingerprint.observation_fingerprint("u", "p", F.lit("b")).alias("observation"), fingerprint.query_fingerprint(F.lit("S"), "q").alias("query"))


@query("""WITH c AS (SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9_]', '', 'g') AS n, lower(c_mktsegment) AS m FROM customer)
SELECT c_custkey, array_to_string(list_sort(list_filter([concat('n:', substr(n, 1, 14)), concat('n2:', substr(n, 1, 6)), concat('nc:', substr(n, 1, 12), '|', substr(m, 1, 8)), CASE WHEN c_custkey % 2 = 0 THEN concat('d:shop', CAST(c_custkey AS VARCHAR), '.ir') END,
 CASE WHEN c_custkey % 3 = 0 THEN concat('a:', substr(concat('longstreet', CAST(c_custkey AS VARCHAR)), 1, 16)) END, concat('p:+98', CAST(c_custkey AS VARCHAR))], lambda x: x IS NOT NULL)), ' ') AS keys FROM c""")
def blocking_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_name", "c_mktsegment", "if(c_custkey % 2 = 0, concat('http://shop', c_custkey, '.ir'), 'https://www.instagram.com/a') AS d", "array(concat('+98', c_custkey)) AS p", "if(c_custkey % 3 = 0, concat('Long Street ', c_custkey), 'short') AS a"
    )
    return c.select("c_custkey", F.array_join(F.array_sort(fingerprint.blocking_keys("c_name", "c_mktsegment", "d", "p", "a")), " ").alias("keys"))


# ---- similarity

_A, _B = "concat(repeat('a', CAST(p_size % 9 + 1 AS INT)), repeat('b', CAST(p_partkey % 7 AS INT)))", "concat(repeat('a', CAST(p_partkey % 5 + 1 AS INT)), repeat('b', CAST(p_size % 6 AS INT)))"


@query(f"""SELECT p_partkey, CASE WHEN {_A} = {_B} THEN 1.0 ELSE round(2.0 * (least(p_size % 9 + 1, p_partkey % 5 + 1) + least(p_partkey % 7, p_size % 6)) / (length({_A}) + length({_B})), 6) END::DOUBLE AS one_word,
 CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS subset FROM part""")
def token_similarities(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_A} AS a", f"{_B} AS b", "concat(p_type, ' ', p_brand) AS c", "if(p_partkey % 2 = 0, concat(p_brand, ' ', p_type, ' 555'), null) AS d")
    return p.select("p_partkey", F.round(similarity.token_set_ratio("a", "b"), 6).alias("one_word"), similarity.token_set_ratio("c", "d").alias("subset"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.0 END::DOUBLE AS phones, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 3 AND x <> 'small'))), ' ') AS core FROM part""")
def phone_and_core_similarity(spark, sf_dir):
    n = "lpad(CAST(p_partkey AS STRING), 9, '5')"
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_name, ' 12 ab') AS n", f"array(concat('8', {n}), '1') AS a", f"CASE p_partkey % 4 WHEN 0 THEN array(concat('8', {n})) WHEN 1 THEN array(concat('9', {n})) WHEN 2 THEN array(concat('9', {n}, '7')) ELSE array() END AS b")
    return p.select("p_partkey", similarity.phone_similarity("a", "b").alias("phones"), similarity.core("n", ("small",)).alias("core"))


@query("""WITH r AS (SELECT s_suppkey AS id, concat('shop ', CAST(s_suppkey % 40 AS VARCHAR)) AS name, s_nationkey % 3 AS city FROM supplier) SELECT a.id AS a, b.id AS b, 0.88::DOUBLE AS score, 'merge' AS verdict FROM r a JOIN r b ON a.name = b.name AND a.city = b.city AND a.id < b.id
WHERE a.id = (SELECT min(id) FROM r x WHERE x.name = a.name AND x.city = a.city)""")
def equal_record_pairs(spark, sf_dir):
    from quarryline.operators import dedup

    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "concat('shop ', s_suppkey % 40) AS name", "concat('town ', s_nationkey % 3) AS city")
    return dedup.scored_pairs(rows.withColumns({"address": none, "domain": none, "phones": F.array().cast("array<string>")})).where("verdict = 'merge'").select("a", "b", "score", "verdict")


def _lcs(a: str, b: str) -> str:
    """SQL of the length of the longest common subsequence of two texts of up to 60 characters, row by row in the bits of one number."""
    masks = f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(length({a})), lambda i: CASE WHEN {a}[i + 1] = c THEN 1::BIGINT << i ELSE 0 END))::BIGINT)"
    full = f"((1::BIGINT << length({a})) - 1)"
    return f"(length({a}) - bit_count(list_reduce({masks}, lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full}, {full})))"


def _indel(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN ({a} <> '')::INT::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {_lcs(a, b)} / (length({a}) + length({b})) END"


def _shops(source: str, listed, picked, empty: str) -> str:
    """Shops made of the parts: names, towns, streets, hosts and numbers that are near each other in all ways; how a list is written depends on the engine."""
    endings = listed(f"'{x}'" for x in ("trading", "tradings", "trade", "harbour", "harbor", "northern wool", "wool northern", "mill"))
    phones = listed(f"concat('{code}', CAST(p_partkey % {n} AS STRING))" for code, n in (("+9821", 500), ("+9831", 70)))
    return f"""SELECT p_partkey AS id, concat(p_name, ' ', {picked(endings, "p_partkey * 31 % 8")}) AS name, concat('Town ', CAST(p_size % 6 AS STRING)) AS city,
 CASE WHEN p_partkey % 3 <> 0 THEN concat('street ', CAST(p_size % 12 AS STRING), ' ', lower(p_type), ' side') END AS address,
 CASE WHEN p_partkey % 4 = 0 THEN concat('shop', CAST(p_partkey % 300 AS STRING), '.ir') END AS domain, CASE WHEN p_partkey % 5 = 0 THEN {phones} ELSE {empty} END AS phones FROM {source}"""


_SHOPS = _shops("part", lambda xs: f"[{', '.join(xs)}]", lambda xs, k: f"{xs}[{k} + 1]", "[]")


@query(f"""WITH r AS ({_SHOPS}), k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS nk, regexp_replace(lower(city), '[^a-z0-9]', '', 'g') AS ck, regexp_replace(lower(coalesce(address, '')), '[^a-z0-9]', '', 'g') AS ak,
 list_sort(list_distinct(list_filter(string_split(lower(name), ' '), lambda x: length(x) >= 3))) AS words, min(id) OVER (PARTITION BY name, city, address, domain, phones) AS first FROM r),
keys AS (SELECT DISTINCT id, unnest(list_concat(list_filter(['n:' || nk[:14], 'n2:' || nk[:6], 'nc:' || nk[:12] || '|' || ck[:8], 'd:' || domain, CASE WHEN length(ak) >= 10 THEN 'a:' || ak[:16] END], lambda x: x IS NOT NULL), list_transform(phones, lambda x: 'p:' || x))) AS key FROM k WHERE id = first),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM keys a JOIN keys b ON a.key = b.key AND a.id < b.id UNION ALL SELECT first, id FROM k WHERE id <> first),
j AS (SELECT p.a, p.b, x.nk AS xn, y.nk AS yn, x.ak AS xa, y.ak AS ya, x.ck = y.ck AS town, list_has_any(x.phones, y.phones) AS shared, coalesce(x.domain = y.domain, false) AS dom,
 array_to_string(list_sort(list_intersect(x.words, y.words)), ' ') AS s, array_to_string(list_filter(x.words, lambda w: NOT list_contains(y.words, w)), ' ') AS p, array_to_string(list_filter(y.words, lambda w: NOT list_contains(x.words, w)), ' ') AS q
 FROM pairs p JOIN k x ON x.id = p.a JOIN k y ON y.id = p.b),
m AS (SELECT *, {_indel("xn", "yn")} AS raw, CASE WHEN xa = '' OR ya = '' THEN 0.0::DOUBLE ELSE {_indel("xa", "ya")} END AS addr,
 CASE WHEN s <> '' AND (p = '' OR q = '') THEN 1.0::DOUBLE WHEN s = '' THEN {_indel("p", "q")} ELSE greatest(2.0::DOUBLE * ({_lcs("p", "q")} + length(s) + 1) / (length(p) + length(q) + 2 * (length(s) + 1)),
  2.0::DOUBLE * length(s) / (2 * length(s) + 1 + length(p)), 2.0::DOUBLE * length(s) / (2 * length(s) + 1 + length(q))) END AS core FROM j),
n AS (SELECT *, CASE WHEN core < 0.75 THEN least(raw, 0.35::DOUBLE + 0.64::DOUBLE * core) ELSE raw END AS name, shared OR dom OR addr >= 0.85 OR (xn = yn AND town) OR (core >= 0.88 AND town) AS anchor FROM m),
t AS (SELECT *, greatest(CASE WHEN shared AND (name >= 0.72 OR addr >= 0.70 OR xn = yn) THEN 0.9 ELSE 0 END::DOUBLE, CASE WHEN dom THEN 0.85 ELSE 0 END::DOUBLE, CASE WHEN town AND name >= 0.90 AND core >= 0.80 THEN 0.88 ELSE 0 END::DOUBLE,
 CASE WHEN town AND name >= 0.80 AND core >= 0.70 THEN 0.70 ELSE 0 END::DOUBLE, CASE WHEN town AND core >= 0.95 AND name >= 0.50 THEN 0.66 ELSE 0 END::DOUBLE, CASE WHEN name >= 0.95 AND addr >= 0.85 THEN 0.92 ELSE 0 END::DOUBLE,
 0.45::DOUBLE * name + 0.25::DOUBLE * addr + CASE WHEN town THEN 0.20::DOUBLE ELSE 0 END) AS top FROM n),
z AS (SELECT a, b, least(1.0::DOUBLE, round_even(CASE WHEN anchor THEN top ELSE least(top, 0.55::DOUBLE) END, 4)) AS score FROM t)
SELECT a, b, score, CASE WHEN score >= 0.80 THEN 'merge' WHEN score >= 0.62 THEN 'review' END AS verdict FROM z""")
def ladder_verdicts(spark, sf_dir):
    """Blocking and comparison of shops whose names, addresses, hosts and phones are alike, equal or unlike."""
    from quarryline.operators import dedup

    rows = spark.sql(_shops(f"parquet.`{sf_dir}/part.parquet`", lambda xs: f"array({', '.join(xs)})", lambda xs, k: f"{xs}[CAST({k} AS INT)]", "CAST(array() AS array<string>)"))
    return dedup.scored_pairs(rows).select("a", "b", "score", "verdict")


# ---- URLs


@query("""SELECT page_id, page_id % 2 = 0 AS generic, page_id % 3 <> 2 AS html, CASE page_id % 4 WHEN 0 THEN concat('http://a.ir/d/x', CAST(page_id AS VARCHAR)) WHEN 1 THEN concat('http://a.ir/y', CAST(page_id AS VARCHAR)) WHEN 2 THEN concat('http://c.ir/', CAST(page_id AS VARCHAR)) END AS absolute, concat('+98912000', lpad(CAST(page_id AS VARCHAR), 4, '0')) AS tel FROM pages""")
def url_functions(spark, sf_dir):
    p = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "if(page_id % 2 = 0, 't.me', 'own.ir') AS d", "CASE page_id % 3 WHEN 0 THEN 'text/HTML; x' WHEN 1 THEN null ELSE 'application/json' END AS k", "if(page_id % 3 = 1, ' <!DOCTYPE HTML><p>', '{}') AS b",
        "CASE page_id % 4 WHEN 0 THEN concat('x', page_id) WHEN 1 THEN concat('/y', page_id) WHEN 2 THEN concat('//c.ir/', page_id) ELSE 'javascript:x' END AS h",
        "concat('<a href=\"tel:%2B98912000', lpad(page_id, 4, '0'), '\">call</a>') AS t",
    )
    return p.select("page_id", urls.is_generic_host("d").alias("generic"), urls.is_probably_html("k", "b").alias("html"), urls.absolute_url(F.lit("http://a.ir/d/z"), "h").alias("absolute"), F.get(urls.tel_link_targets("t"), F.lit(0)).alias("tel"))


# ---- phones

_AREAS = ", ".join(f"'{a}'" for a in phones.AREA_CODES)


@query(f"""WITH x AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), CAST(c_custkey % 4 + 6 AS INT), '3') AS local, CASE c_custkey % 3 WHEN 0 THEN '021' WHEN 1 THEN '051' ELSE '099' END AS area FROM customer)
SELECT c_custkey, CASE WHEN length(local) IN (7, 8) AND area IN ({_AREAS}) THEN concat('+98', substr(area, 2), local) END AS e164 FROM x""")
def completed_locals(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "lpad(CAST(c_custkey AS STRING), CAST(c_custkey % 4 + 6 AS INT), '3') AS l", "CASE c_custkey % 3 WHEN 0 THEN '21' WHEN 1 THEN '051' ELSE '099' END AS a")
    return c.select("c_custkey", phones.resolve_local("l", "a")["e164"].alias("e164"))


_ODD = "CASE c_custkey % 6 WHEN 0 THEN '09111111111' WHEN 1 THEN '09123456789' WHEN 2 THEN '0912' || lpad(CAST(c_custkey AS STRING), 3, '1') || '0000' WHEN 3 THEN '02188888888' WHEN 4 THEN " + NATIONAL + " ELSE '0991' || lpad(CAST(c_custkey AS STRING), 7, '2') END"
_RUN5 = "|".join(f"{k}{{5}}" for k in range(10))
_JUDGED = f"""n AS (SELECT c_custkey, {_ODD} AS national FROM customer), d AS (SELECT c_custkey, national, substr(national, 2) AS d, substr(national, 3) AS m FROM n),
j AS (SELECT *, len(list_distinct(string_split(d, ''))) AS kinds, CASE WHEN d LIKE '9%' THEN substr(d, 2) WHEN length(d) > 9 THEN substr(d, 3) ELSE d END AS sub, CASE WHEN d LIKE '9%' AND length(d) = 10 THEN 'MOBILE' WHEN length(d) IN (9, 10) AND '0' || substr(d, 1, 2) IN ({_AREAS}) THEN 'LANDLINE' ELSE 'UNKNOWN' END AS type FROM d),
s AS (SELECT *, list_filter([CASE WHEN kinds = 1 AND length(d) >= 7 THEN 'all_same' WHEN kinds <= 2 AND length(d) >= 8 THEN 'few_digits' END, CASE WHEN regexp_matches(d, '{_RUN5}') THEN 'repeated_run' END,
 CASE WHEN d IN ('0123456789', '1234567890', '9876543210', '0987654321') OR (kinds = 1 AND length(d) = 10) OR '0' || d IN ('0123456789', '1234567890', '9876543210', '0987654321') THEN 'sequence' END,
 CASE WHEN sub IN ('00000000', '11111111', '22222222', '12345678', '87654321', '0000000', '1234567') OR d IN ('00000000', '11111111', '22222222', '12345678', '87654321', '0000000', '1234567') THEN 'sample' END], lambda x: x IS NOT NULL) AS hard,
 list_filter([CASE WHEN d LIKE '%0000' THEN 'four_zeros' END, CASE WHEN d LIKE '%00000' THEN 'five_zeros' END, CASE WHEN regexp_matches(d, '0123456789|9876543210|12345678|87654321') THEN 'long_sequence' END, CASE WHEN length(d) >= 9 AND substr(d, -7) LIKE '000%' THEN 'synthetic_block' END], lambda x: x IS NOT NULL) AS soft FROM j),
q AS (SELECT *, CASE WHEN type = 'MOBILE' THEN substr(d, 2, 1) IN ('0', '1', '2', '3', '9') ELSE type = 'LANDLINE' END AS valid, CASE WHEN type = 'LANDLINE' THEN '0' || substr(d, 1, 2) END AS area FROM s)"""


@query(f"WITH {_JUDGED} SELECT c_custkey, array_to_string(hard, ',') AS hard, array_to_string(soft, ',') AS soft FROM q")
def invention_signals(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_ODD} AS n")
    return c.select("c_custkey", F.array_join(phones.fake_signals("n"), ",").alias("hard"), F.array_join(phones.soft_signals("n"), ",").alias("soft"))


@query(f"""WITH {_JUDGED} SELECT c_custkey, round(greatest(0.0, least(1.0, 1.0 - CASE WHEN valid THEN 0 ELSE 0.55 END - least(0.75, 0.35 * len(hard)) - least(0.25, 0.08 * len(soft)) - CASE WHEN type = 'UNKNOWN' THEN 0.35 ELSE 0 END
 - CASE WHEN area <> '051' THEN 0.35 ELSE 0 END - CASE WHEN c_custkey % 5 = 0 THEN 0.15 ELSE 0 END)), 4)::DOUBLE AS quality FROM q""")
def judged_phones(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_ODD} AS n", "c_custkey % 5 = 0 AS local", "'051' AS area").withColumn("p", phones.parse_phone("n"))
    return c.select("c_custkey", F.round(phones.phone_quality("p", "area", "local"), 4).alias("quality"))


@query(f"""WITH n AS (SELECT c_custkey, {_ODD} AS n FROM customer) SELECT c_custkey, regexp_matches(n, '^09[01239][0-9]{{8}}$') AS known_prefix, c_custkey % 2 = 0 AS national_id, c_custkey % 6 = 0 AS service, substr(n, 2) AS key FROM n""")
def phone_predicates(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_ODD} AS n", "if(c_custkey % 2 = 0, '0012345678', '0112345678') AS i", "CASE c_custkey % 6 WHEN 0 THEN '110' WHEN 3 THEN '0961234' ELSE '02133334444' END AS s")
    return c.select("c_custkey", phones.is_mobile_prefix_known("n").alias("known_prefix"), phones.looks_like_national_id("i").alias("national_id"), phones.is_service_line("s").alias("service"), phones.comparable_key("n").alias("key"))


_MOBILE = "concat('0912', lpad(CAST(p_partkey AS STRING), 7, '3'))"
_FIXED = "concat('021', lpad(CAST(p_partkey AS STRING), 8, '4'))"


@query(f"""SELECT p_partkey, concat('+98', substr({_MOBILE}, 2)) AS e164, 'MOBILE' AS type, 'mobile' AS hint FROM part UNION ALL SELECT p_partkey, concat('+98', substr({_FIXED}, 2)), 'LANDLINE', 'mobile' FROM part WHERE p_partkey % 2 = 0""")
def phones_in_texts(spark, sf_dir):
    t = f"concat('تلفن همراه: ', {_MOBILE}, if(p_partkey % 2 = 0, concat(' دفتر ', {_FIXED}), ' قیمت 1234567'), ' کد پستی 1234567890')"
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{t} AS t")
    return phones.find_phones(p, "t", "p_partkey").where("reason is null").select("p_partkey", "e164", "type", "hint")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'label' WHEN 1 THEN 'bare ten digits' WHEN 2 THEN 'local without area' ELSE 'unknown area code' END AS reason FROM part")
def rejected_tokens(spark, sf_dir):
    t = "CASE p_partkey % 4 WHEN 0 THEN 'کد ملی 0912345678' WHEN 1 THEN concat('x 21', lpad(p_partkey, 8, '4')) WHEN 2 THEN concat('x 3', lpad(p_partkey, 7, '4')) ELSE concat('x 065', lpad(p_partkey, 8, '4')) END"
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{t} AS t")
    return phones.find_phones(p, "t", "p_partkey").where("reason is not null").select("p_partkey", "reason")


@query(f"""SELECT p_partkey, concat('+98', substr({_MOBILE}, 2)) AS e164, 'tel_link' AS kind FROM part UNION ALL SELECT p_partkey, concat('+98', substr({_FIXED}, 2)), 'text' FROM part
UNION ALL SELECT p_partkey, concat('+98930', lpad(CAST(p_partkey AS VARCHAR), 7, '5')), 'whatsapp' FROM part WHERE p_partkey % 2 = 0""")
def phones_in_html(spark, sf_dir):
    h = f"concat('<a href=\"tel:', {_MOBILE}, '\">call</a> <p>تلفن: ', {_FIXED}, '</p>', if(p_partkey % 2 = 0, concat('<a href=\"https://wa.me/98930', lpad(p_partkey, 7, '5'), '\">w</a>'), ''))"
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{h} AS h")
    return phones.find_phones_in_html(p, "h", "p_partkey").select("p_partkey", "e164", "kind")


# ---- places


@query(f"""WITH {ctes("places")} SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE concat('Kart ', CAST(c_custkey % 25 AS VARCHAR)) END AS city, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE p.province END AS province, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE p.county END AS county,
 (CASE c_custkey % 3 WHEN 0 THEN 55 WHEN 1 THEN 70 ELSE 15 END)::INT AS confidence FROM customer JOIN places p ON p.id = c_custkey % 25""")
def located_texts(spark, sf_dir):
    p = directory(spark, sf_dir, "places")["places"]
    g = p.select(F.lit("city").alias("kind"), F.concat(F.lit("Kart "), F.col("id").cast("string")).alias("name"), "county", "province")
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat(CASE c_custkey % 3 WHEN 0 THEN 'a shop in Kart ' WHEN 1 THEN 'شهر Kart-' ELSE 'xKart' END, c_custkey % 25, if(c_custkey % 3 = 2, 'z', ' here')) AS t")
    return geo.located(c, g, "c_custkey", "t").select("c_custkey", "city", "province", "county", "confidence")


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s_.،,()\[\]/\\+*\x{200c}\x{200d}\x{200e}\x{200f}\x{00a0}-]+'), lambda x: x <> '') AS words FROM documents),
names AS (SELECT DISTINCT words[1] AS name FROM w WHERE doc_id % 3 = 0 AND length(words[1]) BETWEEN 4 AND 12),
runs AS (SELECT doc_id, i, j, array_to_string(words[i:j], '') AS name FROM w, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i), LATERAL (SELECT unnest(range(i, least(i + 11, len(words)) + 1)) AS j)),
met AS (SELECT doc_id, list({'i': i, 'name': name, 'till': j, 'kept': []::VARCHAR[]} ORDER BY i, j DESC) AS c FROM runs SEMI JOIN names USING (name) GROUP BY doc_id),
held AS (SELECT doc_id, list_reduce(c, lambda a, x: CASE WHEN x.i <= a.till THEN a ELSE {'i': x.i, 'name': x.name, 'till': x.till, 'kept': list_append(a.kept, x.name)} END, {'i': 0::BIGINT, 'name': '', 'till': 0::BIGINT, 'kept': []::VARCHAR[]}).kept AS kept FROM met)
SELECT doc_id, len(list_distinct(kept))::BIGINT AS places, kept[1] AS first FROM held""")
def places_in_documents(spark, sf_dir):
    """Names are the first words of a third of the texts; they are sought in all texts, whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.filter(F.split("text", r"[\s_.،,()\[\]/\\+*\u200c\u200d\u200e\u200f\u00a0-]+"), lambda x: x != "")
    none = F.lit(None).cast("string")
    names = docs.where("doc_id % 3 = 0").select(F.lit("city").alias("kind"), F.get(words, F.lit(0)).alias("name"), none.alias("county"), none.alias("province")).where("length(name) BETWEEN 4 AND 12")
    got = geo.places_in_texts(docs, names, "doc_id", "text")
    return got.select("doc_id", F.size("found").cast("bigint").alias("places"), F.col("found")[0]["name"].alias("first"))


@query(f"""WITH {ctes("places")} SELECT id, CASE WHEN id % 2 = 0 THEN concat('0', CAST(id % 10 AS VARCHAR)) ELSE '099' END AS area_code FROM places""")
def area_codes_of_cities(spark, sf_dir):
    p = directory(spark, sf_dir, "places")["places"]
    known = p.where("id % 2 = 0").select(F.lit("city").alias("kind"), F.col("city").alias("name"), "county", "province", F.concat(F.lit("0"), (F.col("id") % 10).cast("string")).alias("area_code"))
    provinces = p.select("province").distinct().select(F.lit("province").alias("kind"), F.col("province").alias("name"), F.lit(None).cast("string").alias("county"), "province", F.lit("099").alias("area_code"))
    return geo.area_codes(p, known.unionByName(provinces)).select("id", "area_code")


_FLAT = """SELECT kind, name, county, province, area_code FROM (SELECT 'province' AS kind, r_name AS name, NULL AS county, r_name AS province, concat('0', CAST(r_regionkey AS VARCHAR)) AS area_code FROM region
UNION ALL SELECT 'county', n_name, n_name, r_name, concat('0', CAST(r_regionkey AS VARCHAR)) FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'city', concat(n_name, ' city'), n_name, r_name, concat('0', CAST(r_regionkey AS VARCHAR)) FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query(_FLAT)
def flat_locations(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return geo.flat_places(
        r.selectExpr("r_regionkey AS id", "r_name AS name", "concat('0', r_regionkey) AS area_code"), n.selectExpr("n_nationkey AS id", "n_name AS name", "n_regionkey AS province_id"),
        n.selectExpr("concat(n_name, ' city') AS name", "n_nationkey AS county_id"),
    ).select("kind", "name", "county", "province", "area_code")


@query(_FLAT)
def nested_locations(spark, sf_dir):
    """The same from one JSON file of provinces that hold counties that hold cities."""
    from quarryline.operators.components import shared_path

    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    counties = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct(F.col("n_name").alias("name"), F.array(F.concat("n_name", F.lit(" city"))).alias("cities"))).alias("counties"))
    p = r.join(counties, "r_regionkey").select(F.struct(F.col("r_name").alias("name"), F.array(F.concat(F.lit("0"), F.col("r_regionkey").cast("string"))).alias("area_codes"), "counties").alias("p"))
    path = shared_path(spark, "places")
    p.agg(F.to_json(F.struct(F.collect_list("p").alias("provinces"))).alias("value")).coalesce(1).write.text(path)
    return geo.nested_places(spark, path).select("kind", "name", "county", "province", "area_code")


@query("SELECT 'city' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'province', count(*) FROM region")
def place_counts(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation").select(F.lit("city").alias("kind")), table(spark, sf_dir, "region").select(F.lit("province").alias("kind"))
    return geo.counts(n.unionByName(r))


@query("""SELECT lower(kind) AS kind, name, had FROM (SELECT 'city' AS kind, n_name AS name, n_nationkey < 10 AS had FROM nation)""")
def seeded_locations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.lit("city").alias("kind"), F.col("n_name").alias("name"), "n_nationkey")
    at = F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'")
    old = n.where("n_nationkey < 10").select(F.col("n_nationkey").cast("bigint").alias("id"), "kind", text.name_key("name").alias("name_key"), F.lit("old").alias("name"), F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00'").alias("created_at"))
    return upsert.seeded_locations(old, n.drop("n_nationkey"), at).select("kind", "name", (F.col("created_at") < at).alias("had"))


@query(f"WITH {ctes('sources')} SELECT key, kind, reliability FROM (SELECT key, kind, 0.9::DOUBLE AS reliability FROM sources WHERE id < 20 UNION ALL SELECT DISTINCT concat('x', CAST(event_id % 3 AS VARCHAR)), 'SEARCH_ENGINE', 0.5 FROM events)")
def seeded_sources(spark, sf_dir):
    s = directory(spark, sf_dir, "sources")["sources"].where("id < 20").withColumn("reliability", F.lit(0.9))
    e = table(spark, sf_dir, "events")
    seen = e.select(F.concat(F.lit("x"), (F.col("event_id") % 3).cast("string")).alias("key")).unionByName(s.select("key")).unionByName(e.select(F.lit(None).cast("string").alias("key")))
    return upsert.seeded_sources(s, seen, F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'")).select("key", "kind", "reliability")


# ---- pages


@query("""SELECT s_suppkey, s_name AS name, concat('+9821', lpad(CAST(s_suppkey AS VARCHAR), 8, '4')) AS phones, concat('Road ', CAST(s_nationkey AS VARCHAR), '، ', 'Town') AS address, 'Town' AS city, concat('Boss ', CAST(s_suppkey AS VARCHAR)) AS owner, 'JSON_LD' AS kind FROM supplier""")
def structured_candidates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "concat('http://a.ir/', s_suppkey) AS url",
        """concat('<html><script type="application/ld+json">{"@graph":[{"@type":["Thing","LocalBusiness"],"name":"', s_name, '","telephone":"021', lpad(s_suppkey, 8, '4'), '","address":{"streetAddress":"Road ', s_nationkey, '","addressLocality":"Town"},"founder":{"name":"Boss ', s_suppkey, '"},},{"@type":"WebPage","name":"no"}]}</script>text</html>') AS html""",
    )
    got = pages.extract(s.select("url", "html")).join(s.select("s_suppkey", "url"), "url")
    return got.select("s_suppkey", "name", F.array_join("phones", ",").alias("phones"), "address", "city", "owner", "kind")


@query("""SELECT p_partkey, concat(p_name, ' ', k) AS name, concat('+98912', lpad(CAST(p_partkey AS VARCHAR), 6, '3'), k) AS phones, 'http://own.ir/' || k AS website, 'DIRECTORY_ENTRY' AS kind FROM part, (VALUES ('1'), ('2'), ('3')) v(k)""")
def listing_candidates(spark, sf_dir):
    entry = "concat('<li class=\"row\"><div class=\"item\"><h3>', p_name, ' {k}</h3><p>موبایل 0912', lpad(p_partkey, 6, '3'), '{k}</p><a href=\"http://own.ir/{k}\">w</a><a href=\"https://t.me/x{k}\">t</a></div></li>')"
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('http://a.ir/', p_partkey) AS url", "concat('<html><body><ul>', " + ", ".join(entry.format(k=k) for k in (1, 2, 3)) + ", '</ul></body></html>') AS html")
    got = pages.extract(p.select("url", "html")).join(p.select("p_partkey", "url"), "url")
    return got.select("p_partkey", "name", F.array_join("phones", ",").alias("phones"), "website", "kind")


@query(f"""WITH {ctes("places")} SELECT n_nationkey, concat('Shop ', CAST(n_nationkey AS VARCHAR)) AS name, concat('+98912', lpad(CAST(n_nationkey AS VARCHAR), 7, '3')) AS phones, concat('Kart ', CAST(n_nationkey AS VARCHAR)) AS city, 'PAGE_TEXT' AS kind FROM nation""")
def page_candidates(spark, sf_dir):
    """A page as a whole: its heading, the phone of its telephone link, and the place that its prose names."""
    p = directory(spark, sf_dir, "places")["places"]
    g = geo.load(p.select(F.lit("city").alias("kind"), F.concat(F.lit("Kart "), F.col("id").cast("string")).alias("name"), "county", "province"))
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "concat('http://a.ir/', n_nationkey) AS url", "concat('<html><body><h1>Shop ', n_nationkey, '</h1><p>we are in Kart ', n_nationkey, ' now</p><a href=\"tel:0912', lpad(n_nationkey, 7, '3'), '\">call</a></body></html>') AS html")
    got = pages.extract(n.select("url", "html"), gazetteer=g).join(n.select("n_nationkey", "url"), "url")
    return got.select("n_nationkey", "name", F.array_join("phones", ",").alias("phones"), "city", "kind")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat('Brand ', p_name) WHEN 2 THEN concat('Site ', p_name) ELSE p_name END AS title FROM part""")
def page_titles(spark, sf_dir):
    h = """CASE p_partkey % 4 WHEN 0 THEN concat('<title>no</title><h1> ', p_name, ' </h1>') WHEN 1 THEN concat('<title>no</title><div class="x brand">Brand ', p_name, '</div>') WHEN 2 THEN concat('<meta property="og:site_name" content="Site ', p_name, '"><title>no</title>') ELSE concat('<title>', p_name, ' | rest</title>') END"""
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{h} AS h").select("p_partkey", pages.titles("h").alias("title"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('Road ', p_name) WHEN 1 THEN concat('خیابان ', p_name) END AS address, p_partkey % 3 = 1 AS looks, CASE WHEN p_partkey % 2 = 0 THEN 'علی رضایی' END AS owner FROM part""")
def addresses_and_owners(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN concat('آدرس: Road ', p_name, ' تلفن 1') WHEN 1 THEN concat('خیابان ', p_name) ELSE 'nothing here' END AS t", "if(p_partkey % 2 = 0, 'مدیرعامل: علی رضایی - 5', 'مالک: 123') AS o")
    return p.select("p_partkey", pages.address_from_text("t").alias("address"), pages.looks_like_address(F.when(F.col("p_partkey") % 3 == 1, F.col("t")).otherwise("nothing at all")).alias("looks"), pages.owner_name("o").alias("owner"))


# ---- relevance and confidence

_TERMS = Lexicon(categories={"RED": (("red", 3.0),), "SMALL": (("small ring", 2.5), ("small", 1.0))}, roles={"MAKER": (("economy", 2.0),), "SELLER": (("standard", 1.5),)}, signals=(("brand", 1.5),), negatives=(("widget", 1.0),), spam=(("gizmo", 1.0),))
_W = {k: "(" + " + ".join(f"CASE WHEN regexp_matches({{x}}, '(^|[^a-z0-9_]){t.replace(' ', '[ _-]*')}($|[^a-z0-9_])') THEN {w}e0 ELSE 0e0 END" for t, w in g) + ")" for k, g in {"RED": _TERMS.categories["RED"], "SMALL": _TERMS.categories["SMALL"], "MAKER": _TERMS.roles["MAKER"], "SELLER": _TERMS.roles["SELLER"], "sig": _TERMS.signals, "neg": _TERMS.negatives, "spam": _TERMS.spam}.items()}


@query(f"""WITH t AS (SELECT p_partkey, lower(p_name) AS n, lower(concat(p_type, ' ', replace(p_brand, '#', ' '), ' ', CASE WHEN p_partkey % 3 = 0 THEN 'small' ELSE '' END)) AS b FROM part),
s AS (SELECT *, {", ".join(f"2.2e0 * {_W[k].format(x='n')} + 0.8e0 * {_W[k].format(x='b')} AS c_{k}" for k in ("RED", "SMALL"))}, {", ".join(f"2.0e0 * {_W[k].format(x='n')} + 0.6e0 * {_W[k].format(x='b')} AS r_{k}" for k in ("MAKER", "SELLER"))},
 {_W["sig"].format(x="b")} AS sig, {_W["neg"].format(x="b")} + 1.5e0 * {_W["neg"].format(x="n")} AS neg, {_W["spam"].format(x="b")} AS spam FROM t), b AS (SELECT *, greatest(c_RED, c_SMALL) AS best, greatest(r_MAKER, r_SELLER) AS best_role FROM s)
SELECT p_partkey, greatest(0, least(100, round_even(2.2e0 * least(best, 22.0e0) + 1.2e0 * least(sig, 12.0e0) + CASE WHEN best > 0 THEN 18.0e0 ELSE 0 END - 6.0e0 * neg - 12.0e0 * spam, 0)))::INT AS relevance,
 CASE WHEN best = 0 THEN NULL WHEN c_RED = best THEN 'RED' ELSE 'SMALL' END AS category, CASE WHEN best_role = 0 THEN 'UNKNOWN' WHEN r_MAKER = best_role THEN 'MAKER' ELSE 'SELLER' END AS role FROM b""")
def relevance_of_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name AS name", "concat(p_type, ' ', replace(p_brand, '#', ' '), ' ', if(p_partkey % 3 = 0, 'small', '')) AS body")
    return relevance.score_relevance(p, "name", "body", _TERMS).select("p_partkey", "relevance", "category", "role")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 3.0 ELSE 0.0 END + CASE WHEN p_partkey % 3 = 0 THEN 9.0 ELSE 0.0 END AS weight FROM part""".replace(" AS weight", "::DOUBLE AS weight").replace("SELECT p_partkey, ", "SELECT p_partkey, (").replace("::DOUBLE", ")::DOUBLE"))
def overridden_lexicon(spark, sf_dir):
    """A reference file that adds a term, repeats one (the first stays) and replaces a group, read from a file."""
    from quarryline.functions import lexicon
    from quarryline.operators.components import shared_path

    path = shared_path(spark, "lexicon")
    said = '{"categories": {"RED": [["red", 7.0], ["blue", 9.0]], "SMALL": {"replace": true, "terms": [["tiny", 1.0]]}}}'
    spark.range(1).select(F.lit(said).alias("value")).write.text(path)
    group = lexicon.load(spark, path, _TERMS)
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat_ws(' ', if(p_partkey % 2 = 0, 'red', 'x'), if(p_partkey % 3 = 0, 'blue', 'y'), 'small') AS t")
    return p.select("p_partkey", (relevance.weight("t", group.categories["RED"]) + relevance.weight("t", group.categories["SMALL"])).alias("weight"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'spam_terms' WHEN 1 THEN 'many_links' WHEN 2 THEN 'many_phones' ELSE 'dense_phones' END AS flags FROM part""")
def page_spam_flags(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "if(p_partkey % 4 = 0, 'a gizmo', 'text') AS t", "if(p_partkey % 4 = 1, 300, 2) AS links", "CASE p_partkey % 4 WHEN 2 THEN 30 WHEN 3 THEN 15 ELSE 1 END AS phones")
    return p.select("p_partkey", F.array_join(relevance.spam_flags("t", "links", "phones", _TERMS), ",").alias("flags"))


@query("""WITH l AS (SELECT l_suppkey AS id, list_sort(list_distinct(list(l_discount * 10))) AS kinds, count(*) AS n FROM lineitem GROUP BY 1)
SELECT s_suppkey AS id, round(CASE WHEN kinds IS NULL THEN 0 ELSE 100 * (0.7 * list_max(kinds) + 0.3 * list_avg(kinds)) END, 6) AS source FROM supplier LEFT JOIN l ON l.id = s_suppkey""")
def source_component(spark, sf_dir):
    """Confidence of several reliabilities: seven tenths of the best and three of their mean."""
    from quarryline.functions import confidence

    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set(F.col("l_discount") * 10).alias("reliabilities"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).join(l, "id", "left").withColumn("reliabilities", F.coalesce("reliabilities", F.array().cast("array<double>")))
    yes, none = F.lit(True), F.array().cast("array<string>")
    rows = rows.withColumns({k: yes for k in ("has_name", "has_address", "has_website", "has_owner", "location_known", "business_type_known", "area_matches")} | {"domains": F.lit(1), "observations": F.lit(1), "phone_quality": F.lit(1.0), "phone_type": F.lit("LANDLINE"), "fake_signals": none, "is_synthetic": F.lit(False), "relevance": F.lit(50), "spam": F.lit(False), "newest": F.expr("TIMESTAMP_NTZ '1999-01-01'")})
    return confidence.score_confidence(rows, F.expr("TIMESTAMP_NTZ '1999-06-01'")).select("id", F.round("components.source", 6).alias("source"))
