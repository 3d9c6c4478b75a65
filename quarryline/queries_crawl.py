"""Queries about fetching: robots rules, pace, pauses, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators.scans import numbered, paced
from quarryline.registry import query, table
from quarryline.sources import politeness

# Rules and fetches of forty hosts, made of the parts: the words of a part's name are folders, its size says what a rule looks like and which agents it is for.
_WORDS = "split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b"
_RULE = "CASE p_size % 5 WHEN 0 THEN '/' || a || '*' || b WHEN 1 THEN '/' || a || '/' || b || '$' WHEN 2 THEN '/' || a WHEN 3 THEN '/*/' || b || '/1' ELSE '/' || a || '/' || b || '/1' END"
_RULES = f"""rules AS (SELECT p_partkey, p_partkey % 40 AS host, p_partkey % 3 = 0 AS allow, {_RULE} AS path,
 CASE WHEN p_size % 3 = 0 AND p_partkey % 40 % 4 <> 0 THEN 'own' WHEN p_size % 3 = 1 THEN 'any' ELSE 'other' END AS section FROM (SELECT p_partkey, p_size, {_WORDS} FROM {{part}}))"""
_FETCHES = f"""fetches AS (SELECT p_partkey AS id, p_partkey * 7 % 40 AS host, '/' || a || '/' || b || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '/' || CAST(p_partkey % 17 AS STRING) END AS path
 FROM (SELECT p_partkey, {_WORDS} FROM {{part}}))"""


def _parts(sf_dir: str) -> str:
    return f"parquet.`{sf_dir}/part.parquet`"


def _robots_files(spark, sf_dir):
    """(domain, body): the rules of a host under the lines that say for which agents they are."""
    rules = spark.sql(f"WITH {_RULES.format(part=_parts(sf_dir))} SELECT * FROM rules")
    line = F.concat(F.when(F.col("allow"), "Allow: ").otherwise("disallow:"), F.col("path"), F.when(F.col("p_partkey") % 2 == 0, " # a note").otherwise(""))
    sections = rules.groupBy("host", "section").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    agents = F.when(F.col("section") == "own", "User-agent: Quarryline/1.0\nuser-agent: friend").when(F.col("section") == "any", "User-agent: other\nUser-Agent: *\nCrawl-delay: 3").otherwise("User-agent: other\n")
    body = F.array_join(F.sort_array(F.collect_list(F.concat(agents, F.lit("\n"), "lines"))), "\n\n")
    return sections.groupBy("host").agg(F.concat(F.lit("# robots\nDisallow: /\nSitemap: http://x/\n"), body).alias("body")).select(F.concat(F.lit("d"), F.col("host").cast("string"), F.lit(".ir")).alias("domain"), "body")


@query(f"""WITH {_RULES.format(part="part")}, {_FETCHES.format(part="part")}, named AS (SELECT DISTINCT host FROM rules WHERE section = 'own'),
held AS (SELECT r.* FROM rules r LEFT JOIN named n USING (host) WHERE r.section = CASE WHEN n.host IS NULL THEN 'any' ELSE 'own' END),
met AS (SELECT f.id, arg_max(h.allow, (length(h.path), h.allow::INT)) AS allow FROM fetches f JOIN held h ON h.host = f.host AND regexp_matches(f.path, '^' || replace(h.path, '*', '.*')) GROUP BY f.id)
SELECT f.id, coalesce(m.allow, true) AS allowed FROM fetches f LEFT JOIN met m ON m.id = f.id""")
def robots_verdicts(spark, sf_dir):
    fetches = spark.sql(f"WITH {_FETCHES.format(part=_parts(sf_dir))} SELECT id, concat('HTTP://www.D', host, '.ir:80', path, if(id % 5 = 0, '#top', '')) AS url FROM fetches")
    return politeness.allowed(fetches, politeness.robots_rules(_robots_files(spark, sf_dir))).select("id", "allowed")


@query(f"""WITH {_RULES.format(part="part")} SELECT 'd' || CAST(host AS VARCHAR) || '.ir' AS domain, CASE WHEN bool_or(section = 'own') OR NOT bool_or(section = 'any') THEN 1.0::DOUBLE ELSE (1 / 3.0::DOUBLE) END AS rate
FROM rules GROUP BY host HAVING bool_or(section IN ('own', 'any'))""")
def robots_rates(spark, sf_dir):
    return politeness.rates(politeness.robots_rules(_robots_files(spark, sf_dir)))


_GAPS = "SELECT event_type AS domain, 1.0::DOUBLE / (60 * length(event_type)) AS rate FROM events GROUP BY 1 HAVING event_type <> 'view'"


@query(f"""WITH own AS ({_GAPS}), e AS (SELECT event_id, event_type, epoch_us(ts) AS us, CAST(ceil(1000000 / greatest(coalesce(rate, 0.01::DOUBLE), 0.001::DOUBLE)) AS BIGINT) AS gap,
 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events LEFT JOIN own ON domain = event_type)
SELECT event_id, make_timestamp((max(us - k * gap) OVER (PARTITION BY event_type ORDER BY k) + k * gap)::BIGINT) AS goes_at FROM e""")
def paced_fetches(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    own = e.where("event_type <> 'view'").groupBy(F.col("event_type").alias("domain")).agg((F.lit(1.0) / (60 * F.length(F.first("event_type")))).alias("rate"))
    out = politeness.paced_fetches(e, "event_type", "ts", ["event_id"], own, default=0.01, least=0.001)
    return out.select("event_id", F.col("goes_at").cast("timestamp_ntz").alias("goes_at"))


@query("""WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS day, (1 + l_suppkey % 3)::BIGINT AS gap FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY day, l_orderkey, l_linenumber, gap) - 1 AS k FROM l)
SELECT l_suppkey, k + 1 AS turn, max(day - k * gap) OVER (PARTITION BY l_suppkey ORDER BY k) + k * gap AS day FROM n""")
def paced_shipments(spark, sf_dir):
    """Line items of a supplier, one every few days: what a pace makes of the days at which they could go."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("__day"))
    out = paced(l, "l_suppkey", ["__day", "l_orderkey", "l_linenumber"], F.col("__day"), 1 + F.col("l_suppkey") % 3, "day")
    return numbered(out, "l_suppkey", ["__day", "l_orderkey", "l_linenumber"], "turn").select("l_suppkey", F.col("turn").cast("bigint").alias("turn"), "day")


# Shops on listing pages made of the parts: names that are like no other, a number each, two pages a size; every fifth size has no answer.
_SHOP = "concat(translate(substr(sha1(CAST(p_partkey AS STRING)), 1, 14), '0123456789', 'ghijklmnop'), ' پخش شوینده')"


@query("""WITH p AS (SELECT p_partkey, p_size AS s, 1 + p_partkey % 2 AS page FROM part), sizes AS (SELECT DISTINCT s FROM p), pages AS (SELECT DISTINCT s, page FROM p WHERE s % 5 <> 0),
firsts AS (SELECT s, s % 5 <> 0 AND 1 IN (SELECT page FROM pages x WHERE x.s = sizes.s) AS found FROM sizes)
SELECT 1 AS round, 'asked' AS what, count(*) AS n FROM sizes UNION ALL SELECT 1, 'failed', count(*) FROM firsts WHERE NOT found UNION ALL SELECT page, 'pages', count(*) FROM pages GROUP BY 1
UNION ALL SELECT 2, 'asked', count(*) FROM firsts WHERE found UNION ALL SELECT 2, 'failed', count(*) FROM firsts WHERE found AND s NOT IN (SELECT s FROM pages WHERE page = 2)
UNION ALL SELECT page, unnest(['new businesses', 'new phones', 'fate keep']), count(*) FROM p WHERE s % 5 <> 0 GROUP BY page UNION ALL SELECT unnest([1, 2]), 'merged', 0""")
def discovery_rounds(spark, sf_dir):
    """Two rounds of a job: the ledger asks for first pages, then for the second pages of queries that found something new."""
    from quarryline import schemas
    from quarryline.plans import discovery

    entry = F.expr(f"concat('<div class=\"biz-item\"><h3>', {_SHOP}, '</h3><p>فروش عمده مواد شوینده و مایع ظرفشویی تلفن: 021-', CAST(30000000 + p_partkey * 389 % 9000000 AS STRING), '</p></div>')")
    p = table(spark, sf_dir, "part")
    sized = p.withColumns({"query_text": F.concat(F.lit("size "), F.col("p_size").cast("string")), "page": (1 + F.col("p_partkey") % 2).cast("int"), "entry": entry})
    body = F.concat(F.lit("<html><body>"), F.array_join(F.array_sort(F.collect_list("entry")), ""), F.lit("</body></html>"))
    answers = sized.where("p_size % 5 <> 0").groupBy("query_text", "page").agg(body.alias("html")).select(
        F.lit("A").alias("source_key"), "query_text", "page", F.concat(F.lit("http://s"), F.regexp_replace("query_text", "\\D", ""), F.lit(".ir/"), F.col("page").cast("string")).alias("url"), "html",
        F.lit(5).cast("long").alias("source_id"), F.lit(0.8).alias("reliability"), F.lit("تهران").alias("city"), F.lit("تهران").alias("province"),
    )
    tasks = sized.groupBy("query_text").agg(F.min("p_partkey").alias("ordinal"))
    sources = spark.createDataFrame([("A", 1)], "source_key string, turn int")
    ledger = spark.createDataFrame([], "source_key string, query_hash string, state string, depth int, run_count int, new_results int, failures int, results_seen int, last_run_at timestamp, next_run_at timestamp")
    empty = {name: schemas.empty(spark, name) for name in schemas.TABLES}
    job = discovery.discover(empty, ledger, tasks, sources, answers, F.expr("TIMESTAMP '2024-06-01 00:00:00'"), rounds=2)
    return job.counts.where("what not like 'fate %' or what = 'fate keep'").where("what <> 'new source_observations'")


_LISTING = """SELECT s_suppkey, CAST(s_suppkey AS STRING) AS query_text, s_name, 30000000 + s_suppkey * 389 % 9000000 AS number, s_nationkey, CASE s_suppkey % 4 WHEN 0 THEN 'BING_API' WHEN 1 THEN 'SEARX' WHEN 2 THEN 'OVERPASS' ELSE 'OWN' END AS source_key FROM {supplier}"""


def _stored_answers(spark, sf_dir):
    """Answers of four sources about the suppliers: an API's, a result page, open data, and one of a source that the query adds itself."""
    s = spark.sql(_LISTING.format(supplier=f"parquet.`{sf_dir}/supplier.parquet`"))
    url, phone = F.concat(F.lit("http://s"), "query_text", F.lit(".ir/")), F.concat(F.lit("021-"), F.col("number").cast("string"))
    said = F.concat(F.lit("call "), phone)
    api = F.to_json(F.struct(F.struct(F.array(F.struct(url.alias("url"), F.col("s_name").alias("name"), said.alias("snippet")), F.struct(F.concat(url, F.lit("b")).alias("url"), F.lit("other").alias("name"), F.lit("none").alias("snippet"))).alias("value")).alias("webPages")))
    page = F.concat(F.lit('<html><article class="result"><h3><a href="'), url, F.lit('">'), "s_name", F.lit("</a></h3><p class=content>"), said, F.lit("</p></article></html>"))
    tags = F.create_map(F.lit("name"), "s_name", F.lit("phone"), F.concat(phone, F.lit("; +98-912-345-67-89")), F.lit("addr:city"), F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("City "), F.col("s_nationkey").cast("string"))))
    openmap = F.to_json(F.struct(F.array(F.struct(F.col("s_suppkey").alias("id"), F.lit("node").alias("type"), tags.alias("tags"))).alias("elements")))
    own = F.concat_ws("\t", url, "s_name", said)
    body = F.when(F.col("source_key") == "BING_API", api).when(F.col("source_key") == "SEARX", page).when(F.col("source_key") == "OVERPASS", openmap).otherwise(own)
    return s.select("source_key", "query_text", F.lit(1).alias("page"), F.concat(F.lit("http://answers/"), "query_text").alias("url"), body.alias("body"))


def _adapters():
    from quarryline.sources.adapters import Adapter, built_in

    cells = lambda k: F.get(F.split("body", "\t"), F.lit(k))
    own = Adapter("OWN", "BUSINESS_DIRECTORY", lambda a: a.select("source_key", "query_text", "page", F.lit(1).alias("rank"), cells(0).alias("url"), cells(1).alias("title"), cells(2).alias("snippet")))
    return built_in().add(own)


@query(f"""WITH s AS ({_LISTING.format(supplier="supplier")})
SELECT source_key, query_text, 1 AS rank, CASE source_key WHEN 'OVERPASS' THEN concat('https://www.openstreetmap.org/node/', query_text) ELSE concat('http://s', query_text, '.ir/') END AS url, s_name AS title, CASE source_key WHEN 'OVERPASS' THEN s_name END AS listed FROM s
UNION ALL SELECT source_key, query_text, 2, concat('http://s', query_text, '.ir/b'), 'other', NULL FROM s WHERE source_key = 'BING_API'""")
def adapter_items(spark, sf_dir):
    return _adapters().items(_stored_answers(spark, sf_dir)).select("source_key", "query_text", "rank", "url", "title", F.col("listed.name").alias("listed"))


@query(f"""WITH s AS ({_LISTING.format(supplier="supplier")})
SELECT query_text, s_name AS name, CASE WHEN source_key = 'OVERPASS' THEN 78 ELSE 45 END AS hint, CASE WHEN source_key = 'OVERPASS' THEN 'DIRECTORY_ENTRY' ELSE 'SEARCH_SNIPPET' END AS kind,
 concat('+9821', CAST(number AS VARCHAR), CASE WHEN source_key = 'OVERPASS' THEN ',+989123456789' ELSE '' END) AS phones, CASE WHEN source_key = 'OVERPASS' AND s_nationkey % 2 = 0 THEN concat('City ', CAST(s_nationkey AS VARCHAR)) END AS city FROM s""")
def item_candidates(spark, sf_dir):
    """What items list by themselves and what their titles and snippets say, as candidates."""
    from quarryline.sources import adapters

    found = adapters.candidates(_adapters().items(_stored_answers(spark, sf_dir)))
    return found.select("query_text", "name", "hint", "kind", F.array_join("phones", ",").alias("phones"), "city")
