"""What a crawler may fetch and when: robots rules, a pace per domain, pauses after failures, and a cache of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.functions.urls import domain_of, url_hash_key
from quarryline.operators.components import cut
from quarryline.operators.joins import looked_up
from quarryline.operators.scans import numbered, paced, streaks


def robots_rules(files: DataFrame, agent: str = "quarryline") -> DataFrame:
    """(domain, rules array<struct<allow, path>>, delay) of what holds for ``agent`` in ``files(domain, body)``.

    Agent lines that follow each other begin one group for all of them. The groups that name the agent hold, all together, or else those for
    every agent. A rule without a path says nothing, and neither do lines before the first agent. A file is one row.
    """
    # lines as (field, value), without comments and what isn't a field
    lines = F.transform(F.split(F.regexp_replace("body", "\ufeff", ""), "\r\n|\r|\n"), lambda x: F.regexp_replace(x, "#.*", ""))
    line = lambda x: F.struct(F.lower(F.regexp_extract(x, r"^\s*([A-Za-z-]+)\s*:", 1)).alias("field"), F.btrim(F.regexp_extract(x, r"^\s*[A-Za-z-]+\s*:(.*)$", 1), F.lit(" \t")).alias("value"))
    parsed = F.filter(F.transform(lines, line), lambda x: x["field"].isin("user-agent", "allow", "disallow", "crawl-delay"))
    rows = files.select("domain", F.posexplode(parsed).alias("at", "x")).select("domain", "at", "x.field", "x.value")
    # a file's lines are in one row before and few, so a window over them is no window over a large group
    w = W.partitionBy("domain").orderBy("at")
    begins = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    rows = rows.withColumn("begins", begins).withColumn("group", F.count_if("begins").over(w)).where("group > 0")
    name = F.lower(F.regexp_extract("value", r"^([A-Za-z_-]*|\*)", 1))
    groups = rows.groupBy("domain", "group").agg(
        F.collect_set(F.when(F.col("field") == "user-agent", F.when(F.col("value") == "*", "*").otherwise(name))).alias("agents"),
        F.array_compact(F.collect_list(F.when(F.col("field").isin("allow", "disallow") & (F.col("value") != ""), F.struct((F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))))).alias("rules"),
        F.max(F.when(F.col("field") == "crawl-delay", F.expr("try_cast(value as double)"))).alias("delay"),
    ).withColumns({"own": F.array_contains("agents", agent.lower()), "any": F.array_contains("agents", "*")}).where("own or any")
    groups = cut(groups, "groups")  # read twice below; a file is taken apart once
    named = groups.groupBy("domain").agg(F.max("own").alias("named"))
    held = groups.join(named, "domain").where("own = named")
    return held.groupBy("domain").agg(F.flatten(F.collect_list("rules")).alias("rules"), F.max("delay").alias("delay"))


def _path(url: str) -> Column:
    """Path and query of a URL, which rules are about; the top if there is none."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))


def allowed(fetches: DataFrame, rules: DataFrame) -> DataFrame:
    """``fetches(id, url)`` with ``allowed``: of the rules that match a URL's path the longest decides, of equally long ones one that allows; none allows.

    ``*`` in a rule stands for any characters and ``$`` at its end for the end of the path. What is before the first of them is a prefix: the prefixes
    of a path at the lengths that its domain's rules have are joined to these, so a fetch meets only rules whose beginning it has.
    """
    one = rules.select("domain", F.explode("rules").alias("r")).select("domain", "r.allow", F.col("r.path").alias("rule")).distinct()
    one = one.withColumn("head", F.regexp_extract("rule", r"^(.*?)(?:\*|\$$|$)", 1))
    rest = F.substring("rule", F.length("head") + 1, F.length("rule"))
    quoted = F.concat_ws(".*", F.transform(F.split(F.regexp_replace(rest, r"\$$", ""), r"\*"), lambda x: F.when(x == "", "").otherwise(F.concat(F.lit("\\Q"), x, F.lit("\\E")))))
    pattern = F.when(rest != "", F.concat(F.lit("^"), quoted, F.when(rest.endswith("$"), "$").otherwise("")))
    one = cut(one.withColumn("pattern", pattern), "rules")
    heads = one.groupBy("domain", "head").agg(F.collect_list(F.struct("allow", F.length("rule").alias("n"), "pattern")).alias("rules"))
    lengths = one.groupBy("domain").agg(F.collect_set(F.length("head")).alias("lengths"))

    f = fetches.withColumns({"domain": domain_of("url"), "path": _path("url")})
    with_lengths = looked_up(f.where("domain is not null"), cut(lengths.join(f.groupBy("domain").agg(F.count("*").alias("n")), "domain"), "lengths"), "domain", "n")
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    prefixes = with_lengths.select("id", "path", "domain", F.explode(fitting).alias("n")).select("id", "path", F.struct("domain", F.expr("left(path, n)").alias("head")).alias("key"))
    prefixes = cut(prefixes, "prefixes")  # read several times below
    sizes = prefixes.groupBy("key").agg(F.count("*").alias("n"))
    met = looked_up(prefixes, cut(heads.select(F.struct("domain", "head").alias("key"), F.col("rules").alias("found")).join(sizes, "key"), "heads"), "key", "n")
    tail = F.substring("path", F.length("key.head") + 1, F.length("path"))
    hits = met.select("id", tail.alias("tail"), F.explode("found").alias("r")).where("r.pattern is null or regexp_like(tail, r.pattern)")
    best = hits.groupBy("id").agg(F.max_by("r.allow", F.struct("r.n", F.col("r.allow").cast("int").alias("a"))).alias("allowed"))
    return f.join(best, "id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(True))).select(*fetches.columns, "allowed")


def rates(rules: DataFrame, default: float = 1.0, least: float = 0.05) -> DataFrame:
    """(domain, rate): fetches a second by the delay that a domain asks for, never under ``least``; without a delay, ``default``."""
    rate = F.when(F.col("delay") > 0, 1 / F.col("delay")).otherwise(F.lit(default))
    return rules.select("domain", F.greatest(rate, F.lit(least)).alias("rate"))


def schedule(fetches: DataFrame, domain: str, order: list[str], rate: float = 1.0, least: float = 0.05) -> DataFrame:
    """``fetches`` with the seconds each has to wait so that a domain gets at most ``rate`` a second, if all are there at once."""
    out = numbered(fetches, domain, order, "__turn")
    return out.withColumn("wait", ((F.col("__turn") - 1) / F.lit(max(rate, least))).cast("bigint")).drop("__turn")


def paced_fetches(fetches: DataFrame, domain: str, arrival: str, order: list[str], own: DataFrame | None = None, default: float = 1.0, least: float = 0.05) -> DataFrame:
    """``fetches`` with ``goes_at``, when each goes if a domain's go in order of arrival, then ``order``, at the pace of the domain.

    own: (domain, rate) of domains with a rate of their own. Moments are exact to the microsecond.
    """
    rows = fetches.withColumn("__arrived", F.unix_micros(F.col(arrival).cast("timestamp")))
    if own is None:
        rows = rows.withColumn("__rate", F.lit(default))
    else:
        found = own.select(F.col("domain").alias(domain), F.col("rate").alias("__rate")).join(rows.groupBy(domain).agg(F.count("*").alias("__n")), domain)
        none = rows.join(own.select(F.col("domain").alias(domain)), domain, "left_anti").withColumn("__rate", F.lit(default))
        rows = looked_up(rows, found, domain, "__n").unionByName(none)
    gap = F.ceil(1_000_000 / F.greatest(F.col("__rate"), F.lit(least)))
    out = paced(rows, domain, ["__arrived", *order], F.col("__arrived"), gap, "__goes")
    return out.withColumn("goes_at", F.timestamp_micros("__goes")).drop("__arrived", "__rate", "__goes")


def failure_streaks(log: DataFrame, domain: str, order: list[str], failed: str) -> DataFrame:
    """Failures of a log with how many there are in a row, ``streak``: a success starts anew."""
    return streaks(log, domain, order, F.col(failed)).where("streak > 0")


def blocked(log: DataFrame, domain: str, at: str, order: list[str], failed: str, as_of: Column, after: int = 5, seconds: int = 120) -> DataFrame:
    """Domains that ``after`` failures in a row have blocked until later than ``as_of``."""
    hits = failure_streaks(log, domain, order, failed).where(F.col("streak") % after == 0)
    return hits.groupBy(domain).agg((F.max(at) + F.expr(f"INTERVAL {seconds} SECONDS")).alias("blocked_until")).where(F.col("blocked_until") > as_of)


def cache_read(fetches: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """``fetches(url)`` with what the cache still holds of them; ``ok`` only for answers of status 200."""
    live = cache.where(F.col("expires_at") >= as_of).select("url_hash", "status", "body")
    return fetches.withColumn("url_hash", url_hash_key("url")).join(live, "url_hash", "left").withColumn("ok", F.coalesce(F.col("status") == 200, F.lit(False)))


def cache_write(cache: DataFrame, answers: DataFrame, as_of: Column, hours: int = 72) -> DataFrame:
    """The cache with the newest of ``answers(url, status, content_type, body)`` of each URL in place of older ones, and without what expired."""
    new = answers.withColumns({"url_hash": url_hash_key("url"), "fetched_at": as_of, "expires_at": as_of + F.expr(f"INTERVAL {hours} HOURS")})
    new = new.groupBy("url_hash").agg(F.max(F.struct("status", *[c for c in cache.columns if c not in ("url_hash", "status")])).alias("x")).select("url_hash", "x.*")
    kept = cache.where(F.col("expires_at") >= as_of).join(new.select("url_hash"), "url_hash", "left_anti")
    return kept.select(cache.columns).unionByName(new.select(cache.columns))


def blocklist(spark: SparkSession, path: str) -> DataFrame:
    """(pattern) of a file of one pattern a line; blank lines and those after a hash mark say nothing."""
    lines = spark.read.text(path).select(F.btrim("value").alias("pattern"))
    return lines.where((F.col("pattern") != "") & ~F.col("pattern").startswith("#")).distinct()


def unblocked(fetches: DataFrame, patterns: DataFrame) -> DataFrame:
    """``fetches(url)`` without those whose domain, or a domain above it, is a pattern."""
    labels = F.split(domain_of("url"), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    bad = fetches.select("url", F.explode(above).alias("pattern")).join(patterns, "pattern", "left_semi").select("url").distinct()
    return fetches.join(bad, "url", "left_anti")
