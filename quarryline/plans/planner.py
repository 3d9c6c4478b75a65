"""Planning of search queries: scope, expansion, admission by the ledger, and its update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.fingerprint import query_fingerprint
from quarryline.functions.lexicon import QUERY_KEYWORDS, QUERY_ROLES, QUERY_SHAPES
from quarryline.functions.text import name_key, search_text


def scope(cities: DataFrame, existing: DataFrame, provinces=(), counties=(), names=(), small_first: bool = True, most: int | None = None) -> DataFrame:
    """Cities of ``cities(city, county, province)`` that are asked for, with how many records are there: few first, or many first."""
    keep = F.lit(True)
    for column, values in (("province", provinces), ("county", counties), ("city", names)):
        if values:
            keep = keep & F.array_contains(F.array(*(name_key(F.lit(v)) for v in values)), name_key(column))
    n = existing.groupBy("city").agg(F.count("*").alias("existing"))
    rows = cities.where(keep).join(n, "city", "left").fillna(0, ["existing"])
    order = [F.asc("existing"), F.length("city"), F.asc("city")] if small_first else [F.desc("existing"), F.asc("city")]
    rows = rows.orderBy(*order, "province", "county")
    return rows.limit(most) if most else rows


def expand(scoped: DataFrame, categories: dict | None = None, roles: dict | None = None, shapes: tuple[str, ...] = QUERY_SHAPES, terms_each: int = 2) -> DataFrame:
    """(task, query_text, city, county, province, category, role, shape): all queries of a scope, each text once, by scope order and shape.

    The lists are fixed and short, so they are an array that is exploded beside each city; nothing is shuffled but to find repeats.
    """
    categories, roles = categories or QUERY_KEYWORDS, roles or QUERY_ROLES
    fills = [
        (c, r, k, shape, ct, rt) for c, cts in categories.items() for r, rts in roles.items() for k, shape in enumerate(shapes) for ct in cts[:terms_each] for rt in rts[:terms_each]
    ]
    struct = lambda k, x: F.struct(F.lit(k).alias("ordinal"), *(F.lit(v).alias(n) for v, n in zip(x, ("category", "role", "shape", "template", "ct", "rt"), strict=True)))
    rows = scoped.withColumn("place", F.xxhash64("city", "county", "province")).withColumn("f", F.explode(F.array(*(struct(k, x) for k, x in enumerate(fills)))))
    text = F.col("f.template")
    for name, value in (("category", "f.ct"), ("role", "f.rt"), ("city", "city"), ("county", "county"), ("province", "province")):
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.col(value), F.lit("")))
    rows = rows.select("city", "county", "province", "place", "f.ordinal", "f.category", "f.role", F.col("f.shape").alias("shape"), search_text(text).alias("query_text"))
    first = F.min(F.struct("ordinal", "place", "city", "county", "province", "category", "role", "shape"))
    return rows.groupBy("query_text").agg(first.alias("x")).select("query_text", "x.*")


def admit(tasks: DataFrame, sources: DataFrame, ledger: DataFrame, as_of: Column, max_pages: int = 3, refresh_days: int = 14, budget: int | None = None) -> DataFrame:
    """Tasks with the first source that the ledger admits, the page to ask for and why; tasks without one aren't in it.

    tasks: (query_text, ordinal, ...). sources: (source_key, turn). ledger: (source_key, query_hash, state, depth, run_count,
    new_results, last_run_at, next_run_at).
    """
    rows = tasks.withColumn("s", F.explode(F.array(*(F.struct(F.lit(r["source_key"]).alias("source_key"), F.lit(r["turn"]).alias("turn")) for r in sources.orderBy("turn").collect()))))
    rows = rows.select(*tasks.columns, "s.source_key", "s.turn").withColumn("query_hash", query_fingerprint("source_key", "query_text"))
    rows = rows.join(ledger, ["source_key", "query_hash"], "left")
    is_due = F.col("next_run_at").isNull() | (F.col("next_run_at") <= as_of)
    dry = (F.col("state") == "DONE") & (F.col("new_results") == 0) & (F.col("run_count") >= 1)
    stale = F.col("last_run_at") <= as_of - F.expr(f"INTERVAL {refresh_days} DAYS")
    said = lambda page, why: F.struct(page.cast("int").alias("page"), F.lit(why).alias("why"))
    choice = (
        F.when(F.col("state").isNull(), said(F.lit(1), "new"))
        .when(F.col("state") == "BLOCKED", None)
        .when(dry, F.when(F.col("next_run_at") <= as_of, said(F.lit(1), "refresh")))
        .when(F.col("depth") < max_pages, F.when(is_due, said(F.col("depth") + 1, "deeper")))
        .when(stale, said(F.lit(1), "refresh"))
    )
    rows = rows.withColumn("choice", choice).where("choice is not null")
    rest = [c for c in tasks.columns if c != "query_text"]
    first = rows.groupBy("query_text").agg(F.min_by(F.struct(*rest, "source_key", "query_hash", "choice"), "turn").alias("x")).select("query_text", "x.*")
    out = first.select("query_text", *rest, "source_key", "query_hash", "choice.page", "choice.why")
    return out.orderBy("ordinal", "query_text").limit(budget) if budget else out


def shuffled(tasks: DataFrame, seed: int) -> DataFrame:
    """Tasks with ``ordinal`` in an order that looks random and is the same for a seed."""
    return tasks.withColumn("ordinal", F.xxhash64("query_text", F.lit(seed)))


def finalise(ledger: DataFrame, runs: DataFrame, as_of: Column, refresh_days: int = 14) -> DataFrame:
    """The ledger after ``runs(source_key, query_hash, page, outcome, results, found)``; outcome is DONE, FAILED or BLOCKED, one run a query."""
    o = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    rows = ledger.join(runs, ["source_key", "query_hash"], "full_outer")
    ran, failed, ok = F.col("outcome").isNotNull(), F.col("outcome") == "FAILED", F.col("outcome") == "DONE"
    failures = F.when(failed, o("failures", 0) + 1).when(ok, F.lit(0)).otherwise(o("failures", 0))
    pause = F.expr("make_interval(0, 0, 0, 0, 6, 0, 0)")
    rows = rows.withColumns({
        "run_count": o("run_count", 0) + ran.cast("int"), "failures": failures,
        "state": F.when(failed, "COOLING").when(F.col("outcome") == "BLOCKED", "BLOCKED").when(ok, "DONE").otherwise(F.col("state")),
        "depth": F.when(ok, F.greatest(o("depth", 0), F.col("page"))).otherwise(o("depth", 0)),
        "results_seen": o("results_seen", 0) + F.coalesce("results", F.lit(0)), "new_results": F.when(ok, F.col("found")).otherwise(o("new_results", 0)),
        "last_run_at": F.when(ran, as_of).otherwise(F.col("last_run_at")),
    })
    later = F.when(failed, as_of + pause * F.greatest(F.lit(1), F.col("failures"))).when(ok & (F.col("found") == 0), as_of + F.expr(f"INTERVAL {refresh_days} DAYS")).when(ok, F.lit(None))
    return rows.withColumn("next_run_at", F.when(ran, later).otherwise(F.col("next_run_at"))).select(ledger.columns)
