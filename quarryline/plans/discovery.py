"""A discovery run as one batch: candidates of fetched pages are scored, gated, identified and folded into the tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import pages as pages_of
from quarryline.functions.fingerprint import business_fingerprint, observation_fingerprint
from quarryline.functions.lexicon import DEFAULT, Lexicon
from quarryline.functions.phones import PLAN, PhonePlan, is_synthetic, parse_phone
from quarryline.functions.relevance import score_relevance, spam_flags
from quarryline.functions.text import name_key
from quarryline.functions.urls import domain_of, url_hash_key
from quarryline.operators import dedup, revalidate, upsert
from quarryline.operators.components import cut
from quarryline.operators.joins import dealt
from quarryline.plans import planner
from quarryline.session import Settings


@dataclass
class Outcome:
    """The tables after a run, and what came of the candidates: counts by fate."""

    tables: dict[str, DataFrame]
    fates: DataFrame


def candidates(fetched: DataFrame, lexicon: Lexicon = DEFAULT, plan: PhonePlan = PLAN) -> DataFrame:
    """Scored candidates of ``fetched(url, html, source_id, reliability, city, province, arrival)``; the place is the query's if a page names none."""
    found = pages_of.extract(fetched.select("url", "html"), plan=plan).withColumnRenamed("city", "named_city")
    rows = found.join(fetched.drop("html"), "url").withColumns({"city": F.coalesce("named_city", "city"), "location_confidence": F.when(F.col("named_city").isNotNull(), 80).otherwise(40)})
    return _scored(rows, lexicon)


def listed_candidates(found: DataFrame, asked: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Scored candidates of ``adapters.candidates``; ``asked(source_key, query_text, source_id, reliability, city, province)`` says where they were asked for, which holds if they name no place."""
    where = asked.select("source_key", "query_text", "source_id", "reliability", F.col("city").alias("asked_city"), F.col("province").alias("asked_province"))
    rows = found.join(where, ["source_key", "query_text"]).withColumns({
        "location_confidence": F.when(F.col("city").isNotNull(), 80).otherwise(40), "city": F.coalesce("city", "asked_city"), "province": F.coalesce("province", "asked_province"), "arrival": F.col("cid"),
    }).drop("asked_city", "asked_province", "query_text", "source_key", "page")
    return _scored(rows, lexicon)


def _scored(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    body = F.concat_ws(" ", "text", "address")
    # terms are long work for rows of few bytes, which would be joined into few tasks
    rows = score_relevance(dealt(rows, "cid").withColumn("body", body), "name", "body", lexicon)
    flags = spam_flags("text", phones=F.size("phones"), lexicon=lexicon)
    return rows.withColumns({"is_spam": F.size(flags) > 0, "domain": domain_of("website"), "categories": F.array_compact(F.array("category")), "business_type": F.col("role")})


def run(tables: dict[str, DataFrame], fetched: DataFrame, as_of: Column, lexicon: Lexicon = DEFAULT, plan: PhonePlan = PLAN, settings: Settings = Settings(), listed: DataFrame | None = None) -> Outcome:
    """One batch of pages folded in, and with ``listed`` what sources list by themselves (``listed_candidates``); the same batch again changes no counts.

    Spam is dropped, what isn't relevant leaves evidence without a business, what has neither phone nor website is skipped.
    """
    scored = candidates(fetched, lexicon, plan)
    scored = scored if listed is None else scored.unionByName(listed, allowMissingColumns=True)
    gated = cut(upsert.gate(scored, settings), "gated")
    kept = gated.where("fate = 'keep'").withColumnRenamed("owner", "owner_name")
    links = tables["business_phones"].join(tables["phones"].select(F.col("id").alias("phone_id"), "e164"), "phone_id").select(F.col("business_id").alias("id"), "e164")
    known = tables["businesses"].where("status <> 'MERGED'").select("id", "fingerprint", "name", F.col("city_name").alias("city"))
    named = cut(upsert.identify(kept, known, links), "identified")
    listed = named.select("business_id", "cid", "arrival", F.explode("phones").alias("e164")).withColumn("p", parse_phone("e164", plan))
    seen = listed.select("e164", "p.national", "p.type", "p.area_code", "p.subscriber", is_synthetic(F.col("p.national")).alias("is_synthetic"))
    phones = cut(upsert.upsert_phones(tables["phones"], seen, as_of), "phones")
    ids = phones.select("e164", F.col("id").alias("phone_id"))
    arrived = listed.join(ids, "e164").select("business_id", "phone_id", F.lit("main").alias("label"), "arrival")
    out = dict(tables) | {"phones": phones, "business_phones": cut(upsert.link_phones(tables["business_phones"], arrived, as_of), "links")}
    out["businesses"] = cut(_businesses(tables["businesses"], upsert.fold_businesses(named.withColumn("county", F.lit(None).cast("string")).withColumn("description", F.lit(None).cast("string"))), as_of), "businesses")
    evidence = gated.where("fate in ('keep', 'evidence')").withColumn("e164", F.explode_outer("phones")).join(named.select("cid", "business_id"), "cid", "left").join(ids, "e164", "left")
    fp = business_fingerprint("name", "city", "website", F.get("phones", F.lit(0)))
    rows = evidence.select(
        observation_fingerprint("url", "e164", fp).alias("dedupe_hash"), "business_id", F.when(F.col("business_id").isNotNull(), F.col("phone_id")).alias("phone_id"), "source_id",
        F.col("kind").alias("evidence_kind"), "url", url_hash_key("url").alias("url_hash"), domain_of("url").alias("url_domain"), F.col("name").alias("page_title"), F.substring("text", 1, 300).alias("snippet"),
        F.when(F.col("fate") == "keep", F.col("hint")).otherwise(10).cast("int").alias("confidence_hint"), F.col("reliability").alias("source_reliability"), F.when(F.col("fate") == "keep", "OK").otherwise("UNKNOWN").alias("status"), as_of.alias("observed_at"),
    )
    rows = rows.withColumn("id", F.xxhash64("dedupe_hash"))
    shaped = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in tables["source_observations"].schema))
    out["source_observations"] = cut(upsert.insert_observations(tables["source_observations"], shaped, as_of), "observations")
    return Outcome(out, gated.groupBy("fate").agg(F.count("*").alias("n")))


def _businesses(old: DataFrame, folded: DataFrame, as_of: Column) -> DataFrame:
    new = folded.select(
        F.col("business_id").alias("id"), "name", name_key("name").alias("name_key"), "owner_name", "address", F.col("province").alias("province_name"), F.col("county").alias("county_name"),
        F.col("city").alias("city_name"), "website", "domain", "business_type", "categories", F.get("categories", F.lit(0)).alias("primary_category"), F.col("relevance").alias("relevance_score"), "field_status", "description", F.col("fp").alias("fingerprint"),
    )
    first = lambda c: F.coalesce(F.nullif(F.col(f"o_{c}"), F.lit("NOT_FOUND")), F.col(f"n_{c}"))
    rules = {c: first(c) for c in ("name", "name_key", "owner_name", "address", "province_name", "county_name", "city_name", "website", "domain", "business_type", "primary_category", "description")}
    rules |= {
        "fingerprint": F.coalesce("o_fingerprint", "n_fingerprint"), "categories": F.array_sort(F.array_distinct(F.concat(F.coalesce("o_categories", F.array().cast("array<string>")), F.coalesce("n_categories", F.array().cast("array<string>"))))),
        "relevance_score": F.greatest("o_relevance_score", "n_relevance_score"), "field_status": F.coalesce("o_field_status", "n_field_status"), "status": F.coalesce("o_status", F.lit("ACTIVE")),
        "is_synthetic": F.coalesce("o_is_synthetic", F.lit(False)), "confidence": F.coalesce("o_confidence", F.lit(0)), "confidence_band": F.coalesce("o_confidence_band", F.lit("INVALID")),
        "discovered_at": F.coalesce("o_discovered_at", as_of), "last_seen_at": F.when(F.col("__n"), as_of).otherwise(F.col("o_last_seen_at")), "created_at": F.coalesce("o_created_at", as_of), "updated_at": F.when(F.col("__n"), as_of).otherwise(F.col("o_updated_at")),
    }
    return upsert.keyed_upsert(old, new, ["id"], rules)


@dataclass
class Campaign:
    """What a round of a job leaves: the tables, the ledger of queries, what it asked for, the history of checked phones, what merged, and how much there was of what."""

    tables: dict[str, DataFrame]
    ledger: DataFrame
    asked: DataFrame
    history: DataFrame
    merged: DataFrame
    counts: DataFrame


def campaign(tables: dict[str, DataFrame], ledger: DataFrame, tasks: DataFrame, sources: DataFrame, answers: DataFrame, as_of: Column, lexicon: Lexicon = DEFAULT, plan: PhonePlan = PLAN, settings: Settings = Settings(), budget: int | None = None) -> Campaign:
    """One round: queries that the ledger admits are answered, their pages folded in, the ledger closed, pairs scored, and records that are one merged.

    answers: (source_key, query_text, page, url, html, source_id, reliability, city, province), what is stored for a query; a query without
    any has failed. A page that several queries lead to is folded once and counts for the first of them. Records that others merged into
    have their counts and score made anew of all evidence they have then. The next round, over what this one leaves, asks for the
    pages that are due then. counts: (what, n), see ``_counts``.
    """
    asked = cut(planner.admit(tasks, sources, ledger, as_of, settings.pages_most, settings.refresh_days, budget).select("query_text", "source_key", "query_hash", "page"), "asked")
    got = answers.join(asked, ["source_key", "query_text", "page"])
    first = F.min_by(F.struct("html", "source_id", "reliability", "city", "province", "query_hash", "source_key"), F.struct("source_key", "query_hash"))
    fetched = cut(got.groupBy("url").agg(first.alias("x")).select("url", "x.*").withColumn("arrival", F.xxhash64("url")), "fetched")
    outcome = run(tables, fetched.drop("query_hash", "source_key"), as_of, lexicon, plan, settings)
    out = outcome.tables
    fresh = out["businesses"].select(F.col("id").alias("business_id")).join(tables["businesses"].select(F.col("id").alias("business_id")), "business_id", "left_anti")
    led = fetched.select("url", "source_key", "query_hash").join(out["source_observations"].select("url", "business_id"), "url").join(fresh, "business_id", "left_semi")
    found = led.groupBy("source_key", "query_hash").agg(F.countDistinct("business_id").cast("int").alias("found"))
    seen = got.groupBy("source_key", "query_hash").agg(F.count("*").cast("int").alias("results"))
    runs = asked.select("source_key", "query_hash", "page").join(seen, ["source_key", "query_hash"], "left").join(found, ["source_key", "query_hash"], "left")
    runs = runs.withColumns({"outcome": F.when(F.col("results").isNull(), "FAILED").otherwise("DONE"), "found": F.coalesce("found", F.lit(0))})
    closed = cut(planner.finalise(ledger, runs, as_of, settings.refresh_days), "ledger")

    p = out["phones"].select(F.col("id").alias("phone_id"), "e164", "national", "is_synthetic")
    pairs = out["business_phones"].select("business_id", "phone_id", F.col("id").alias("link_id")).join(p, "phone_id")
    b = out["businesses"].where("status <> 'MERGED'").select(F.col("id").alias("business_id"), "name", "address", "website", "owner_name", "city_name", F.lit(None).cast("string").alias("area_code"), "business_type", "relevance_score")
    evaluated = cut(revalidate.evaluate_pairs(pairs, out["source_observations"], b, as_of, plan, settings).select("business_id", "phone_id", "link_id", "total", "band", "new_status"), "evaluated")
    phones, history = revalidate.apply_evaluations(out["phones"], evaluated, as_of, settings)
    out |= {"phones": cut(phones, "phones"), "businesses": cut(revalidate.recompute_businesses(out["businesses"], out["source_observations"], evaluated, settings), "businesses")}

    listed = out["business_phones"].join(p, "phone_id").groupBy(F.col("business_id").alias("id")).agg(F.array_sort(F.collect_set("e164")).alias("phones"))
    records = out["businesses"].where("status <> 'MERGED'").join(listed, "id", "left").select(
        "id", "name", F.col("city_name").alias("city"), "address", "domain", F.coalesce("phones", F.array().cast("array<string>")).alias("phones"), "confidence", dedup.completeness().alias("completeness")
    )
    records = cut(records, "records")
    merged = cut(dedup.duplicate_log(records, as_of, settings=settings), "merged")
    mapping = merged.select(F.col("merged_id").alias("id"), F.col("canonical_id").alias("canonical")).unionByName(merged.select(F.col("canonical_id").alias("id"), F.col("canonical_id").alias("canonical")).distinct())
    out = dedup.merge(out, mapping)
    out = {k: cut(v, k) if k in ("businesses", "business_phones", "source_observations") else v for k, v in out.items()}
    out["businesses"] = cut(recomputed(out, mapping, evaluated, settings), "businesses")
    return Campaign(out, closed, asked, cut(history, "history"), merged, cut(_counts(tables, out, asked, runs, fetched, outcome.fates, merged), "counts"))


def recomputed(tables: dict[str, DataFrame], mapping: DataFrame, evaluated: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The businesses after a merge by ``mapping(id, canonical)``: those that others merged into are counted and scored anew, over the pairs of all that are one now."""
    merged_into = mapping.where("id <> canonical").select(F.col("canonical").alias("id")).distinct()
    moved = dedup.remap(evaluated, mapping.where("id <> canonical"), "business_id")
    b = tables["businesses"]
    again = revalidate.recompute_businesses(b.join(merged_into, "id", "left_semi"), tables["source_observations"], moved, settings)
    return b.join(merged_into, "id", "left_anti").unionByName(again)


def _counts(before: dict[str, DataFrame], after: dict[str, DataFrame], asked: DataFrame, runs: DataFrame, fetched: DataFrame, fates: DataFrame, merged: DataFrame) -> DataFrame:
    """(what, n): queries asked and failed, pages, candidates by fate, new businesses, phones and observations, records merged."""
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    new = lambda name: count(after[name].select("id").join(before[name].select("id"), "id", "left_anti"), f"new {name}")
    parts = [
        count(asked, "asked"), count(runs.where("outcome = 'FAILED'"), "failed"), count(fetched, "pages"), fates.select(F.concat(F.lit("fate "), "fate").alias("what"), "n"), new("businesses"), new("phones"),
        new("source_observations"), count(merged, "merged"),
    ]
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Discovery:
    """A job of several rounds: what the last one leaves, the counts of each (round, what, n), the history and the merges of all."""

    last: Campaign
    counts: DataFrame
    history: DataFrame
    merged: DataFrame

    @property
    def totals(self) -> DataFrame:
        """(what, n) over all rounds."""
        return self.counts.groupBy("what").agg(F.sum("n").alias("n"))


def discover(tables: dict[str, DataFrame], ledger: DataFrame, tasks: DataFrame, sources: DataFrame, answers: DataFrame, as_of: Column, rounds: int, step: str = "1 HOUR", **more) -> Discovery:
    """Rounds of ``campaign``, each over what the one before left and ``step`` later, until one has nothing to ask for; ``more`` goes to each."""
    last, done = None, []
    for k in range(rounds):
        at = as_of + F.expr(f"INTERVAL {step}") * k
        now = campaign(tables if last is None else last.tables, ledger if last is None else last.ledger, tasks, sources, answers, at, **more)
        if last is not None and now.asked.isEmpty():
            break
        last = now
        done.append((k + 1, now))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return Discovery(last, union([c.counts.select(F.lit(k).alias("round"), "what", "n") for k, c in done]), union([c.history for _, c in done]), union([c.merged for _, c in done]))
