"""Operators: dedup and components against union-find, upserts that are idempotent, planner, queue, exports, streams."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarryline import schemas
from quarryline.operators import catalog, dedup, revalidate, stats, upsert
from quarryline.operators.components import components
from quarryline.plans import jobs, planner, queue
from quarryline.sources import export, politeness, search
from quarryline.streaming import ingest

DAY = datetime(2026, 1, 1)


def find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)]
    want = find([e for e in edges if e[0] != e[1]])
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def business(k, **more):
    base = {f.name: None for f in schemas_fields("businesses")}
    return base | {"id": k, "name": f"b{k}", "status": "ACTIVE", "confidence": 50, "is_synthetic": False, "categories": [], "social_links": [], "field_status": {}, "relevance_score": 40} | more


def schemas_fields(name):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schemas.TABLES[name]).fields


def frame(spark, name, rows):
    names = [f.name for f in schemas_fields(name)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.TABLES[name])


def tables(spark):
    t = {name: schemas.empty(spark, name) for name in schemas.TABLES}
    t["businesses"] = frame(spark, "businesses", [business(1, name="آلفا", confidence=80, city_name="تهران"), business(2, name="بتا", confidence=60), business(3, status="MERGED"), business(4, is_synthetic=True)])
    t["phones"] = frame(spark, "phones", [{"id": 10, "e164": "+982133334455", "national": "02133334455", "type": "LANDLINE", "status": "VALID", "confidence": 70}, {"id": 11, "e164": "+989121234567", "national": "09121234567", "type": "MOBILE", "status": "UNVERIFIED", "confidence": 10, "next_check_at": DAY + timedelta(days=9)}])
    t["business_phones"] = frame(spark, "business_phones", [{"id": 1, "business_id": 1, "phone_id": 10, "is_primary": True, "confidence": 70}, {"id": 2, "business_id": 1, "phone_id": 11, "is_primary": False, "confidence": 10}])
    t["sources"] = frame(spark, "sources", [{"id": 5, "key": "DIR", "kind": "DIRECTORY", "reliability": 0.8}])
    t["source_observations"] = frame(spark, "source_observations", [{"id": k, "dedupe_hash": str(k), "business_id": 1, "phone_id": 10, "source_id": 5, "url": f"http://a{k}.ir/x", "url_domain": f"a{k}.ir", "source_reliability": 0.8, "status": "OK", "observed_at": DAY} for k in range(3)])
    return t


def test_filters_and_details(spark):
    t = tables(spark)
    ids = lambda **f: sorted(r.id for r in catalog.businesses(t, catalog.BusinessFilter(**f)).collect())
    assert ids() == [1, 2] and ids(include_synthetic=True) == [1, 2, 4] and ids(statuses=("MERGED",)) == [3]
    assert ids(has_phone=True) == [1] and ids(has_phone=False) == [2] and ids(phone_statuses=("VALID",)) == [1] and ids(source_key="DIR") == [1] and ids(source_key="NO") == []
    assert ids(min_confidence=61) == [1] and ids(search="بت") == [2]
    d = {r.id: r for r in catalog.details(t).collect()}
    assert [p.e164 for p in d[1].phones] == ["+982133334455", "+989121234567"] and len(d[1].evidence) == 3 and d[2].phones == []
    assert sorted(r.id for r in catalog.without_evidence(t).collect()) == [2, 3, 4]


def test_export(spark, tmp_path):
    got = {r.id: r for r in export.rows(tables(spark), catalog.BusinessFilter(limit=5)).collect()}
    assert tuple(next(iter(got.values())).asDict()) == export.COLUMNS and len(export.COLUMNS) == 37
    assert got[1].primary_phone == "+982133334455" and got[1].source_keys == "DIR" and got[2].primary_phone == "NOT_FOUND" and got[1].evidence_urls.count("|") == 2
    export.write_csv(export.rows(tables(spark), catalog.BusinessFilter()), str(tmp_path / "c"))
    export.write_json(export.evidence_rows(tables(spark), catalog.BusinessFilter()), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert export.record(spark, schemas.empty(spark, "export_records"), "p", "csv", catalog.BusinessFilter(), 2, F.lit(DAY)).count() == 1


def test_merge_keeps_evidence(spark):
    t = tables(spark)
    mapping = spark.createDataFrame([(1, 1), (2, 1)], "id long, canonical long")
    out = dedup.merge(t, mapping)
    b = {r.id: r for r in out["businesses"].collect()}
    assert b[2].status == "MERGED" and b[2].merged_into == 1 and b[1].status == "ACTIVE"
    assert out["source_observations"].where("business_id = 1").count() == 3 and out["business_phones"].count() == 2


def test_clusters(spark):
    rows = [(1, "پخش بهرامی", "تهران", None, "shop.ir", ["+981"], 50, 2), (2, "پخش بهرامى", "تهران", None, "shop.ir", ["+982"], 70, 3), (3, "پخش کریمی", "تهران", None, None, [], 10, 1)]
    df = spark.createDataFrame(rows, "id long, name string, city string, address string, domain string, phones array<string>, confidence int, completeness int")
    merged, review = dedup.clusters(df)
    assert {(r.id, r.canonical) for r in merged.collect()} == {(1, 2), (2, 2)} and review.count() == 0


def test_upserts_are_idempotent(spark):
    t, now = tables(spark), F.lit(DAY)
    seen = spark.createDataFrame([("+982133334455", "02133334455", "LANDLINE", "021", "33334455", False), ("+982199999999", "02199999999", "LANDLINE", "021", "99999999", False)], "e164 string, national string, type string, area_code string, subscriber string, is_synthetic boolean")
    once = upsert.upsert_phones(t["phones"], seen, now)
    twice = upsert.upsert_phones(once, seen, now)
    key = lambda df: sorted((r.e164, r.status, r.type) for r in df.collect())
    assert key(once) == key(twice) and once.count() == 3
    links = spark.createDataFrame([(2, 10, "x", 1), (2, 11, "y", 2)], "business_id long, phone_id long, label string, arrival long")
    a = upsert.link_phones(t["business_phones"], links, now)
    assert a.count() == 4 and upsert.link_phones(a, links, now).count() == 4 and a.where("business_id = 2 and is_primary").count() == 1
    obs = t["source_observations"].limit(2)
    assert upsert.insert_observations(t["source_observations"], obs, now).count() == 3


def test_identify(spark):
    known = spark.createDataFrame([(7, "b:none", "آلفا", "تهران")], "id long, fingerprint string, name string, city string")
    listed = spark.createDataFrame([(7, "+981")], "id long, e164 string")
    rows = [(1, 1, "آلفا", "شیراز", None, ["+981"]), (2, 2, "بتا گستر", "قم", None, ["+985"]), (3, 3, "بتا", "قم", None, ["+985"]), (4, 4, "گاما", "قم", None, ["+986"])]
    got = {r.cid: r.business_id for r in upsert.identify(spark.createDataFrame(rows, "cid long, arrival long, name string, city string, domain string, phones array<string>"), known, listed).collect()}
    assert got[1] == 7 and got[2] == got[3] and len({got[2], got[4], 7}) == 3


def test_revalidation(spark):
    t, now = tables(spark), F.lit(DAY + timedelta(days=1))
    assert [r.id for r in revalidate.due_phones(t["phones"], now).collect()] == [10]
    pairs = t["business_phones"].select("business_id", "phone_id", F.col("id").alias("link_id")).join(t["phones"].select(F.col("id").alias("phone_id"), "e164", "national", "is_synthetic"), "phone_id")
    b = t["businesses"].select(F.col("id").alias("business_id"), "name", "address", "website", "owner_name", "city_name", F.lit("021").alias("area_code"), "business_type", "relevance_score")
    scored = revalidate.evaluate_pairs(pairs, t["source_observations"], b, now)
    after, history = revalidate.apply_evaluations(t["phones"], scored, now)
    assert after.count() == 2 and history.count() == 2 and after.where("next_check_at is null").count() == 0
    assert revalidate.transitions(history).first().checked == 2
    assert revalidate.recompute_businesses(t["businesses"], t["source_observations"], scored).count() == 4


def test_ledger(spark):
    tasks = spark.createDataFrame([("q1", 0), ("q2", 1), ("q3", 2)], "query_text string, ordinal int")
    sources = spark.createDataFrame([("A", 1)], "source_key string, turn int")
    empty = spark.createDataFrame([], "source_key string, query_hash string, state string, depth int, run_count int, new_results long, last_run_at timestamp, next_run_at timestamp, failures int, results_seen long")
    first = planner.admit(tasks, sources, empty, F.lit(DAY), budget=2)
    assert [(r.query_text, r.page, r.why) for r in first.collect()] == [("q1", 1, "new"), ("q2", 1, "new")]
    runs = first.select("source_key", "query_hash", "page", F.when(F.col("query_text") == "q1", "DONE").otherwise("FAILED").alias("outcome"), F.lit(4).cast("long").alias("results"), F.lit(3).cast("long").alias("found"))
    ledger = planner.finalise(empty, runs, F.lit(DAY))
    again = planner.admit(tasks, sources, ledger, F.lit(DAY))
    assert sorted((r.query_text, r.page, r.why) for r in again.collect()) == [("q1", 2, "deeper"), ("q3", 1, "new")]
    later = planner.admit(tasks, sources, ledger, F.lit(DAY + timedelta(hours=7)))
    assert "q2" in {r.query_text for r in later.collect()}


def test_queue(spark):
    items = schemas.empty(spark, "queue_items")
    arrived = spark.createDataFrame([("a", "run", "{}", 2), ("b", "run", "{}", 1), ("a", "run", "{}", 2)], "dedupe_key string, kind string, payload string, priority int")
    q = queue.enqueue(items, arrived, F.lit(DAY))
    assert q.count() == 2 and queue.enqueue(q, arrived, F.lit(DAY)).count() == 2
    taken, q = queue.claim(q, 1, F.lit(DAY))
    assert [r.dedupe_key for r in taken.collect()] == ["b"]
    q = queue.settle(q, q.where("state = 'LEASED'").select("id", F.lit(False).alias("ok"), F.lit("no").alias("message")), F.lit(DAY))
    row = q.where("dedupe_key = 'b'").first()
    assert row.state == "QUEUED" and row.available_at == DAY + timedelta(seconds=30) and row.attempts == 1
    assert queue.release(q, F.lit(DAY)).count() == 2 and queue.purge_done(q, F.lit(DAY)).count() == 2 and queue.dead_letters(q).count() == 0


def test_politeness(spark):
    files = spark.createDataFrame([("a.ir", "User-agent: *\nDisallow: /x\nAllow: /x/y\nCrawl-delay: 2")], "domain string, body string")
    urls = spark.createDataFrame([(1, "http://a.ir/x/1"), (2, "http://www.a.ir/x/y/2"), (3, "http://b.ir/x")], "id int, url string")
    assert [r.allowed for r in politeness.allowed(urls, politeness.robots_rules(files)).orderBy("id").collect()] == [False, True, True]
    log = spark.createDataFrame([("a", k, DAY + timedelta(seconds=k), k != 2) for k in range(8)], "d string, k int, at timestamp, failed boolean")
    assert politeness.blocked(log, "d", "at", ["k"], "failed", F.lit(DAY)).count() == 1
    cache = schemas.empty(spark, "http_cache")
    cache = politeness.cache_write(cache, spark.createDataFrame([("http://a", 200, "text/html", b"x")], "url string, status int, content_type string, body binary"), F.lit(DAY))
    assert [r.ok for r in politeness.cache_read(spark.createDataFrame([("HTTP://a",), ("http://b",)], "url string"), cache, F.lit(DAY)).orderBy("url").collect()] == [True, False]


def test_search_sources(spark):
    body = json.dumps({"items": [{"link": "http://a", "title": "A", "snippet": "s"}, {"link": "http://b", "title": "B"}]})
    got = search.api_items(spark.createDataFrame([("q", body), ("z", "nope")], "q string, body string"), "GOOGLE_CSE").collect()
    assert [(r.rank, r.url) for r in got] == [(1, "http://a"), (2, "http://b")]
    page = '<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.ir%2F">A &amp; B</a><div class="result__snippet">text</div></div>'
    item = spark.createDataFrame([(page,)], "b string").select(F.explode(search.html_items("b", "DUCKDUCKGO")).alias("i")).select("i.*", search.unwrapped(F.col("i.url")).alias("to")).first()
    assert (item.title, item.snippet, item.to) == ("A & B", "text", "https://a.ir/")
    osm = json.dumps({"elements": [{"id": 1, "type": "node", "tags": {"name": "N", "phone": "021"}}, {"id": 2, "type": "node", "tags": {"name": "M"}}]})
    assert [r.name for r in search.overpass_items(spark.createDataFrame([(osm,)], "body string")).collect()] == ["N"]
    assert search.resolve(search.registry(spark), keys=("SERPAPI",)).where("key = 'SERPAPI'").count() == 1


def test_jobs_and_stats(spark):
    j = jobs.created(schemas.empty(spark, "search_jobs"), "discover", "{}", 10, F.lit(DAY))
    j = j.withColumns({"status": F.lit("RUNNING"), "heartbeat_at": F.lit(DAY)})
    failed, events = jobs.stale(j, F.lit(DAY + timedelta(hours=1)))
    assert failed.first().status == "FAILED" and events.count() == 1
    d = stats.dashboard(tables(spark)["businesses"], tables(spark)["phones"], F.lit(DAY)).first()
    assert (d.businesses_total, d.active, d.phones_total, d.phones_due) == (3, 3, 2, 1)


def test_streaming_fold(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "id long, v string").coalesce(1).write.parquet(str(src))
    stream = lambda: spark.readStream.schema("id long, v string").parquet(str(src))
    snap = ingest.Snapshots(spark, str(tmp_path / "snap"), "id long, v string")
    merge = lambda old, new: old.unionByName(new).dropDuplicates(["id"])
    ingest.fold(stream(), snap, merge, str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([(3, "c")], "id long, v string").write.mode("append").parquet(str(src))
    ingest.fold(stream(), snap, merge, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in snap.read().collect()) == [1, 2, 3] and ingest.Snapshots(spark, str(tmp_path / "snap"), "id long, v string").version == snap.version


def test_discovery_run_is_idempotent(spark):
    from quarryline.plans import discovery

    entry = '<div class="biz-item"><h3>پخش شوینده {0}</h3><p>فروش عمده مواد شوینده و مایع ظرفشویی تلفن: 021-3333445{1} همراه: 0912123456{1}</p></div>'
    html = "<html><body>" + entry.format("بهرامی", 1) + entry.format("کریمی", 2) + "</body></html>"
    job = "<html><body><h1>خبر</h1><p>استخدام فوری رزومه 021-33334459</p></body></html>"
    rows = [("http://a.ir/1", html, 5, 0.8, "تهران", "تهران", 1), ("http://a.ir/2", job, 5, 0.8, "تهران", "تهران", 2)]
    fetched = spark.createDataFrame(rows, "url string, html string, source_id long, reliability double, city string, province string, arrival long")
    t = {name: schemas.empty(spark, name) for name in schemas.TABLES}
    first = discovery.run(t, fetched, F.lit(DAY))
    count = lambda x: tuple(x[k].count() for k in ("businesses", "phones", "business_phones", "source_observations"))
    assert count(first.tables) == (2, 4, 4, 5) and {r.fate: r.n for r in first.fates.collect()} == {"keep": 2, "evidence": 1}
    again = discovery.run(first.tables, fetched, F.lit(DAY + timedelta(days=1)))
    assert count(again.tables) == (2, 4, 4, 5) and catalog.without_evidence(again.tables).count() == 0


def test_campaign_asks_folds_scores_and_merges(spark):
    from quarryline.plans import discovery

    entry = '<div class="biz-item"><h3>پخش شوینده {0}</h3><p>فروش عمده مواد شوینده و مایع ظرفشویی تلفن: 021-3333445{1} همراه: 0912123456{1}</p></div>'
    one, two = ("<html><body>" + "".join(entry.format(*x) for x in xs) + "</body></html>" for xs in ([("بهرامی", 1), ("کریمی", 2)], [("بهرامی", 1), ("نوری", 3)]))
    answers = spark.createDataFrame(
        [("A", "q1", 1, "http://a.ir/1", one, 5, 0.8, "تهران", "تهران"), ("A", "q1", 2, "http://b.ir/2", two, 6, 0.7, "تهران", "تهران")],
        "source_key string, query_text string, page int, url string, html string, source_id long, reliability double, city string, province string",
    )
    tasks = spark.createDataFrame([("q1", 1), ("q2", 2)], "query_text string, ordinal long")
    sources = spark.createDataFrame([("A", 1)], "source_key string, turn int")
    ledger = spark.createDataFrame([], "source_key string, query_hash string, state string, depth int, run_count int, new_results int, failures int, results_seen int, last_run_at timestamp, next_run_at timestamp")
    t = {name: schemas.empty(spark, name) for name in schemas.TABLES}
    first = discovery.campaign(t, ledger, tasks, sources, answers, F.lit(DAY))
    assert sorted((r.query_text, r.page) for r in first.asked.collect()) == [("q1", 1), ("q2", 1)]
    states = {r.state: r for r in first.ledger.collect()}
    assert set(states) == {"DONE", "COOLING"} and states["DONE"].new_results == 2 and states["COOLING"].failures == 1
    active = first.tables["businesses"].where("status <> 'MERGED'")
    assert first.history.count() == 4 and active.count() + first.merged.count() == 2 and active.where("confidence > 0 and source_count = 1").count() == active.count()
    again = discovery.campaign(first.tables, first.ledger, tasks, sources, answers, F.lit(DAY + timedelta(hours=1)))
    assert [(r.query_text, r.page) for r in again.asked.collect()] == [("q1", 2)]
    names = {r.name: r.status for r in again.tables["businesses"].collect()}
    assert len(names) == 3 and again.ledger.where("state = 'DONE' and depth = 2 and new_results = 1").count() == 1
    assert again.tables["businesses"].where("source_count = 2").count() == 1  # seen on both pages


def test_lists_and_html_phones(spark):
    from quarryline.functions.phones import find_phones_in_html

    t = tables(spark)
    assert [r.id for r in catalog.phones_list(t["phones"].fillna(False, ["is_synthetic"]), kind="MOBILE").collect()] == [11]
    page = '<a href="tel:+982133334455">x</a><a href="https://wa.me/989121234567">w</a> tel 021-33334455 tel 021-44445566'
    got = {r.e164: r.kind for r in find_phones_in_html(spark.createDataFrame([(1, page)], "id int, h string"), "h", "id").collect()}
    assert got == {"+982133334455": "tel_link", "+989121234567": "whatsapp", "+982144445566": "text"}


def test_requests_labels_and_events(spark):
    f = catalog.BusinessFilter.requested(bands="high", types=["maker"], provinces="Qom", limit=5000)
    assert (f.bands, f.types, f.provinces, f.limit) == (("HIGH",), ("MAKER",), ("Qom",), 5000) and catalog.BusinessFilter.requested().limit == 50
    for odd in ({"limit": 5001}, {"offset": -1}, {"nope": 1}):
        with pytest.raises(ValueError):
            catalog.BusinessFilter.requested(**odd)
    events = spark.createDataFrame([], "id bigint, job_id bigint, level string, event string, message string, data string, created_at timestamp")
    row = jobs.event(events, 3, "INFO", "PLAN_READY", "x" * 900, F.lit(DAY)).first()
    assert (row.job_id, row.event, len(row.message)) == (3, "PLAN_READY", 800)
    tasks = spark.createDataFrame([(f"q{k}", k) for k in range(50)], "query_text string, ordinal long")
    order = lambda seed: [r.query_text for r in planner.shuffled(tasks, seed).orderBy("ordinal").collect()]
    assert order(1) == order(1) != order(2) and sorted(order(1)) == sorted(f"q{k}" for k in range(50))
