"""Operators that hold when one key has most rows, against plain loops: blocks, scans, robots rules, places, terms, keyed state."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarryline.functions import geo, relevance
from quarryline.functions.lexicon import DEFAULT
from quarryline.operators import dedup, scans
from quarryline.operators.joins import looked_up
from quarryline.sources import politeness
from quarryline.streaming import buckets, states

DAY = datetime(2024, 5, 1)


@pytest.mark.parametrize("n", [2, 399, 400, 401, 5000])
def test_blocks_of_any_size_give_all_pairs(spark, n):
    rows = spark.range(n).select("id", F.array(F.lit("one")).alias("keys")).union(spark.createDataFrame([(-1, ["alone"]), (-2, None), (-3, [])], "id long, keys array<string>"))
    pairs = dedup.candidate_pairs(rows, "keys")
    got = pairs.agg(F.count("*"), F.count_if(F.col("a") < F.col("b")), F.sum("a"), F.sum("b")).first()
    assert tuple(got) == (n * (n - 1) // 2, n * (n - 1) // 2, sum(a * (n - 1 - a) for a in range(n)), sum(b * b for b in range(n)))


def test_pairs_of_several_keys_come_once(spark):
    rnd = random.Random(3)
    keys = {k: [f"k{rnd.randrange(12)}" for _ in range(rnd.randint(0, 4))] + ([None] if k % 9 == 0 else []) for k in range(120)}
    frame = spark.createDataFrame(list(keys.items()), "id long, keys array<string>")
    want = sorted((a, b) for a in keys for b in keys if a < b and {*keys[a]} & {*keys[b]} - {None})
    assert sorted(map(tuple, dedup.candidate_pairs(frame, "keys", chunk=7).collect())) == want
    assert {r.key: r.n for r in dedup.block_sizes(frame, "keys").collect()} == {k: n for k in {x for v in keys.values() for x in v if x} if (n := sum(k in v for v in keys.values())) > 1}
    assert dedup.candidate_pairs(frame.limit(0), "keys").count() == 0


def test_names_over_the_old_bound_are_compared(spark):
    none = F.lit(None).cast("string")
    rows = spark.range(401).select("id", F.concat(F.lit("shop "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("name"), F.lit("town").alias("city"), none.alias("address"), none.alias("domain"), F.array(F.lit("+98")).alias("phones"))
    assert dedup.scored_pairs(rows).count() == 401 * 400 // 2


def test_what_is_compared_goes_along_with_a_chunk(spark):
    rows = spark.range(9).select("id", F.array(F.lit("k")).alias("keys"), F.concat(F.lit("t"), "id").alias("text"))
    got = dedup.candidate_pairs(rows, "keys", 4, ("text",)).collect()
    assert len(got) == 36 and all({r.x_text, r.y_text} == {f"t{r.a}", f"t{r.b}"} for r in got)


def test_copies_have_the_score_of_their_first(spark):
    none = F.lit(None).cast("string")
    rows = spark.range(6).select("id", F.when(F.col("id") < 4, "blue shop").otherwise("").alias("name"), F.lit("town").alias("city"), none.alias("address"), none.alias("domain"), F.array().cast("array<string>").alias("phones"))
    got = {(r.a, r.b): (r.score, r.verdict, r.reasons) for r in dedup.scored_pairs(rows).collect()}
    assert got == {(0, k): (0.88, "merge", ["equal name", "equal core"]) for k in (1, 2, 3)} | {(4, 5): (0.2, None, ["no anchor"])}


@pytest.fixture(scope="module")
def log():
    rnd = random.Random(11)
    hot = [("hot", DAY + timedelta(seconds=rnd.randrange(4000)), k, rnd.random() < 0.8) for k in range(900)]
    return hot + [(rnd.choice(["a", "b", None, "c"]), DAY + timedelta(seconds=rnd.randrange(4000)), k, rnd.random() < 0.6) for k in range(900, 1200)]


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def frame_of(spark, log):
    return spark.createDataFrame(log, "d string, at timestamp, k long, failed boolean").repartition(7)


def test_numbers_and_streaks(spark, log):
    frame = frame_of(spark, log)
    numbers = {r.k: r.n for r in scans.numbered(frame, "d", ["at", "k"], "n").collect()}
    streaks = {r.k: r.streak for r in scans.streaks(frame, "d", ["at", "k"], F.col("failed")).collect()}
    for rows in by_key(log).values():
        run = 0
        for n, r in enumerate(rows, 1):
            run = run + 1 if r[3] else 0
            assert (numbers[r[2]], streaks[r[2]]) == (n, run)
    assert len(numbers) == len(streaks) == len(log) and scans.numbered(frame.limit(0), "d", ["at"]).count() == 0


def test_blocks_spread_a_hot_key(spark, log):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few rows would be one partition
    try:
        spread = scans.in_blocks(frame_of(spark, log), "d", ["at", "k"]).where("d = 'hot'").groupBy("__block").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) >= 3 and max(r["count"] for r in spread) < 600


def test_pace_is_one_after_the_other(spark, log):
    own = spark.createDataFrame([("hot", 0.5), ("a", 0.01)], "domain string, rate double")
    got = {r.k: r.goes_at for r in politeness.paced_fetches(frame_of(spark, log), "d", "at", ["k"], own, default=2.0).collect()}
    for key, rows in by_key(log).items():
        gap, free = timedelta(seconds=1 / max({"hot": 0.5, "a": 0.01}.get(key, 2.0), 0.05)), None
        for r in rows:
            at = r[1] if free is None else max(r[1], free)
            assert got[r[2]] == at
            free = at + gap
    assert len(got) == len(log)


def test_lookup_with_heavy_and_light_keys(spark):
    rows = spark.createDataFrame([(k, 0 if k < 50 else k % 7 + 1) for k in range(90)], "id long, key long")
    counts = rows.groupBy("key").count().selectExpr("key", "key * 10 as tenfold", "count as n")
    for most in (1, 3, 1000):
        assert sorted((r.id, r.tenfold) for r in looked_up(rows, counts, "key", "n", most).collect()) == sorted((r.id, r.key * 10) for r in rows.collect())


ROBOTS = [
    ("User-agent: *\nUser-agent: other\nDisallow: /x\n", {"/x": False, "/x/1": False, "/y": True}),
    ("User-agent: other\nUser-agent: *\n\nDisallow: /x", {"/x": False}),
    ("User-agent: other\nDisallow: /\n", {"/x": True}),
    ("User-agent: Quarryline/2.1\nDisallow: /own\nUser-agent: *\nDisallow: /x", {"/own": False, "/x": True}),
    ("Disallow: /x\nUser-agent: *\nDisallow: /y # why\nAllow: /y/open\nDisallow:\n", {"/x": True, "/y/z": False, "/y/open/1": True}),
    ("User-agent: *\nDisallow: /*.pdf$\nDisallow: /a*b/c\nAllow: /a1b/c\n", {"/p/q.pdf": False, "/p.pdf?x": True, "/axxb/cd": False, "/a1b/c": True, "/ab": True}),
    ("User-agent: *\r\nDisallow: /\r\nAllow: /$\r\nUser-agent: *\r\nAllow: /also", {"/": True, "/z": False, "/also/1": True}),
    ("User-agent: *\nDisallow: /a.b(c\nAllow: /same\nDisallow: /same", {"/a.b(c": False, "/aXb(c": True, "/same": True}),
    ("", {"/x": True}),
    (None, {"/x": True}),
]


def test_robots(spark):
    files = spark.createDataFrame([(f"h{k}.ir", body) for k, (body, _) in enumerate(ROBOTS)], "domain string, body string")
    asked = [(f"http://www.h{k}.ir:8080{path}#top", want) for k, (_, found) in enumerate(ROBOTS) for path, want in found.items()]
    asked += [("http://h1.ir", True), ("http://nowhere.ir/x", True), (None, True), ("http://h6.ir?q=1", False)]
    fetches = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(asked)], "id long, url string")
    got = {r.id: r.allowed for r in politeness.allowed(fetches, politeness.robots_rules(files)).collect()}
    assert [(asked[k][0], got[k]) for k in range(len(asked))] == asked
    plan = politeness.allowed(fetches, politeness.robots_rules(files))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


PLACES = [("city", "ری", "ری", "تهران"), ("city", "تهران", "تهران", "تهران"), ("county", "ری", "ری", "تهران"), ("city", "بندر گز", "گز", "گلستان"), ("city", "بندر", "بندر", "هرمزگان"), ("province", "اصفهان", None, "اصفهان"), ("city", "اصفهان", "اصفهان", "اصفهان"),
          ("city", "نور", "نور", "مازندران"), ("province", "قم", None, "قم"), ("city", "قم", "قم", "قم")]


@pytest.mark.parametrize("marker", ["استان", "شهرستان", "شهر", "بخش", "دهستان", "واقع در", "واقع در استان"])
def test_every_marker_counts(marker):
    g = geo.Gazetteer(PLACES)
    assert [p[1] for p, _, _ in g.matches(f"{marker} نور")] == ["نور"] and g.matches("چراغ نور") == [] and g.matches("منطقه نور") == []
    assert g.locate(f"فروشگاه {marker} اصفهان")[3] == 70 and g.locate("فروشگاه منطقه اصفهان")[3] == 55


def test_places_joined_are_places_located(spark):
    rnd = random.Random(6)
    words = ["شهر", "شهرستان", "بخش", "ری", "نور", "قم", "تهران", "بندر", "گز", "بندرگز", "اصفهان", "فروشگاه", "بزرگ،", "(تهران)", "واقع", "در", "x", "خیابان", "استان", "قم‌", "تهران-نور", "اصفـهان"]
    texts = [None, "", "   "] + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    rows = [(k, t, rnd.choice([None, "ری", "تهران", "نیست"]), rnd.choice([None, "گلستان", "تهران"])) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id long, t string, hc string, hp string").repartition(4)
    places = spark.createDataFrame(PLACES, "kind string, name string, county string, province string")
    g = geo.load(places)
    got = {r.id: (r.province, r.county, r.city, r.confidence) for r in geo.located(frame, places, "id", "t", "hc", "hp").collect()}
    assert len(got) == len(rows) and {k: got[k] for k, *_ in rows} == {k: g.locate(t or "", hc, hp) for k, t, hc, hp in rows}
    found = {r.id: [(p.kind, p.name, p.a, p.b) for p in r.found] for r in geo.places_in_texts(frame, places, "id", "t").collect()}
    assert found == {k: m for k, t, *_ in rows if (m := [(p[0], p[1], a, b) for p, a, b in g.matches(t or "")])}
    assert geo.located(frame, places.limit(0), "id", "t").where("confidence = 15 and city is null").count() == len(rows)


def test_terms_found_by_lookup_are_those_found_by_pattern(spark):
    groups = [*DEFAULT.categories.values(), *DEFAULT.roles.values(), DEFAULT.negatives, DEFAULT.signals, DEFAULT.spam]
    terms = tuple(dict.fromkeys(t for g in groups for t, _ in g)) + ("Hot gear", "gear", "hotgear", "a.b", "c+ d")
    rnd = random.Random(2)
    parts = [p for t in terms for p in t.split()] + ["word", "x-y", "HOT_GEAR", "hot-gear", "(gear)", "gear.", "gears", "a.b", "c+d", "_gear", "gear_"]
    joins = [" ", "  ", "-", ", ", "", "_"]
    texts = ["", None] + ["".join(x for _ in range(rnd.randint(1, 25)) for x in (rnd.choice(parts), rnd.choice(joins))) for _ in range(250)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string")
    got = {r.id: set(r.found) for r in frame.select("id", relevance.found_terms(F.coalesce("t", F.lit("")), terms).alias("found")).collect()}
    for k, t in enumerate(texts):
        want = set()
        for term in terms:
            pattern = r"(?<!\w)" + r"[\s\-_‌]*".join(map(re.escape, term.replace("‌", " ").split())) + r"(?!\w)"
            if re.search(pattern, t or "", re.I):
                want.add(term)
        assert got[k] == want, t


def plain_queue(rows, lease, most, base, longest, end):
    out = {}
    for key, found in by_key(rows).items():
        s = {"state": "", "n": 0, "until": 0, "turns": 0}
        for _, at, _, command in [*found, (key, end, 10**9, "end")]:
            if s["state"] == "LEASED" and (s["until"] <= at if command != "end" else s["until"] < at):
                s.update(state="QUEUED", turns=s["turns"] + 1)
            hit = True
            if command == "enqueue" and s["state"] in ("", "DEAD"):
                s.update(state="QUEUED", until=at)
            elif command == "lease" and s["state"] == "QUEUED" and s["until"] <= at:
                s.update(state="LEASED", until=at + lease, n=s["n"] + 1)
            elif command == "heartbeat" and s["state"] == "LEASED":
                s.update(until=at + lease)
            elif command == "complete" and s["state"] == "LEASED":
                s.update(state="DONE", until=at)
            elif command == "fail" and s["state"] == "LEASED":
                s.update(**({"state": "DEAD", "until": at} if s["n"] >= most else {"state": "QUEUED", "until": at + min(base * 2 ** (s["n"] - 1), longest)}))
            else:
                hit = False
            s["turns"] += hit
        if s["turns"]:
            out[key] = (s["state"], s["n"], s["until"], s["turns"])
    return out


def test_leases_survive_a_failed_batch(spark, tmp_path):
    rnd = random.Random(4)
    start = int(DAY.timestamp() * 1000)
    rows = sorted(((f"i{rnd.randrange(12)}", start + 1000 * rnd.randrange(40_000), k, rnd.choice(states.COMMANDS)) for k in range(500)), key=lambda r: r[1])
    for n in range(3):
        part = [(i, k, c, datetime.fromtimestamp(at / 1000)) for i, at, k, c in rows[n * 200 : (n + 1) * 200]]
        spark.createDataFrame(part, "item string, id long, command string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    failed = []

    def keep(batch, turn):
        if turn == 1 and not failed:
            failed.append(turn)
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{turn}")

    def run():
        stream = states.with_state_store(spark).readStream.schema("item string, id long, command string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = states.leases(stream, lease_seconds=2000, most_attempts=2, base_seconds=300, most_seconds=400)
        out.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    try:
        with pytest.raises(Exception, match="lost"):
            run()
        run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    changes = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out")
    got = {r["item"]: (r.x.state, r.x.attempts, r.x.until, r.n) for r in changes.groupBy("item").agg(F.max_by(F.struct("state", "attempts", "until"), "turn").alias("x"), F.count("*").alias("n")).collect()}
    assert got == plain_queue(rows, 2_000_000, 2, 300_000, 400_000, max(r[1] for r in rows))
    assert changes.groupBy("item", "turn").count().where("count > 1").count() == 0


def test_upserts_rewrite_only_what_they_touch(spark, tmp_path):
    t = buckets.Buckets(spark, str(tmp_path / "t"), "id long, v string", "id", 8)
    frame = lambda rows: spark.createDataFrame(rows, "id long, v string")
    merge = lambda old, new: old.join(new.select("id"), "id", "left_anti").unionByName(new).where("v <> 'gone'")
    assert t.read().count() == 0 and t.upsert(frame([]), merge, 0) == 0
    assert t.upsert(frame([(k, "a") for k in range(100)]), merge, 1) == 8
    first = t.manifest()
    assert t.upsert(frame([(7, "b"), (200, "c")]), merge, 2) in (1, 2)
    changed = [b for b, x in t.manifest().items() if first.get(b) != x and b >= 0]
    assert 1 <= len(changed) <= 2
    want = {k: "a" for k in range(100)} | {7: "b", 200: "c"}
    assert {r.id: r.v for r in t.read().collect()} == want and t.read().count() == 101
    assert t.upsert(frame([(7, "again")]), merge, 2) == 0 and {r.id: r.v for r in t.read().collect()} == want

    def broken(old, new):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        t.upsert(frame([(8, "x")]), broken, 3)
    assert {r.id: r.v for r in t.read().collect()} == want
    assert t.upsert(frame([(k, "gone") for k in want]), merge, 3) == 8 and t.read().count() == 0
    assert t.vacuum(1) > 0 and t.read().count() == 0 and t.upsert(frame([(1, "z")]), merge, 4) == 1 and t.read().count() == 1
