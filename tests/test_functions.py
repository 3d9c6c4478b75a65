"""Functions against hand-written cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarryline.functions import confidence, fingerprint, geo, pages, phones, relevance, similarity, text, urls
from quarryline.functions.lexicon import DEFAULT


def one(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select(*(c.alias(n) for n, c in columns.items())).collect()


@pytest.mark.parametrize(
    "raw,e164,kind,valid",
    [
        ("021-33334455", "+982133334455", "LANDLINE", True), ("054-3720001", "+98543720001", "LANDLINE", True), ("+98 912 345 6789", "+989123456789", "MOBILE", True),
        ("۰۹۱۲۳۴۵۶۷۸۹", "+989123456789", "MOBILE", True), ("00989123456789", "+989123456789", "MOBILE", True), ("09521234567", "+989521234567", "MOBILE", False),
        ("110", "110", "SERVICE", False), ("33334455", "", "LANDLINE", False), ("1234567890123", "", "UNKNOWN", False),
    ],
)
def test_parse_phone(spark, raw, e164, kind, valid):
    p = one(spark, [(raw,)], "raw string", p=phones.parse_phone("raw"))[0].p
    assert (p.e164, p.type, p.valid) == (e164, kind, valid)


def test_parse_is_total_and_rejects(spark):
    rows = [(x,) for x in (None, "", "abc", "+", "0000000000", "1111111111", "12-34")]
    got = one(spark, rows, "raw string", p=phones.parse_phone("raw"), q=phones.phone_quality(phones.parse_phone("raw")))
    assert [r.p is None for r in got][:4] == [True] * 4
    assert all(r.q < 0.5 for r in got)


def test_resolve_local(spark):
    rows = [("3720001", "054"), ("37200012", "054"), ("3720001", "999"), ("372", "054")]
    got = one(spark, rows, "d string, a string", r=phones.resolve_local("d", "a"))
    assert [r.r.e164 if r.r else None for r in got] == ["+98543720001", "+985437200012", None, None]


def test_find_phones(spark):
    rows = [
        (1, "تماس: 09120000000 09120000001", None), (2, "تلفن 021 3333 4455", None), (3, "کد پستی 1234567890", None), (4, "33334455", "021"), (5, "33334455", None),
        (6, "2133334455", None), (7, "tel 2133334455", None), (8, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, t string, area string")
    got = phones.find_phones(df, "t", "id", "area").collect()
    kept = sorted((r.id, r.e164) for r in got if r.reason is None)
    assert kept == [(1, "+989120000000"), (1, "+989120000001"), (2, "+982133334455"), (4, "+982133334455"), (7, "+982133334455")]
    assert {r.id: r.reason for r in got if r.reason} == {3: "label", 5: "local without area", 6: "bare ten digits"}


def test_text(spark):
    r = one(spark, [("  شركت  پخش‌ي آبی۱۲  ",)], "s string", n=text.normalize_fa("s"), k=text.name_key("s"), d=text.digits_only("s"), t=text.truncate("s", 5))[0]
    assert r.n == "شرکت پخش‌ی آبی12" and r.d == "12" and len(r.t) == 5 and r.t.endswith("…")
    r = one(spark, [("آبی گستر شرکت", None)], "s string, x string", k=text.name_key("s"), e=text.name_key("x"), w=text.collapse_ws("x"))[0]
    assert r.k == "آبیگستر" and r.e == "" and r.w == ""


def test_normalisers_are_idempotent(spark):
    rnd = random.Random(5)
    rows = [("".join(rnd.choice("يكةۀ ‌ـ۱٢ab. شرکت") for _ in range(12)),) for _ in range(200)]
    for f in (text.normalize_fa, text.light_key, text.collapse_ws, text.digits_only):
        got = one(spark, rows, "s string", a=f("s"), b=f(f("s")))
        assert all(r.a == r.b for r in got)


def test_urls(spark):
    rows = [("https://www.Shop.Example.co.ir/x?y",), ("example.com:80/a",), ("http://1.2.3.4/",), ("",), (None,), ("https://a.b.example.com",)]
    got = one(spark, rows, "u string", d=urls.domain_of("u"), r=urls.registrable_domain("u"))
    assert [r.d for r in got] == ["shop.example.co.ir", "example.com", "1.2.3.4", None, None, "a.b.example.com"]
    assert [r.r for r in got] == ["example.co.ir", "example.com", "1.2.3.4", None, None, "example.com"]
    got = one(spark, [("http://a.com/x/", "../y"), ("http://a.com", "mailto:x"), ("http://a.com", None)], "b string, h string", r=urls.absolute_url("b", "h"))
    assert [r.r for r in got] == ["http://a.com/y", None, None]


def test_fingerprints(spark):
    rows = [("آبی", "تهران", None, None), (None, None, "https://shop.ir", None), (None, None, "https://t.me/x", "+98211"), (None, None, None, None)]
    got = [r.f for r in one(spark, rows, "n string, c string, d string, p string", f=fingerprint.business_fingerprint("n", "c", "d", "p"))]
    assert [f[:2] for f in got] == ["b:", "d:", "p:", "x:"] and len(set(got)) == 4


def test_indel_and_token_set():
    assert similarity.indel("abcd", "abed") == 0.75 and similarity.indel("", "a") == 0 and similarity.indel("same", "same") == 1
    assert similarity.token_set("a b c", "a b") == 1.0 and similarity.token_set("", "x") == 0.0
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for k, y in enumerate(b):
                row[k + 1] = last[k] + 1 if x == y else max(row[k], last[k + 1])
        assert abs(similarity.indel(a, b) - 2 * row[-1] / (len(a) + len(b))) < 1e-12


def test_indel_of_long_texts():
    rnd = random.Random(3)
    a = "".join(rnd.choice("abcdefg") for _ in range(100_000))
    b = a[:50_000] + "x" + a[50_001:]
    began = time.process_time()
    assert similarity.indel(a, b) == similarity.indel(b, a) == 2 * 99_999 / 200_000
    assert similarity.indel(a, "gz" * 30) == similarity.indel("gz" * 30, a) == 60 / 100_060
    assert time.process_time() - began < 1.5
    c, d = ("".join(rnd.choice("abé\ud800") for _ in range(300)) for _ in range(2))
    row = [0] * (len(d) + 1)
    for x in c:
        last = row[:]
        for k, y in enumerate(d):
            row[k + 1] = last[k] + 1 if x == y else max(row[k], last[k + 1])
    assert similarity.indel(c, d) == 2 * row[-1] / 600


def test_compare_bounds(spark):
    rows = [
        ("شرکت پخش مواد شوینده بهرامی", "شرکت پخش مواد شوینده کریمی", "تهران", "تهران", [], [], 0.0, 0.6199),
        ("پخش بهرامی", "پخش بهرامی", "تهران", "تهران", [], [], 0.80, 1.0),
        ("آلفا گستر نور", "زرین تاب شرق", "تهران", "شیراز", ["+981"], ["+981"], 0.0, 0.7999),
    ]
    df = spark.createDataFrame(rows, "a_name string, b_name string, a_city string, b_city string, a_phones array<string>, b_phones array<string>, low double, high double")
    none = F.lit(None).cast("string")
    df = df.withColumns({c: none for c in ("a_address", "b_address", "a_domain", "b_domain")})
    for r in similarity.compare(df).collect():
        assert r.low <= r.score <= r.high, r


def test_spam_terms_are_sought_once(spark):
    df = spark.createDataFrame([("",), ("استخدام فوری، ارسال رزومه",), ("a shop",), (None,)], "t string")
    flags = df.select(relevance.spam_flags("t").alias("f"))
    assert flags._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    given = df.withColumn("w", relevance.weight(relevance.search_text("t"), relevance.DEFAULT.spam)).select(relevance.spam_flags("t", spam="w").alias("f"))
    assert [r.f for r in flags.collect()] == [r.f for r in given.collect()]


def test_relevance(spark):
    rows = [("پخش مواد شوینده بهرامی", "عمده فروشی مایع ظرفشویی و پودر لباسشویی، تماس با ما"), ("خبر روز", "استخدام فوری، ارسال رزومه"), ("", "")]
    got = relevance.score_relevance(spark.createDataFrame(rows, "n string, b string"), "n", "b").collect()
    assert got[0].relevance >= 30 and got[0].category == "DETERGENT" and got[0].role in ("DISTRIBUTOR", "WHOLESALER")
    assert got[1].relevance < 30 and got[2].relevance == 0 and got[2].category is None
    assert len(DEFAULT.categories) == 4 and [len(v) for v in DEFAULT.categories.values()] == [27, 15, 18, 12]


def test_parse_phone_of_the_own_country_that_begins_as_one_from_abroad(spark):
    """``009800114`` is 0 and eight digits; cut as ``0098`` and five digits it was of no length that a phone has."""
    got = one(spark, [("009800114",), ("00982112345678",), ("+00982112345",)], "raw string", p=phones.parse_phone("raw"))
    assert [(r.p.type, r.p.subscriber) for r in got] == [("LANDLINE", "09800114"), ("LANDLINE", "12345678"), ("UNKNOWN", None)]


def test_phone_queries_of_large_keys(spark, tmp_path):
    """Phones made of keys beyond those of the small tables."""
    from quarryline import queries

    rows = spark.createDataFrame([(316142,), (316157,), (11,)], "c_custkey long")
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.type: (r.n, r.valid) for r in queries.QUERIES["phone_parse_classes"](spark, str(tmp_path)).collect()}
    assert got["LANDLINE"] == (2, False)
    judged = {r.c_custkey: (r.type, r.base_quality) for r in queries.QUERIES["phone_quality"](spark, str(tmp_path)).collect()}
    assert judged[316142] == judged[316157] == ("LANDLINE", 0.45)


def test_spam_flags(spark):
    got = one(spark, [("کم", 40), ("x " * 800, 3), ("", 90)], "t string, p int", f=relevance.spam_flags("t", F.lit(0), "p"))
    assert [r.f for r in got] == [["many_phones"], [], []]


def test_spam_flags_of_whole_texts(spark, tmp_path):
    from quarryline import queries

    terms = " ".join(t for t, _ in queries.LEXICON.spam)
    late = "word " * 5000 + terms
    spark.createDataFrame([(1, late), (2, "word " * 5000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.spam_terms, r.dense) for r in queries.QUERIES["spam_flags"](spark, str(tmp_path)).collect()}
    assert got[1][0] and not any(got[2]) and got[1][1] == (sum(w for _, w in queries.LEXICON.spam) >= 7)
    assert "spam_terms" in one(spark, [(late,)], "t string", f=relevance.spam_flags("t", lexicon=queries.LEXICON))[0].f


def test_relevance_beside_a_sharp_s(spark, tmp_path):
    """The SQL of these queries has no sharp s among its letters, so a term may stand beside one."""
    from quarryline import queries

    spark.createDataFrame([(1, "a die\u00dfge"), (2, "clown\u00df pathetic"), (3, "died \u00fcdie"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.role for r in queries.QUERIES["relevance_scores"](spark, str(tmp_path)).collect()}
    assert got == {1: "MAKER", 2: "UNKNOWN", 3: "UNKNOWN", 4: "UNKNOWN"}
    assert [r.dense for r in queries.QUERIES["spam_flags"](spark, str(tmp_path)).orderBy("doc_id").collect()] == [False, True, False, False]


def test_confidence_bands(spark):
    cols = "reliabilities array<double>, domains int, observations int, has_name boolean, has_address boolean, has_website boolean, has_owner boolean, location_known boolean, business_type_known boolean, phone_quality double, phone_type string, area_matches boolean, fake_signals array<string>, is_synthetic boolean, relevance int, spam boolean, newest timestamp"
    from datetime import datetime

    day = datetime(2026, 1, 1)
    weak = ([0.4], 1, 1, True, False, False, False, False, False, 0.5, "LANDLINE", None, [], False, 50, False, day)
    strong = ([0.9, 0.85, 0.8], 3, 5, True, True, True, True, True, True, 1.0, "LANDLINE", True, [], False, 80, False, day)
    fake = strong[:12] + (["repeated_run"],) + strong[13:]
    got = confidence.score_confidence(spark.createDataFrame([weak, strong, fake], cols), F.lit(day)).collect()
    assert got[0].total < got[2].total < got[1].total and got[1].band == "VERY_HIGH" and got[1].total - got[2].total == 40
    assert set(got[0].components.asDict()) == {"source", "corroboration", "fields", "phone"}


def test_places(spark):
    g = geo.Gazetteer([("city", "بندر گز", "بندر گز", "گلستان"), ("province", "گلستان", None, "گلستان"), ("city", "قم", "قم", "قم"), ("city", "تهران", "تهران", "تهران")])
    assert g.locate("فروشگاه در بندر گز")[2] == "بندر گز" and g.locate("بندرگز")[0] == "گلستان"
    assert g.locate("مقمه")[2] is None and g.locate("در قم")[2] is None and g.locate("شهر قم")[2:] == ("قم", 70)
    short = geo.Gazetteer([("city", "نور", "نور", "مازندران"), ("city", "بن", "بن", "چهارمحال"), ("city", "سامان", "سامان", "چهارمحال")])
    assert short.locate("چراغ نور بن")[2] is None and short.locate("شهر نور")[2] == "نور" and short.locate("فروشگاه سامان")[2] == "سامان"
    many = geo.Gazetteer([("city", f"Kart{k}", None, "P") for k in range(60)])
    assert len(many.matches(" ".join(f"Kart{k}" for k in range(60)))) == 60 and len(many.matches("Kart1 Kart2", limit=1)) == 1
    got = one(spark, [("دفتر شهر تهران",), (None,)], "t string", l=geo.locate(spark, g, "t"))
    assert got[0].l.city == "تهران" and got[1].l.confidence == 15


def test_page_candidates(spark):
    entry = '<div class="biz-item"><h3>پخش {0}</h3><p>تلفن: 021-3333445{1} موبایل: 0912123456{1} آدرس: خیابان آزادی پلاک {1}</p></div>'
    html = "<html><body>" + entry.format("بهرامی", 1) + entry.format("کریمی", 2) + "</body></html>"
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"LocalBusiness","name":"Alpha","telephone":"021-33334455",}]}</script>'
    df = spark.createDataFrame([("http://a.ir/1", html), ("http://a.ir/2", ld), ("http://a.ir/3", None)], "url string, html string")
    got = pages.extract(df).collect()
    first = sorted((r for r in got if r.url.endswith("1")), key=lambda r: r.name)
    assert len(first) == 2 and all(len(r.phones) == 2 and r.kind == "DIRECTORY_ENTRY" and r.address for r in first)
    second = [r for r in got if r.url.endswith("2")]
    assert [(r.name, r.phones, r.kind) for r in second] == [("Alpha", ["+982133334455"], "JSON_LD")]


def test_pages_of_one_file_are_walked_by_all_tasks(spark, monkeypatch):
    from quarryline.operators import components

    tasks, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df, label: (tasks.append((label, df.rdd.getNumPartitions())), cut(df, label))[1])
    df = spark.createDataFrame([(f"http://a.ir/{k}", f"<li>shop {k} 0912000{k:04d} here</li>") for k in range(50)], "url string, html string").coalesce(1)
    assert pages.extract(df).count() == 50 and tasks == [("found", 4)]


def test_a_prefix_from_abroad_is_cut_from_any_phone_of_a_text(spark):
    """``0098`` and five digits was taken for a local phone of eight digits, and completed to one that is written nowhere."""
    p = one(spark, [("0098110",), ("009812345",), ("00989123456789",)], "raw string", p=phones.parse_phone("raw", national=False))
    assert [(r.p.type, r.p.national, r.p.reason) for r in p] == [("SERVICE", "110", "service"), ("UNKNOWN", "12345", "bad length (5)"), ("MOBILE", "09123456789", None)]
    df = spark.createDataFrame([(1, "تلفن 009812345", "021"), (2, "تلفن 00982133334455", "021"), (3, "تلفن 33334455", "021")], "id int, t string, area string")
    got = {r.id: (r.e164, r.reason) for r in phones.find_phones(df, "t", "id", "area").collect()}
    assert got[1][1] == "bad length (5)" and got[2] == got[3] == ("+982133334455", None)
    html = spark.createDataFrame([(1, '<a href="tel:009812345">x</a> <p>009854321</p>', "021")], "id int, h string, area string")
    assert phones.find_phones_in_html(html, "h", "id", "area").collect() == []


def test_phone_quality_of_phones_that_are_made_up(spark, tmp_path):
    """Signs that a phone is made up were left out of its quality, in the query and in its SQL."""
    import duckdb

    from quarryline import queries, registry

    keys = [*range(0, 3000), *range(899_000, 900_000), 316142, 4519295, 9063911, 11_111_111, 99_999_999, 123_456_789]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.c_custkey: (r.type, r.base_quality) for r in queries.QUERIES["phone_quality"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == {k: (t, q) for k, t, q in duck.execute(registry.SQL["phone_quality"]).fetchall()} and len(got) == len(keys)
    # 09000000000: few digits, a run of one, four and five zeros, a block for tests
    assert got[0] == ("MOBILE", 0.06) and got[316142] == ("LANDLINE", 0.45)
