"""Places in texts, by a gazetteer given as a table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import ARABIC_DIGITS, DIACRITICS, LETTERS_FROM, LETTERS_TO, PERSIAN_DIGITS, TATWEEL, _c, no_space

# Names that need a marker near them, and the markers.
NEED_CONTEXT = frozenset((
    "مرکزی", "فارس", "قم", "البرز", "ایلام", "گلستان", "قزوین", "سمنان", "خراسان رضوی", "خراسان شمالی", "خراسان جنوبی", "آذربایجان شرقی", "آذربایجان غربی",
    "سیستان و بلوچستان", "چهارمحال و بختیاری", "کهگیلویه و بویراحمد", "همدان", "بوشهر", "یزد", "کرمان", "خوزستان",
))
#: Short names that are common words too; of these, names of up to three letters need a marker.
SHORT_NAMES = (
    "نور", "بن", "ری", "لالی", "مهر", "جم", "قیر", "خوانسار", "راور", "مانه",
    "بهاباد", "اردل", "سامان", "بیضا", "خرامه", "کوار", "سرباز", "سرخه", "طالقان",
    "انار", "رابر", "کوهین", "شال", "گرمدره", "شهرضا",
)
MARKERS = ("استان", "شهرستان", "شهر", "بخش", "دهستان", "واقع در", "واقع در استان")
SEPARATORS = " \t\n\r‌‍‎‏ -_.،,()[]/\\+*"
#: Bits of the table that tells runs of words which can't be a name.
_BITS = 1 << 20
_TOKEN = re.compile(f"[^\\s{re.escape(SEPARATORS)}]+")
#: Places of a gazetteer at most that ``locate`` sends to every task; ``located`` joins a gazetteer of any size.
MOST_PLACES = 100_000
_MAP = {ord(a): b for a, b in zip(LETTERS_FROM, LETTERS_TO, strict=True)} | {ord(c): None for c in DIACRITICS + TATWEEL}
_MAP |= {ord(a): str(k) for digits in (PERSIAN_DIGITS, ARABIC_DIGITS) for k, a in enumerate(digits)}


def _plain(text: str) -> str:
    return " ".join(text.translate(_MAP).replace("‌", " ").split())


@dataclass
class Gazetteer:
    """Places by their name without separators; an index that tasks get whole."""

    places: list[tuple[str, str, str | None, str | None]] = field(default_factory=list)  # kind, name, county, province
    need_context: frozenset[str] = NEED_CONTEXT

    def __post_init__(self):
        self.by_key: dict[str, list[tuple]] = {}
        for p in self.places:
            self.by_key.setdefault("".join(_plain(p[1]).split()).replace("-", ""), []).append(p)
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.by_key, key=len, reverse=True))) or r"(?!)")

    def matches(self, text: str, limit: int | None = None) -> list[tuple[tuple, int, int]]:
        """(place, start, end), leftmost and longest first, none inside another, as whole words; a name that stands in a longer word
        still covers its span. ``limit`` ends the search after so many."""
        norm = _plain(text)
        kept = [(c, k) for k, c in enumerate(norm) if c not in SEPARATORS and not c.isspace()]
        flat, found, seen = "".join(c for c, _ in kept), [], set()
        for m in self.pattern.finditer(flat):
            if limit is not None and len(found) >= limit:
                break
            key = m[0]
            a, b = kept[m.start()][1], kept[m.end() - 1][1] + 1
            edge = lambda c: c in SEPARATORS or c.isspace()
            if not edge(norm[a - 1] if a else " ") or not edge(norm[b] if b < len(norm) else " "):
                continue
            near = norm[max(0, a - 18) : b + 18]
            places = self.by_key[key]
            if (any(p[1] in self.need_context for p in places) or len(key) <= 3 and key in SHORT_NAMES) and not any(m in near for m in MARKERS):
                continue
            for p in places:
                if (p[0], p[1]) not in seen:
                    seen.add((p[0], p[1]))
                    found.append((p, a, b))
        return found

    def locate(self, text: str, hint_city: str | None = None, hint_province: str | None = None) -> tuple:
        """(province, county, city, confidence): the hinted city if it is there, else a marked one, else one that a marked county is
        named after, else the first; its province and county follow it."""
        norm, found = _plain(text), self.matches(text)
        names = {kind: [p[1] for p, _, _ in found if p[0] == kind] for kind in ("province", "county", "city")}
        before = lambda a: norm[max(0, a - 24) : a].rstrip()
        in_county = [p[1] for p, a, _ in found if p[0] != "province" and before(a).endswith(("شهرستان", "بخش"))]
        in_city = [p[1] for p, a, _ in found if p[0] == "city" and before(a).endswith("شهر")]
        explicit = bool(in_county or in_city) or any(before(a).endswith(MARKERS) for _, a, _ in found) or bool(hint_city and hint_city in names["city"])
        if hint_city and hint_city in {n for group in names.values() for n in group}:
            city = hint_city
        else:
            city = next(iter(in_city), None) or next((c for c in in_county[:1] if c in names["city"]), None) or next(iter(names["city"]), None)
        same = [p for p, _, _ in found if p[0] == "city" and p[1] == city]
        chosen = next((p for p in same if hint_province and p[3] == hint_province), same[0] if same else None)
        province = hint_province if hint_province in names["province"] else (chosen[3] if chosen else None) or next(iter(names["province"]), None)
        county = (chosen[2] if chosen else None) or next((c for c in in_county[:1] if c in names["county"]), None) or next(iter(names["county"]), None)
        return province, county, city, 70 if explicit and city else 55 if city else 40 if province else 15


def load(locations: DataFrame, most: int = MOST_PLACES) -> Gazetteer:
    """The gazetteer of ``locations(kind, name, county, province)``; more than ``most`` places are refused."""
    rows = locations.select("kind", "name", "county", "province").distinct().orderBy("kind", "name", "county", "province").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a gazetteer has at most {most} places")
    return Gazetteer([tuple(r) for r in rows])


def locate(spark: SparkSession, gazetteer: Gazetteer, text, hint_city=None, hint_province=None) -> Column:
    """struct(province, county, city, confidence) of a text."""
    shared = spark.sparkContext.broadcast(gazetteer.places)
    need = gazetteer.need_context

    @F.pandas_udf("province string, county string, city string, confidence int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        g = Gazetteer(shared.value, need)  # once a task
        for text, city, province in batches:
            yield pd.DataFrame([g.locate(t or "", c, p) for t, c, p in zip(text, city, province, strict=True)], columns=["province", "county", "city", "confidence"])

    none = F.lit(None).cast("string")
    return run(_c(text), _c(hint_city) if hint_city is not None else none, _c(hint_province) if hint_province is not None else none)


def _place_key(name: str | None) -> str:
    """A name without what separates its words."""
    return "".join(_TOKEN.findall(_plain(name or "")))


def _grams(text: str, lengths: frozenset[int], longest: int, known: bytes) -> Iterator[tuple[int, int, str, bool, bool, bool, bool]]:
    """(start, end, key, a marker is near, one of a county ends before, of a city, any) of the runs of whole words that are as long as some name and share its bit of ``known``."""
    norm = _plain(text)
    marked = any(m in norm for m in MARKERS)
    words = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(norm)]
    for i, (a, _, _) in enumerate(words):
        key = ""
        for _, b, word in words[i:]:
            key += word
            if len(key) > longest:
                break
            if len(key) in lengths and known[crc32(key.encode("utf-8", "replace")) & (_BITS - 1)]:
                if not marked:
                    yield a, b, key, False, False, False, False
                    continue
                near, before = norm[max(0, a - 18) : b + 18], norm[max(0, a - 24) : a].rstrip()
                yield a, b, key, any(m in near for m in MARKERS), before.endswith(("شهرستان", "بخش")), before.endswith("شهر"), before.endswith(MARKERS)


def places_in_texts(texts: DataFrame, places: DataFrame, id: str, text: str, need_context: frozenset[str] = NEED_CONTEXT) -> DataFrame:
    """(<id>, found array<struct<a, b, kind, name, county, province, in_county, in_city, marked>>): the places of ``places(kind, name, county, province)`` in texts.

    Runs of a text's words that are as long as some name are joined to the names, so the gazetteer has no bound and is nowhere whole; a table of a million
    bits, by a hash of the names, keeps most other runs from being shuffled. Of runs that overlap the leftmost and then the longest holds; names are found as whole words, however their own words are
    separated, and one within a longer word covers nothing. Names that need a marker near them and have none are left out after that, and a place is there once. Texts without places have no row.
    """

    @F.pandas_udf("string")
    def place_key(names: pd.Series) -> pd.Series:
        return names.map(_place_key)

    p = places.select("kind", "name", "county", "province").distinct().withColumn("key", place_key("name")).where("key <> ''")
    needs = F.col("name").isin(*need_context) | (F.length("key") <= 3) & F.col("key").isin(*SHORT_NAMES)
    by_key = p.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("kind", "name", "county", "province"))).alias("places"), F.max(needs).alias("needs"))
    lengths = frozenset(r[0] for r in p.select(F.length("key")).distinct().collect())  # at most as many as the longest name has letters
    longest = max(lengths, default=0)
    bits = bytearray(_BITS)
    for r in p.select(F.crc32("key").bitwiseAND(F.lit(_BITS - 1)).cast("int")).distinct().collect():  # at most as many as there are bits
        bits[r[0]] = 1
    known = bytes(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), []
            for k, t in enumerate(batch.column(1)):
                for gram in _grams(t.as_py() or "", lengths, longest, known):
                    out.append((k, *gram))
                    if len(out) >= 50_000:
                        yield pack(ids, out)
                        out = []
            yield pack(ids, out)

    def pack(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        return pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))], ["id", *names])

    kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.bool_()] * 4]
    names = ["a", "b", "key", "near", "in_county", "in_city", "marked"]
    schema = f"id {texts.schema[id].dataType.simpleString()}, a int, b int, key string, near boolean, in_county boolean, in_city boolean, marked boolean"
    met = texts.select(id, text).mapInArrow(run, schema).join(by_key, "key")
    one = F.struct("a", (-F.col("b")).alias("to"), "needs", "near", "in_county", "in_city", "marked", "places")
    runs = met.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("runs"))
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch has thousands of texts, whose runs take gigabytes as Python's objects; those of one text are there at a time, and some thousand places
        for batch in batches:
            begin, found, n = 0, [], 0
            for k, r in enumerate(batch.column(1), 1):
                found.append(_settled(r.as_py()))
                n += len(found[-1])
                if n >= 10_000 or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, k - begin), pa.array(found, kind)], [id, "found"])
                    begin, found, n = k, [], 0

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), *((c, pa.string()) for c in ("kind", "name", "county", "province")), *((c, pa.bool_()) for c in ("in_county", "in_city", "marked"))]))
    shape = f"{id} {texts.schema[id].dataType.simpleString()}, found array<struct<a: int, b: int, kind: string, name: string, county: string, province: string, in_county: boolean, in_city: boolean, marked: boolean>>"
    return runs.select(F.col("id").alias(id), "runs").mapInArrow(settle, shape).where("size(found) > 0")


def _settled(runs: list[dict]) -> list[dict]:
    """Of a text's runs, by start and longest first, the places of those that hold: one that begins before the last that holds has ended is passed over."""
    end, seen, out = 0, set(), []
    for r in runs:
        if r["a"] < end:
            continue
        end = -r["to"]
        if r["needs"] and not r["near"]:
            continue
        for p in r["places"]:
            if (p["kind"], p["name"]) not in seen:
                seen.add((p["kind"], p["name"]))
                out.append({"a": r["a"], "b": end, **p, "in_county": r["in_county"], "in_city": r["in_city"], "marked": r["marked"]})
    return out


def located(texts: DataFrame, places: DataFrame, id: str, text: str, hint_city: str | None = None, hint_province: str | None = None, need_context: frozenset[str] = NEED_CONTEXT) -> DataFrame:
    """``texts`` with the (province, county, city, confidence) that ``Gazetteer.locate`` describes, by ``places_in_texts``; ``id`` is unique."""
    none = F.lit(None).cast("string")
    found = places_in_texts(texts, places, id, text, need_context)
    rows = texts.join(found, id, "left").withColumns({
        "__found": F.coalesce("found", F.filter(F.array(F.lit(None).cast(found.schema["found"].dataType.elementType)), lambda x: x.isNotNull())),
        "__city": F.col(hint_city) if hint_city else none, "__province": F.col(hint_province) if hint_province else none,
    }).drop("found")
    of = lambda condition: F.transform(F.filter("__found", condition), lambda x: x["name"])
    rows = rows.withColumns({
        "__cities": of(lambda x: x["kind"] == "city"), "__counties": of(lambda x: x["kind"] == "county"), "__provinces": of(lambda x: x["kind"] == "province"),
        "__in_county": of(lambda x: (x["kind"] != "province") & x["in_county"]), "__in_city": of(lambda x: (x["kind"] == "city") & x["in_city"]),
    })
    head = lambda c: F.get(c, F.lit(0))
    has = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))
    hinted = has("__cities", F.col("__city")) | has("__counties", F.col("__city")) | has("__provinces", F.col("__city"))
    marked_county = F.when(has("__cities", head("__in_county")), head("__in_county"))
    explicit = (F.size("__in_county") > 0) | (F.size("__in_city") > 0) | F.exists("__found", lambda x: x["marked"]) | has("__cities", F.col("__city"))
    rows = rows.withColumns({"city": F.when(hinted, F.col("__city")).otherwise(F.coalesce(head("__in_city"), marked_county, head("__cities"))), "__explicit": explicit})
    same = F.filter("__found", lambda x: (x["kind"] == "city") & (x["name"] == F.col("city")))
    rows = rows.withColumn("__same", same)
    rows = rows.withColumn("__chosen", F.coalesce(head(F.filter("__same", lambda x: x["province"] == F.col("__province"))), head("__same")))
    province = F.when(has("__provinces", F.col("__province")), F.col("__province")).otherwise(F.coalesce("__chosen.province", head("__provinces")))
    county = F.coalesce("__chosen.county", F.when(has("__counties", head("__in_county")), head("__in_county")), head("__counties"))
    rows = rows.withColumns({"province": province, "county": county})
    confidence = F.when(F.col("__explicit") & F.col("city").isNotNull(), 70).when(F.col("city").isNotNull(), 55).when(F.col("province").isNotNull(), 40).otherwise(15)
    own = [c for c in texts.columns if c not in ("province", "county", "city", "confidence")]
    return rows.select(*own, "province", "county", "city", confidence.alias("confidence"))


def nested_places(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, county, province, area_code) of a JSON file of provinces with counties with cities; area codes are the province's."""
    schema = "provinces array<struct<name: string, area_codes: array<string>, counties: array<struct<name: string, cities: array<string>>>>>"
    p = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("provinces").alias("p"))
    p = p.select(F.col("p.name").alias("province"), F.get("p.area_codes", F.lit(0)).alias("area_code"), "p.counties")
    none = F.lit(None).cast("string")
    c = p.select("province", "area_code", F.explode("counties").alias("c")).select("province", "area_code", F.col("c.name").alias("county"), "c.cities")
    out = p.select(F.lit("province").alias("kind"), F.col("province").alias("name"), none.alias("county"), "province", "area_code")
    out = out.unionByName(c.select(F.lit("county").alias("kind"), F.col("county").alias("name"), "county", "province", "area_code"))
    return out.unionByName(c.select(F.lit("city").alias("kind"), F.explode("cities").alias("name"), "county", "province", "area_code"))


def flat_places(provinces: DataFrame, counties: DataFrame, cities: DataFrame) -> DataFrame:
    """The same of three tables joined by ids: provinces(id, name, area_code), counties(id, name, province_id), cities(id, name, county_id)."""
    p = provinces.select(F.col("id").alias("province_id"), F.col("name").alias("province"), "area_code")
    k = counties.select(F.col("id").alias("county_id"), F.col("name").alias("county"), "province_id").join(p, "province_id", "left")
    t = cities.select("name", "county_id").join(k, "county_id", "left")
    none = F.lit(None).cast("string")
    out = p.select(F.lit("province").alias("kind"), F.col("province").alias("name"), none.alias("county"), "province", "area_code")
    out = out.unionByName(k.select(F.lit("county").alias("kind"), F.col("county").alias("name"), "county", "province", "area_code"))
    return out.unionByName(t.select(F.lit("city").alias("kind"), "name", "county", "province", "area_code"))


def area_codes(cities: DataFrame, places: DataFrame) -> DataFrame:
    """``cities(city, province)`` with the area code of the first place of that name, else of the province."""
    by_city = places.where("kind = 'city'").groupBy(no_space("name").alias("__k")).agg(F.min_by("area_code", F.struct("province", "county")).alias("__a"))
    by_province = places.where("kind = 'province'").groupBy(F.col("name").alias("province")).agg(F.min("area_code").alias("__b"))
    out = cities.withColumn("__k", no_space("city")).join(by_city, "__k", "left").join(by_province, "province", "left")
    return out.withColumn("area_code", F.coalesce("__a", "__b")).drop("__k", "__a", "__b")


def counts(places: DataFrame) -> DataFrame:
    return places.groupBy("kind").agg(F.count("*").alias("n"))
