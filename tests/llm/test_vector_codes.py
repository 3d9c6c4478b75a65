"""Codes against loops over whole integers, the search against full distances, and the query against its SQL."""

import hashlib
import math
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from quarryline.llm import vector_codes  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, entries=64, parts=16, rounds=2):
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    width = -(-dim // parts)
    ints = [[math.floor(256 * x) if abs(x) < 2**53 else int(math.copysign(min(256 * abs(x), 2**62), x)) for x in v] + [0] * (width * parts - dim) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda a, book: min((far(a, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(best(c[p], books[p])[1], []).append(c[p])
            for k, g in groups.items():
                books[p][k] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    of_label = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        of_label[lab] = of_label.get(lab, 0) + e
    most = 2**63 - 1
    return [(i, "".join(f"{k:02x}" for _, k in f), min(e, most), min(of_label[lab], most), sha) for (i, _, lab), f, e in zip(kept, found, errors, strict=True)]


def check(spark, rows):
    got = vector_codes.coded(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)


def vectors(n, dim=32, seed=2, kinds=9):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(kinds, dim))
    return [(k, (centres[k % kinds] + rnd.normal(size=dim) / 4).tolist(), None if k % 11 == 0 else k % 5) for k in range(n)]


@pytest.mark.parametrize("k,n,m", [(1, 50, 64), (4, 3000, 64), (4, 500, 3), (7, 400, 40), (4, 10, 1), (4, 0, 5)])
def test_partial_distances_are_full_ones(k, n, m):
    rnd = np.random.default_rng(k * n + m)
    points, entries = rnd.integers(-6, 6, (n, k)), rnd.integers(-6, 6, (m, k))  # small, so that ties abound
    index, distance = vector_codes.nearest(points, entries)
    full = ((points[:, None].astype(np.int64) - entries[None]) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1, initial=1 << 60)).all()


def test_large_integers_stay_exact():
    points, entries = np.array([[1 << 60, 3], [-(1 << 61), 0], [5, 5]]), np.array([[1 << 60, 0], [0, 0], [-(1 << 61), 2]])
    index, distance = vector_codes.nearest(points, entries)
    assert index.tolist() == [0, 2, 1] and distance.tolist() == [9, 4, 50]


def test_against_loops(spark):
    check(spark, vectors(300))


def test_few_vectors_ties_repeats_and_nulls(spark):
    base = vectors(20, dim=16, seed=5)
    odd = [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] + [0.0] * 15, 2), (904, [], None), (905, [1.0] * 5, None)]
    check(spark, base + odd + [(3, base[4][1], 1), (3, base[4][1], 1), (None, [0.25] * 16, None), (None, [-0.001] * 16, 4)])


def test_sizes_no_multiple_of_the_parts_and_huge_components(spark):
    check(spark, vectors(90, dim=37, seed=8))
    check(spark, [*vectors(70, dim=16, seed=9), (500, [1e9, *[0.5] * 15], 1), (501, [-1e300, *[0.5] * 15], 1), (502, [3e8, *[0.5] * 15], 2)])


def test_empty_and_clashing_columns(spark):
    assert vector_codes.coded(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = vectors(70, dim=16)
    wide = spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA + ", code string, error double")
    assert sorted(map(tuple, vector_codes.coded(wide).collect()), key=str) == sorted(plain(rows), key=str)


def test_decoded_vectors_are_near(spark):
    rows = vectors(200, dim=16)
    frame = spark.createDataFrame(rows, SCHEMA)
    books = vector_codes.train(vector_codes.kept(frame))
    got = {r.vec_id: r for r in vector_codes.decode(vector_codes.encode(frame, books), books).collect()}
    for i, v, _ in rows:
        off = sum((math.floor(256 * a) - math.floor(256 * b)) ** 2 for a, b in zip(v, got[i].embedding, strict=True))
        assert off == got[i].error and len(got[i].embedding) == 16


def test_query_is_its_sql(spark, tmp_path):
    import duckdb

    from quarryline.llm import queries

    rnd = random.Random(4)
    rows = vectors(150, dim=64) + [(1000 + k, [rnd.choice([0.0, float("nan"), None]) for _ in range(64)], 1) for k in range(5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.execute(queries.oracle_sql()["op13_vector_codes"])
    names = [d[0] for d in want.description]
    got = queries.op13_vector_codes(spark, str(tmp_path)).select(names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
