"""The merged trie against a plain one built of all rebuilt conversations, and the query against its SQL."""

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("public_tokenizers")
from quarryline.llm import conversation_trie  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Every prefix of every conversation, and what lies below it by looking at all of them."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c in convs:
        convs[c] = [t[2:] for t in sorted(convs[c], key=lambda t: t[:2])]
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    nodes = {p[:d] for p in rebuilt.values() for d in range(len(p) + 1)}
    members = {n: sorted(c for c, p in rebuilt.items() if p[: len(n)] == n) for n in nodes}
    children = {n: sum(m[:-1] == n for m in nodes if m) for n in nodes}
    words = {n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n in nodes}
    out = []
    for n in nodes:
        below = [m for m in nodes if m[: len(n)] == n]
        ends = ",".join(str(c) for c in members[n] if rebuilt[c] == n)
        out.append((
            members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), children[n], sum(children[m] == 0 for m in below),
            sum((len(members[m]) - 1) * words[m] for m in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = conversation_trie.trie(frame).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def made(seed, convs, most=6):
    rnd = random.Random(seed)
    said = ["hello there", "a b c", "", None, "x\x0by\x85z", "one\ntwo  three"]
    out = []
    for c in convs:
        out += [(c, t, rnd.choice(["user", "assistant", None, ""]) if rnd.random() < 0.2 else ["user", "assistant"][t % 2], rnd.choice(said)) for t in range(rnd.randint(1, most))]
    rnd.shuffle(out)
    return out


def test_against_a_plain_trie(spark):
    check(spark, made(1, range(0, 130)))


def test_absent_bases_short_ones_and_turnless(spark):
    # 21 to 39 lack their base; 40 has one turn; those whose heads outnumber their own turns are rebuilt without any
    check(spark, made(2, [c for c in range(20, 70) if c % 20 or c == 40], most=2))


def test_null_turns_repeats_clashes_and_nulls(spark):
    rows = [(0, None, "user", "first"), (0, 5, "user", "b"), (0, 5, "user", "b"), (3, 1, None, None), (3, None, None, ""), (None, 1, "user", "lost"), (7, 2, "user", "a" * 100_000), (19, 1, "user", "1")]
    check(spark, rows)
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", node int, words string")
    assert sorted(map(tuple, conversation_trie.trie(wide).select(COLUMNS).collect()), key=str) == plain(rows)
    assert conversation_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_role_and_text_stay_apart(spark):
    check(spark, [(0, 1, "a", "bc"), (1, 1, "ab", "c"), (2, 1, "", "abc"), (20, 1, "a", "bc"), (40, 1, "3:a", "bc")])


def test_hot_copies_pass_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 2)
    rows = [(c, t, "user", "same words") for c in range(0, 400) for t in range(2)] + made(4, range(400, 440))
    check(spark, rows)


def test_query_is_its_sql(spark, tmp_path):
    import duckdb

    from quarryline.llm import queries

    spark.createDataFrame(made(6, range(0, 90)), SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.op12_conversation_trie(spark, str(tmp_path))
    want = duck.execute(queries.OP12_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(want.fetchall(), key=str)
