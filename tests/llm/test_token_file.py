"""Packed ids against the tokenizers library: order, offsets, widths, blocks, random access, nulls, repeats, long texts, empty tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from quarryline.llm import token_file  # noqa: E402
from quarryline.llm.common import new_path  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\t", "one", "One 7 two 77 x7", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ ΣΑΣ, é É é İ", "a\x1cb \x1f c", "x" * 5000, "中文 字　字", "'s don't I'll", "ﬁ   z"]


def sample(n=60, seed=5):
    rnd = random.Random(seed)
    words = ["the", "Thing,", "été", "ÉTÉ", "x9", "7", "--", "...", "zq" * 30] + [f"w{k}" for k in range(300)]
    return [*ODD, *(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 400))) for _ in range(n))]


def expected(texts, end=2):
    t, out, start = Tokenizer.from_file(PATH), [], 0
    for text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("width", [1, 5, 8, 11, 16, 17, 29, 32])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 4095, 4096, 4097, 10_000])
def test_pack_round_trip(width, n):
    ids = np.random.default_rng(width * 31 + n).integers(0, 1 << width, n, dtype=np.uint64).astype("<u4")
    packed, blocks = token_file.pack_blocks(ids, width)
    assert blocks[-1] == len(packed) == sum(-(-min(token_file.BLOCK, n - lo) * width // 8) for lo in range(0, n, token_file.BLOCK))
    assert (token_file.read_ids(packed, blocks, width, n, 0, n) == ids).all()
    for first, many in ((0, 0), (n // 2, n - n // 2), (n // 3, min(5, n - n // 3))):
        assert (token_file.read_ids(packed, blocks, width, n, first, many) == ids[first : first + many]).all()


def test_pack_by_bits():
    assert token_file.pack(np.array([1, 2, 3, 4]), 3) == int("100011010001", 2).to_bytes(2, "little")
    assert [token_file.width_of(v) for v in (1, 2, 3, 256, 257, 49408, 65537)] == [1, 1, 2, 8, 9, 16, 17]
    with pytest.raises(ValueError):
        token_file.pack(np.array([8]), 3)


def test_encoder_is_the_library(monkeypatch):
    monkeypatch.setattr(token_file, "MOST_WORDS", 50)
    encoder, t = token_file.Encoder(PATH), Tokenizer.from_file(PATH)
    assert encoder.by_word and encoder.folds
    rnd = random.Random(3)
    letters = ["a", "B", "́", "Σ", "\x1c", " ", "\n", "\x85", " ", "　", "<|endoftext|>", "'s", "é", "É", "7", "1", "!", "中", "‍", "İ", "ﬁ", "\xad", "µ"]
    fuzz = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 15))) for _ in range(3000)]
    for text in [*(x or "" for x in sample()), *fuzz]:
        assert encoder.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    spaced = token_file.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not spaced.by_word and spaced.encode(" a  b").tolist() == spaced.tokenizer.encode(" a  b", add_special_tokens=False).ids


def test_documents_come_back(spark):
    texts = sample()
    rows = spark.createDataFrame([(3 * k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, start string").repartition(5)
    path = new_path(spark, "token-file")
    token_file.write(rows, path, PATH, end_id=2, segment=3000)
    got = token_file.documents(spark, path).orderBy("doc_id").collect()
    assert [(r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got] == expected(texts) and [r.doc_id for r in got] == [3 * k for k in range(len(texts))]
    segments = token_file.segments(spark, path).orderBy("start").collect()
    assert len(segments) > 4 and {s.width for s in segments} == {16}
    assert [s.start for s in segments] == [sum(x.n_ids for x in segments[:k]) for k in range(len(segments))]
    all_ids = [i for e in expected(texts) for i in e[3]]
    wanted = [(k, first, n) for k, (first, n) in enumerate([(0, 1), (10, 9000), (4090, 20), (len(all_ids) - 3, 50), (len(all_ids) + 5, 5), (7, 0)])]
    pieces = token_file.stretches(spark, path, spark.createDataFrame(wanted, "key long, first long, n long")).collect()
    for k, first, n in wanted:
        assert [i for p in sorted((p for p in pieces if p.key == k), key=lambda p: p.start) for i in p.ids] == all_ids[first : first + n]


def test_repeats_nulls_and_empty(spark):
    texts = ["b b", "a", "a", None, "c " * 30]
    rows = spark.createDataFrame([(None, "n"), (None, "n"), *((7, t) for t in texts), (1, "first")], "doc_id long, text string").repartition(3)
    got = token_file.stored(rows, PATH, 2, with_ids=True).collect()
    assert sorted(r.start for r in got) == np.cumsum([0, *(r.n_tokens for r in sorted(got, key=lambda r: r.start))])[:-1].tolist()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 1, 7, 7, 7, 7, 7]
    assert sorted(r.ids for r in got if r.doc_id == 7) == sorted(e[3] for e in expected(texts))
    assert token_file.stored(rows.limit(0), PATH, 2).count() == 0


def test_query_has_all_documents(spark, tmp_path):
    from quarryline.llm import queries

    texts = sample(30, 9)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_token_file(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(k, *e[:3]) for k, e in enumerate(expected(texts))]
