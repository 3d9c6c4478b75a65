"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from quarryline.llm import byte_bpe, decontamination, html_extraction, line_dedup, ngram_join, quality, queries, sharding, substring_dedup, suffix_sort, token_lengths, transport_stream  # noqa: E402
from quarryline.llm.common import TokenHashes, shingle_hashes, word_hashes  # noqa: E402
from quarryline.llm.minhash import shingle_set  # noqa: E402

RANKS, PATTERN = queries.RANKS, queries.PATTERN
WORDS = [f"w{k}" for k in range(400)]


def texts(seed=1, n=24):
    rnd = random.Random(seed)
    out = [None, "", " ", "é" * 50, "\n\n a \nB\t\n", "x" * 700, "one two", "one two", "One two!"]
    for _ in range(n):
        out.append("\n".join(" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(3, 40))) for _ in range(rnd.randint(1, 6))))
    base = out[12]
    out += [base, base, base + " end", "start " + base, " ".join(out[10:18])]
    return out


def frame(spark, rows, schema="doc_id long, text string", parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, list(enumerate(texts())))


def test_sharding_fits_and_follows_bits(spark, docs):
    wide = docs.withColumns({"shard": F.lit("x"), "cell": F.lit(1), "size": F.lit(2)})
    got = sharding.shard(wide, ["doc_id"], F.octet_length("text"), 600).collect()
    assert len(got) == len(texts())
    by = {}
    for r in got:
        by.setdefault((r.shard, r.shard_page), []).append(r.row_bytes)
        assert format(int(hashlib.md5(f"={r.doc_id}".encode()).hexdigest()[:15], 16), "060b").startswith(r.shard)
    assert all(sum(v) <= 600 or len(v) == 1 for v in by.values())
    assert sharding.shard(docs.limit(0), ["doc_id"], F.octet_length("text"), 600).count() == 0


def test_sharding_pages_a_hot_key(spark):
    rows = frame(spark, [(7, "a" * (10 + k % 5)) for k in range(300)] + [(None, "b" * 900), (None, None)])
    got = sharding.shard(rows, ["doc_id"], F.octet_length("text"), 200).collect()
    sizes, counts = Counter(), Counter()
    for r in got:
        sizes[r.shard, r.shard_page] += r.row_bytes
        counts[r.shard, r.shard_page] += 1
    assert len(got) == 302 and all(v <= 200 or counts[k] == 1 for k, v in sizes.items())


def test_line_dedup(spark):
    rows = [(k, t) for k, t in enumerate(texts() + [" Common Line\t\nown %d" % k for k in range(12)] + ["common line"])]
    got = {r.doc_id: r for r in line_dedup.dedup(frame(spark, rows).withColumn("n_lines", F.lit(9)), min_docs=10).collect()}
    where = Counter(key for _, t in rows for key in set(line_dedup.line_keys(t or "")) if key)
    for k, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x, key in zip(lines, line_dedup.line_keys(t or ""), strict=True) if not key or where[key] < 10]
        assert (got[k].n_lines, got[k].n_dropped, got[k].text) == (len(lines), len(lines) - len(keep), "\n".join(keep))
        assert got[k].kept_sha256 == hashlib.sha256("\n".join(keep).encode()).hexdigest()
    assert line_dedup.dedup(frame(spark, [])).count() == 0


def test_line_runs_compact_and_follow_batches(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    seen = [runs.dedup_batch(frame(spark, [(k, f"same\nown {k}")]), min_docs=3).first().text for k in range(5)]
    assert seen == ["same\nown 0", "same\nown 1", "own 2", "own 3", "own 4"]
    assert [len(level) for level in runs.levels] == [1, 0, 1] and runs.counts().agg(F.max("n_docs")).first()[0] == 5


def test_token_lengths(spark, docs):
    encoding = token_lengths.encoding(RANKS, PATTERN)
    n = [len(encoding.encode_ordinary(t or "")) for t in texts()]
    summary = token_lengths.summaries(token_lengths.histogram(docs, RANKS, PATTERN)).cache()
    for r in summary.collect():
        assert r.n_docs == n.count(r.n_tokens) and r.docs_over == sum(x > r.n_tokens for x in n) and r.tokens_over == sum(x for x in n if x > r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n) and abs(r.quantile - sum(x <= r.n_tokens for x in n) / len(n)) < 1e-12
    for limit in (0, 3, 57, 10_000):
        assert token_lengths.at_limit(summary, limit)["truncated_tokens"] == sum(min(x, limit) for x in n)
    assert token_lengths.quantile(summary, 0.5) == sorted(n)[(len(n) - 1) // 2]
    assert token_lengths.summaries(token_lengths.histogram(docs.limit(0), RANKS, PATTERN)).count() == 0


@pytest.mark.parametrize("size", [0, 1, 169, 170, 184, 191, 192, 193, 8832, 8833, 50_000])
def test_transport_stream_round_trip(size):
    payload = transport_stream.framed(random.Random(size).randbytes(size))
    media = transport_stream.mux(payload)
    back = transport_stream.demux(media)
    own = back.streams[transport_stream.DATA_PID]
    assert own.data == payload and len(payload) % 192 == 0 and payload and len(media) % 188 == 0
    assert back.continuity_errors == back.bad_packets == back.bad_sections == back.bad_units == 0 and own.units[0] == (0, 0, True)
    assert [t for t, _, _ in own.units] == [k * transport_stream.STEP for k in range(len(own.units))] and len(back.clocks) == sum(r for _, _, r in own.units)


def test_transport_stream_faults():
    media = transport_stream.mux(transport_stream.framed(b"x" * 20_000))
    packets = [media[k : k + 188] for k in range(0, len(media), 188)]
    assert transport_stream.demux(b"".join(packets[:10] + packets[11:])).continuity_errors == 1
    assert transport_stream.demux(b"".join(packets[:10] + packets[9:])).duplicates == 1
    assert transport_stream.demux(b"".join(packets[:5] + [b"\0" * 188] + packets[6:])).bad_packets == 1
    broken = bytearray(media)
    broken[20] ^= 1
    assert transport_stream.demux(bytes(broken)).bad_sections == 1 and transport_stream.demux(b"").packets == 0


def test_transport_stream_column(spark, docs):
    for r in transport_stream.store(docs, "doc_id", F.col("text")).collect():
        payload = transport_stream.framed((texts()[r.doc_id] or "").encode())
        assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(payload))
        assert transport_stream.demux(r.media).streams[transport_stream.DATA_PID].data == payload and r.media_sha256 == hashlib.sha256(r.media).hexdigest()


def test_quality_learns_and_handles_one_kind(spark):
    rnd = random.Random(4)
    good = [" ".join(rnd.choice(WORDS) for _ in range(60)) + "." for _ in range(150)]
    bad = [" ".join(["!!" + rnd.choice(WORDS[:9])] * 40) for _ in range(50)]
    rows = list(enumerate(good + bad + [None, ""]))
    labels = spark.createDataFrame([(k, int(k < 150), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    d = frame(spark, rows).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in quality.score(d, quality.train(d, labels)).collect()}
    assert len(got) == 202 and all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert np.mean([got[k].predicted == (k < 150) for k in range(200) if got[k].held_out]) > 0.95 and got[200].score == got[201].score
    flat = quality.score(d, quality.train(d, labels.where("quality = 1")))
    assert {r.score for r in flat.collect()} == {0.5}
    assert quality.score(d.limit(0), quality.train(d, labels.limit(0))).count() == 0


def test_suffix_order():
    rnd = random.Random(9)
    for _ in range(150):
        t = np.array([rnd.randint(0, rnd.choice([1, 3])) for _ in range(rnd.randint(1, 80))], dtype=np.uint16)
        import tempfile

        with tempfile.TemporaryDirectory() as folder:
            got = suffix_sort.suffix_order(t, folder, queue_most=rnd.choice([4, 1000])).tolist()
        assert got == sorted(range(len(t)), key=lambda k: t.tolist()[k:])


@pytest.mark.parametrize("hot", [1, 4000])
def test_substring_dedup(spark, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup.repeats, "__defaults__", (200, 2000, hot))
    passage = " ".join(WORDS[:70])
    own = texts() + [f"{k} {passage} tail {k} " + "é" * k for k in range(8)] + ["ab" * 300]
    rows = list(enumerate(own))
    got = {r.doc_id: r for r in substring_dedup.dedup(frame(spark, rows)).collect()}
    count = Counter((t or "").encode()[k : k + 200] for t in own for k in range(len((t or "").encode()) - 199))
    for k, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - 199):
            if count[raw[a : a + 200]] > 1:
                gone[a : a + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(raw, gone, strict=True) if not y)
        spans = sum(1 for a in range(len(gone)) if gone[a] and not (a and gone[a - 1]))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, bytes(got[k].kept)) == (len(raw), len(raw) - len(kept), spans, kept)
    assert substring_dedup.dedup(frame(spark, [])).count() == 0


def test_decontamination(spark, docs):
    rnd = random.Random(8)
    items = [(k, " ".join(rnd.choice(WORDS) for _ in range(n))) for k, n in enumerate([20, 30, 45, 3])] + [(8, None), (9, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    item = items[1][1].split()
    rows = [(1, "a b " + " ".join(item) + " c"), (2, " ".join(item[:10])), (3, None), (4, ""), (5, items[3][1]), (6, "x " + " ".join(items[2][1].split()[:44]) + " y z"), (7, " ".join(WORDS[:300]))]
    got = {r.doc_id: [m.item_id for m in r.matches] for r in decontamination.find(frame(spark, rows).withColumn("matches", F.lit(1)), bench).collect()}
    assert got == {1: [1], 2: [], 3: [], 4: [], 5: [3], 6: [2], 7: []}
    assert decontamination.find(docs, bench.limit(0)).where("size(matches) > 0").count() == 0
    index = decontamination.Items.of(items).prepared()
    prints = np.array([rnd.getrandbits(64) for _ in range(300)] + [int(index.prints[0]) ^ 0xFFF], dtype=np.uint64)
    for size, members in index.by_size.items():
        want = sorted((w, k) for w in range(len(prints)) for k in members if (int(prints[w]) ^ int(index.prints[k])).bit_count() <= decontamination.RADIUS)
        assert index.candidates(prints, size) == want


def weighted_brute_force(rows, items, least=0.8):
    """Item ids of each text by all windows of each item's size: weighted shingle similarity, without fingerprints."""
    known = TokenHashes()
    of = lambda t: shingle_hashes(word_hashes(t or "", known)).tolist()
    bags = {k: Counter(of(t)) for k, t in items}
    spread = Counter(s for b in bags.values() for s in b)
    out = {}
    for doc, t in rows:
        words, out[doc] = word_hashes(t or "", known), []
        for k, item in items:
            size = len(word_hashes(item or "", known))
            width = min(size, len(words))
            for a in range(len(words) - width + 1) if width else ():
                bag = Counter(shingle_hashes(words[a : a + width], min(5, size)).tolist()) if min(5, size) <= width else Counter()
                both = sum(min(n, bags[k][s]) / spread[s] for s, n in bag.items() if s in bags[k])
                whole = sum(n / max(1, spread[s]) for s, n in bag.items()) + sum(n / spread[s] for s, n in bags[k].items()) - both
                if both / whole >= least:
                    out[doc].append(k)
                    break
    return out


@pytest.mark.parametrize("most_bytes", [1 << 24, 900])
def test_decontamination_recall_and_pieces(spark, most_bytes):
    rnd = random.Random(12)
    common = [rnd.choice(WORDS) for _ in range(12)]  # two items share it, wherever the benchmark is cut
    items = [(k, " ".join((common if k % 7 == 0 else []) + [rnd.choice(WORDS) for _ in range(rnd.choice([12, 20, 40, 60]))])) for k in range(24)]
    rows = []
    for k, text in items:
        for j in range(6):
            words = text.split()
            for _ in range(j // 2):
                words[rnd.choice([0, -1, rnd.randrange(len(words))])] = rnd.choice(["edit", "other", "thing"])
            rows.append((len(rows), " ".join([rnd.choice(WORDS) for _ in range(rnd.randint(0, 30))] + words + [rnd.choice(WORDS) for _ in range(9)])))
    rows += [(900, " ".join(rnd.choice(WORDS) for _ in range(20_000)) + " " + items[3][1]), (901, None), (902, ""), (903, rows[0][1]), (903, rows[0][1])]
    bench = frame(spark, items, "item_id long, text string")
    want = weighted_brute_force(rows, items)
    assert sum(map(len, want.values())) > 60
    for r in decontamination.find(frame(spark, rows), bench, most_bytes=most_bytes).collect():
        assert [m.item_id for m in r.matches] == want[r.doc_id]


def test_window_fingerprints_are_those_of_their_bags():
    rnd = random.Random(1)
    for _ in range(150):
        n = rnd.randint(1, 40)
        shingles = np.array([rnd.randint(1, 12) for _ in range(n)], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        weights, size = 1 / (1 + (shingles % np.uint64(3)).astype(float)), rnd.randint(1, n)
        want = [decontamination.fingerprint(shingles[i : i + size], weights[i : i + size]) for i in range(n - size + 1)]
        assert decontamination.window_fingerprints(shingles, weights, size).tolist() == want


@pytest.mark.parametrize("common,own", [(150, 50), (100, 100), (60, 60), (30, 60), (0, 40), (0, 9)])
def test_decontamination_recall_with_boilerplate(common, own):
    """Items that share most of their words, sought in edited copies and in documents of their own words alone."""
    rnd = random.Random(common + own)
    shared = [f"b{rnd.randrange(10**6)}" for _ in range(common)]
    items = [shared + [f"w{rnd.randrange(20000)}" for _ in range(own)] for _ in range(40)]
    index, known = decontamination.Items.of([(k, " ".join(w)) for k, w in enumerate(items)]).prepared(), TokenHashes()
    hits = missed = 0
    for k, words in enumerate(items):
        copies = [words[common:]] if common else []
        for _ in range(12):
            v = list(words)
            for _ in range(rnd.randint(0, max(1, own // 25))):
                v[rnd.randrange(common, len(v))] = f"z{rnd.randrange(10**6)}"
            v = v[rnd.randint(0, own // 6) : len(v) - rnd.randint(0, own // 8)]
            copies += [v, [f"y{rnd.randrange(10**6)}" for _ in range(20)] + v + ["tail"]]
        for copy in copies:
            hashes = word_hashes(" ".join(copy), known)
            shingles = shingle_hashes(hashes).tolist()
            size = min(len(words), len(copy)) - 4
            if max((index.similarity(shingles[i : i + size], k) for i in range(len(shingles) - size + 1)), default=0) >= 0.8:
                found = k in index.matches(hashes, 0.8)
                hits, missed = hits + found, missed + (not found)
    assert hits > 60 and missed <= 0.01 * (hits + missed)


def test_ngram_join(spark):
    rnd = random.Random(6)
    base = [" ".join(rnd.choice(WORDS) for _ in range(120)) for _ in range(12)]
    rows = list(enumerate(texts() + base + [b + " more" for b in base[:6]] + [base[0].upper(), "the " + base[1] + " end"] * 2))
    got = {r.doc_id: r for r in ngram_join.classes(frame(spark, rows)).collect()}
    known = TokenHashes()
    sets = {k: set(shingle_set(t or "", known).tolist()) for k, t in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {k: r.class_id for k, r in got.items()} == {k: root(k) for k in sets}
    assert all((r.n_links > 0) == (list(map(root, sets)).count(root(k)) > 1) for k, r in got.items())
    assert ngram_join.classes(frame(spark, [])).count() == 0
    assert ngram_join.prefix_length(0.8, 0.99999) == 5


@pytest.mark.parametrize("members", [256, 9])
def test_ngram_join_counts_all_links(spark, monkeypatch, members):
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    rnd = random.Random(8)
    base = [rnd.choice(WORDS) for _ in range(150)]
    rows = []
    for k in range(60):  # one group of near copies, some of them more than once
        words = list(base)
        for at in rnd.sample(range(150), k % 4):
            words[at] = f"v{k}"
        rows += [" ".join(words)] * (1 + (k % 7 == 0))
    rows = list(enumerate(rows + texts()))
    known = TokenHashes()
    sets = {k: set(shingle_set(t or "", known).tolist()) for k, t in rows}
    like = lambda a, b: sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    want = {a: sum(1 for b in sets if a != b and like(a, b)) for a in sets}
    assert len(set(map(frozenset, sets.values()))) > 40 and max(want.values()) > 40
    assert {r.doc_id: r.n_links for r in ngram_join.classes(frame(spark, rows)).collect()} == want


def test_byte_bpe(spark, docs):
    encoding = token_lengths.encoding(RANKS, PATTERN)
    odd = ["it's  12²½\x1c\x85\xa0 x", "漢字 😀\n\n  end ", "don't\t'll", "a" * 300]
    rows = list(enumerate(texts() + odd))
    d = frame(spark, rows)
    out = byte_bpe.encode(d, byte_bpe.vocabulary(d, RANKS, PATTERN, head=150), ["doc_id"])
    for r in out.collect():
        t = rows[r.doc_id][1] or ""
        ids = encoding.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == t.encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    native = byte_bpe.decoded(out.select("doc_id", "ids"), "ids", RANKS)
    assert all(bytes(r.decoded or b"") == (rows[r.doc_id][1] or "").encode() for r in native.collect())
    ranks = byte_bpe.ranks_of(RANKS)
    for w in (" thation", "ééé", "zzzqqq", "0" * 40):
        assert byte_bpe.encode_short(w.encode(), ranks) == byte_bpe.encode_long(w.encode(), ranks) == encoding.encode_ordinary(w)
    assert byte_bpe.encode(d.limit(0), byte_bpe.vocabulary(d.limit(0), RANKS, PATTERN), ["doc_id"]).count() == 0


@pytest.mark.parametrize("block", ['<section class="legal">kept</section>', '<div class="related-work">kept</div>', '<p class="market share">kept</p>', '<div class="navy-text">kept</div>', '<div id="promotions-2020">kept</div>',
                                   '<div class="search-theory">kept <a href=/x>on</a> searching</div>', '<p class="advertising-history">kept</p>', '<div class="commentary">kept</div>'])
def test_html_names_of_articles_stay(block):
    page = "<html><body><nav><a href=/>Home</a></nav>%s<footer>f</footer></body></html>"
    for frame in ("<article><h1>T</h1>%s<p>end</p></article>", "<div><h1>T</h1>%s<p>end</p></div>"):
        text = html_extraction.extract(page % (frame % block))
        assert text.startswith("T\n\nkept") and text.endswith("\n\nend")


@pytest.mark.parametrize("block", ['<div class="related"><a href=/x>one</a> <a>two</a></div>', '<div class="ad-box">buy</div>', '<div class="Share"><a>tell</a></div>', '<div id="cookieNotice">we use</div>', '<ul class="comments-list"><li>nice</ul>',
                                   '<div class="site-footer">f</div>', '<div class="newsletter_form">mail</div>', '<section class="main-nav">n</section>', '<div role="search">s</div>', '<div hidden>h</div>', '<aside>a</aside>'])
def test_html_names_of_other_parts_go(block):
    assert html_extraction.extract(f"<html><body><article><h1>T</h1>{block}<p>end</p></article></body></html>") == "T\n\nend"


def test_html_templates_by_count(spark):
    """Which subtrees recur, counted over plain strings of them: by the share of a host's pages, or by many pages whatever the share."""
    block = lambda k: f"<div data-x='{k}'><span>part {k}</span></div>"
    pages = [(h, "<body>" + "".join(block(k) for k in (1, 2, 3, 4) if n % (1, 4, 30, 90)[k - 1] == 0) + f"<article><p>own {n}</p></article></body>") for h, many in (("big.ir", 360), ("small.ir", 30)) for n in range(many)]
    rows = [(k, f"http://{h}/{k}", html) for k, (h, html) in enumerate(pages)]
    got = html_extraction.template_hashes(frame(spark, rows, "page_id long, url string, html string"), min_pages=10, min_share=0.1, many=80).collect()
    counted = Counter((h, k) for h, html in pages for k in (1, 2, 3, 4) if block(k) in html)
    total = Counter(h for h, _ in pages)
    want = sorted((h, n) for (h, k), n in counted.items() if n >= 10 and (n >= 0.1 * total[h] or n >= 80))
    assert sorted((r.host, r.n_pages) for r in got) == want and len(want) == 3
    few = html_extraction.template_hashes(frame(spark, rows, "page_id long, url string, html string"), min_pages=10, min_share=0.9, many=10).collect()
    assert sorted((r.host, r.n_pages) for r in few) == sorted((h, n) for (h, _), n in counted.items() if n >= 10)


def test_html_extraction(spark):
    page = "<html><body><header>Site</header><nav><a href=/a>x</a></nav>{tpl}<main><h1>T &amp; {k}</h1><p>One&nbsp; two<br>{k}<p>same words<aside>s</aside><div class=comments>c</div></main><footer>f</footer>"
    rows = [(k, "http://H.example/x?%d" % k, page.format(k=k, tpl="<div><b>Buy now</b></div>")) for k in range(15)]
    rows += [(20, "http://h.example/z", "<div><b>Buy now</b></div><p>plain <script>no</script>text</p>"), (21, None, None), (22, "", ""), (23, "nope", "<p>a < b &lt; c</p><!-- x -->")]
    got = {r.page_id: r for r in html_extraction.extract_pages(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "T & 3\n\nOne two 3\n\nsame words" and got[20].text == "plain text" and got[21].text == got[22].text == "" and got[23].text == "a < b < c"
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == 19
    far = html_extraction.extract_pages(frame(spark, rows, "page_id long, url string, html string"), most_broadcast=0)
    assert {r.page_id: r.text for r in far.collect()} == {k: r.text for k, r in got.items()}
    assert html_extraction.extract_pages(frame(spark, [], "page_id long, url string, html string")).count() == 0
    assert html_extraction.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf), c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).toPandas()
    ids = duckdb.execute(f"SELECT doc_id FROM '{sf}/documents.parquet'").df().doc_id
    assert set(out.doc_id) <= set(ids) and out.doc_id.is_unique and len(out) > len(ids) / 3
    assert (out.n_chars == out.text.str.len()).all()
    assert all(hashlib.sha256(t.encode()).hexdigest() == s for t, s in zip(out.text, out.decoded_sha256, strict=True))


SF = "/root/testdata/sf0.001"


def stage_rows():
    """Documents with nulls, empty and repeated texts, a long one, shared lines, near copies, and a passage of the benchmark."""
    rnd = random.Random(21)
    items = duckdb.execute(f"SELECT text FROM '{SF}/benchmark.parquet' ORDER BY item_id LIMIT 3").fetchall()
    own = texts(5, 14) + [f"Shared line\nown {k} " + " ".join(rnd.choice(WORDS) for _ in range(20)) for k in range(11)]
    own += ["before it " + items[0][0] + " and after", items[1][0], " ".join(rnd.choice(WORDS) for _ in range(6000))]
    return [(k, t, "en", None if k % 3 else "s", len(t or "")) for k, t in enumerate(own)]


def stage_docs(spark, rows):
    return frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"matches": F.lit(1), "score": F.lit("x"), "n_tokens": F.lit(2), "class_id": F.lit(3), "n_lines": F.lit(4)})


@pytest.mark.parametrize("k", range(5))
def test_stages_against_brute_force(spark, k):
    """Each stage on its own: rows with nulls, repeats and clashing columns, and an empty table; the columns of documents come back."""
    name, stage = corpus_pipeline.STAGES[k]
    rows = stage_rows()
    out = stage(spark, stage_docs(spark, rows), SF)
    assert stage(spark, stage_docs(spark, []), SF).count() == 0
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns[:5] == corpus_pipeline.COLUMNS and (k == 4 or len(out.columns) == 5)
    text_of = {r[0]: r[1] for r in rows}
    if k == 0:
        ranking = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
        scores = ranking.scores(np.array([quality.statistics(t or "") for t in text_of.values()]))
        assert set(got) == {i for i, s in zip(text_of, scores, strict=True) if s >= 0.3} and all(got[i].text == text_of[i] for i in got)
    elif k == 1:
        where = Counter(key for t in text_of.values() for key in set(line_dedup.line_keys(t or "")) if key)
        want = {i: "\n".join(x for x, key in zip((t or "").split("\n"), line_dedup.line_keys(t or ""), strict=True) if not key or where[key] < 10) for i, t in text_of.items()}
        assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
        assert any("Shared line" in (t or "") for t in text_of.values()) and not any("Shared line" in t for t in want.values())
    elif k == 2:
        known = TokenHashes()
        sets = {i: frozenset(shingle_set(t or "", known).tolist()) for i, t in text_of.items()}
        root = {i: i for i in sets}
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and root[a] != root[b]:
                    low, high = sorted((root[a], root[b]))
                    root = {i: low if r == high else r for i, r in root.items()}
        assert set(got) == {i for i, r in root.items() if i == r} and len(got) < len(sets)
    elif k == 3:
        items = duckdb.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
        found = weighted_brute_force([(i, t) for i, t in text_of.items()], items)
        assert set(got) == {i for i, x in found.items() if not x} and len(got) <= len(text_of) - 2
    else:
        encoding = token_lengths.encoding(RANKS, PATTERN)
        assert set(got) == set(text_of)
        for i, t in text_of.items():
            ids = encoding.encode_ordinary(t or "")
            assert (got[i].ids, got[i].n_tokens, got[i].decoded_sha256) == (ids, len(ids), hashlib.sha256((t or "").encode()).hexdigest())


@pytest.mark.parametrize("head", [0, 10_000_000])
def test_byte_bpe_is_the_same_with_any_head(spark, head):
    encoding = token_lengths.encoding(RANKS, PATTERN)
    rows = list(enumerate([*texts(3, 8), "word, word. Naïve; (x) 12th", "a,b c-d e.", "déjà vu!", "x " * 3000]))
    d = frame(spark, rows).withColumns({"n_tokens": F.lit("clash"), "ids": F.lit("clash")})
    out = byte_bpe.encode(d, byte_bpe.vocabulary(d, RANKS, PATTERN, head=head), ["doc_id", "n_tokens", "ids"])
    assert {r.doc_id: r.ids for r in out.collect()} == {k: encoding.encode_ordinary(t or "") for k, t in rows}


def test_sharding_tells_nulls_from_empty_keys(spark):
    rows = spark.createDataFrame([(None, 1), ("", 2), ("a", 3)], "k string, v int")
    assert rows.select(sharding.key_hash("k").alias("h")).distinct().count() == 3
    deep = frame(spark, [(k, "x" * 40) for k in range(3000)])
    got = sharding.shard(deep, ["doc_id"], F.octet_length("text"), 100).collect()
    sums, depth = Counter(), {}
    for r in got:
        sums[r.shard] += r.row_bytes
        depth[r.shard] = r.local_depth
    assert len(got) == 3000 and max(sums.values()) <= 100 and max(depth.values()) > sharding.STEP
    names = sorted(depth)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # a directory of prefixes, none inside another


@pytest.mark.parametrize("batches", [1, 3, 9])
def test_line_dedup_does_not_depend_on_batches(spark, batches):
    rnd = random.Random(batches)
    rows = [(k, "\n".join(f"line {min(rnd.randrange(40), rnd.randrange(40))}" for _ in range(6))) for k in range(80)] + [(k, None) for k in range(80, 83)]
    where = Counter(key for _, t in rows for key in set(line_dedup.line_keys(t or "")) if key)
    got = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, rows), min_docs=10, batches=batches).collect()}
    assert got == {k: "\n".join(x for x in (t or "").split("\n") if not x or where[x.encode()] < 10) for k, t in rows}
    assert 0 < sum(n >= 10 for n in where.values()) < len(where)
