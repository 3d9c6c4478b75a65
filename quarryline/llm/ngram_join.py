"""N-gram Jaccard join by MinHash prefixes of several trees with exact verification.

Every text gets a signature in each of several trees; texts that share a prefix
of it are candidates of each other. The prefix is shortened from the full depth
until the recall at the least similarity reaches the target: one length for
all texts, since every link is to be found, so prefixes are joined by hash
(banding) and no sorted trie is walked. Candidates are verified on their whole
shingle sets.

A node's pairs are never rows. Texts of equal sets are one member. The members of
a node are dealt to chunks by hash; every two chunks meet in a block, which verifies
all its pairs at once and returns a row per member: how many documents it is linked
to, and the smallest id that these links connect it to. A pair is verified in the
first tree in which it shares a node and nowhere else, so the counts add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import TokenHashes, texts, written
from quarryline.llm.minhash import MinHash, digest, shingle_set

#: Words of a shingle, least similarity, least recall at that similarity.
SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.99999
TREES, DEPTH = 32, 8
#: Members and shingles that a chunk of a node has about at most.
MEMBERS, SHINGLES = 256, 500_000


def prefix_length(similarity: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair of this similarity meets in a tree at least as often as the recall asks."""
    k = depth
    while k > 1 and 1 - (1 - similarity**k) ** trees < recall:
        k -= 1
    return k


def signatures(docs: DataFrame, trees: int, depth: int, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, d1, d2, n, nodes): digest and size of the shingle set, and the trie node of the text in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher = TokenHashes(), MinHash(trees, depth)
        salt = np.arange(trees, dtype=np.uint64)
        for batch in batches:
            digests, n, nodes = [], [], []
            for text in texts(batch.column(1)):
                found = shingle_set(text, known, shingle)
                digests.append(digest(found)), n.append(len(found))
                sig = hasher.signature(found)
                with np.errstate(over="ignore"):
                    node = salt.copy()
                    for k in range(depth):
                        node = (node ^ sig[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                        node ^= node >> np.uint64(29)
                nodes.append(node.view(np.int64))
            two = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * trees), pa.array(np.concatenate(nodes) if nodes else np.zeros(0, np.int64)))
            arrays = [batch.column(0), pa.array(np.ascontiguousarray(two[:, 0])), pa.array(np.ascontiguousarray(two[:, 1])), pa.array(n, pa.int64()), flat]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "d1", "d2", "n", "nodes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, n long, nodes array<long>")


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, shingles): the whole set of each text as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenHashes()
        for batch in batches:
            found = [shingle_set(text, known, shingle).view(np.int64) for text in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key as one batch; rows of a key follow each other."""
    open_rows = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = batch.column(key).to_numpy()
            starts[1:] |= values[1:] != values[:-1]
        if open_rows and any(open_rows[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.concat_batches(open_rows)
            open_rows = []
        cuts = [0, *np.flatnonzero(starts).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo:
                yield pa.concat_batches(open_rows)
                open_rows = []
            open_rows.append(batch.slice(lo, hi - lo))
    if open_rows:
        yield pa.concat_batches(open_rows)


def meeting(block: pa.RecordBatch, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of the two chunks of a block, and which pairs of them are settled here.

    That is where they share this node and none of an earlier tree, and their shared shingles can reach ``least``. A chunk that
    meets itself has each pair once.
    """
    tree, chunk = block.column("tree")[0].as_py(), block.column("chunk").to_numpy()
    a, b = np.flatnonzero(chunk == block.column("i")[0].as_py()), np.flatnonzero(chunk == block.column("j")[0].as_py())
    nodes = block.column("nodes").flatten().to_numpy().reshape(block.num_rows, -1)
    n, shared = block.column("n").to_numpy(), block.column("shared").to_numpy()
    both = np.minimum(shared[a][:, None], shared[b])
    here = (both >= least * (n[a][:, None] + n[b] - both) - 1e-6) & (nodes[a, tree][:, None] == nodes[b, tree])
    if block.column("i")[0] == block.column("j")[0]:
        here &= a[:, None] < b
    for k in range(tree):
        here &= nodes[a, k][:, None] != nodes[b, k]
    return a, b, here


def linked_pairs(block: pa.RecordBatch, a: np.ndarray, b: np.ndarray, here: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs ``here`` have a Jaccard similarity of ``least`` or more, on whole sets."""
    lists = block.column("shingles")
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    values, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    n, marked = np.diff(ends), np.zeros(len(values), np.int32)
    out = np.zeros_like(here)
    for x in np.flatnonzero(here.any(axis=1)):
        own, others = codes[ends[a[x]] : ends[a[x] + 1]], np.flatnonzero(here[x])
        marked[own] = 1
        if len(others) * 8 < len(b):
            both = np.array([marked[codes[ends[k] : ends[k + 1]]].sum() for k in b[others]])
        else:
            both = np.add.reduceat(marked[codes], ends[:-1])[b[others]]
        marked[own] = 0
        out[x, others] = both >= least * (n[a[x]] + n[b[others]] - both)
    return out


def links(reps: DataFrame, docs: DataFrame, least: float, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, linked, root) of the verified links between ``reps(doc_id, n_copies, nodes)``, in parts.

    linked: documents of the texts that a part links this one to; a link is in one part, so they add up. root: the smallest id
    that the links of a part connect this one to.
    """
    placed = reps.select("doc_id", F.posexplode("nodes").alias("tree", "key")).select("doc_id", "tree", F.xxhash64("tree", "key").alias("node"))
    sizes = placed.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    members = written(placed.join(sizes.select("node"), "node"), "members")
    sets = written(shingle_sets(docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), shingle), "sets")
    # shingles of a single document can't be shared: they bound what a pair can reach, before it is made
    once = sets.select("doc_id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("k"), F.min("doc_id").alias("doc_id")).where("k = 1")
    alone = once.groupBy("doc_id").agg(F.count("*").alias("alone"))
    sized = sets.select("doc_id", F.size("shingles").alias("n")).join(alone, "doc_id", "left").select("doc_id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))
    able = written(reps.join(sized.where(F.col("shared") >= least * F.col("n")), "doc_id"), "able")
    # a node's members are dealt to chunks, and every two chunks meet in a block, so that no task has more than two chunks at once
    members = members.join(able.select("doc_id", "n"), "doc_id")
    parts = F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / SHINGLES)).cast("int")
    members = members.join(members.groupBy("node").agg(F.count("*").alias("size"), parts.alias("parts")).where("size > 1").drop("size"), "node")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    blocks = members.select("node", "tree", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "doc_id")
    key = ["node", "i", "j"]

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in grouped(batches, key):
            if block.num_rows > 1:
                a, b, here = meeting(block, least)
                found = np.union1d(a[here.any(axis=1)], b[here.any(axis=0)])
                if len(found):
                    yield block.select([*key, "tree", "chunk", "doc_id"]).take(pa.array(found))

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in grouped(batches, key):
            a, b, here = meeting(block, least)
            found = linked_pairs(block, a, b, here, least)
            ids, copies = block.column("doc_id").to_numpy(), block.column("n_copies").to_numpy()
            linked, root, was = np.zeros(len(ids), np.int64), ids.copy(), None
            linked[a] += found @ copies[b]
            linked[b] += copies[a] @ found
            while not np.array_equal(root, was):
                was, top = root.copy(), np.iinfo(np.int64).max
                root[a] = np.minimum(root[a], np.where(found, root[b], top).min(axis=1))
                root[b] = np.minimum(root[b], np.where(found, root[a][:, None], top).min(axis=0))
            some = linked > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(linked[some]), pa.array(root[some])], ["doc_id", "linked", "root"])

    # sets go only where a pair is verified: most pairs share nodes of several trees
    met = blocks.join(able.select("doc_id", "n", "shared", "nodes"), "doc_id").repartition(*key).sortWithinPartitions(*key)
    met = written(met.mapInArrow(active, "node long, i int, j int, tree int, chunk int, doc_id long"), "blocks")
    whole = met.join(able, "doc_id").join(sets, "doc_id").repartition(*key).sortWithinPartitions(*key)
    return written(whole.mapInArrow(settled, "doc_id long, linked long, root long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, class_id): the smallest id that each id of ``edges(a, b)`` is connected to, by alternating large and small stars.

    Every round writes its edges, so lineage stays short; the rounds grow with the logarithm of the longest path.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "stars")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "stars")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m").unionByName(low.select(F.col("a").alias("x"), "m"))
        edges = written(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("class_id")).unionByName(edges.select(F.col("b").alias("doc_id"), F.col("b").alias("class_id")).distinct())
        state = now


def classes(docs: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE, recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) for each row of ``docs(doc_id, text)``; doc_id is unique and not null.

    class_id: the smallest id of the documents that links of at least ``least`` connect it to. n_copies: documents of the same
    shingle set, itself included. n_links: other documents that it is linked to, its copies and all those that a verified link
    joins it to. Texts without a word (null, empty, punctuation) are in classes of their own, texts shorter than a shingle are
    linked to those of the same words.
    """
    k = prefix_length(least, recall, trees)
    sigs = written(signatures(docs, trees, k, shingle), "signatures")
    groups = written(sigs.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "groups")
    reps = sigs.select("doc_id", "nodes").join(groups.select(F.col("rep").alias("doc_id"), "n_copies"), "doc_id")
    found = links(reps, docs.select("doc_id", "text"), least, shingle)
    roots = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("doc_id").agg(F.sum("linked").alias("linked"))
    known = groups.select("d1", "d2", F.col("rep").alias("doc_id"), "n_copies").join(roots, "doc_id", "left").join(linked, "doc_id", "left").select(
        "d1", "d2", F.coalesce("class_id", "doc_id").alias("class_id"), (F.col("n_copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "n_copies"
    )
    # texts without a word get keys of their own, so that they don't meet in one task
    known = written(known, "classes")
    words = sigs.where("n > 0").select("doc_id", "d1", "d2").join(known, ["d1", "d2"]).select("doc_id", "class_id", "n_links", "n_copies")
    return words.unionByName(sigs.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")))
