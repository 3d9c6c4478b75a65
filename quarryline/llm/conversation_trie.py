"""A trie of conversation prefixes, merged family by family.

Conversations of one base id share their first turns, so each family is
cogrouped with the turns of its base, rebuilt and made a small trie first. A
node is named by a chained hash of its turns, so nodes of all families meet by
name, and only the families' nodes are shuffled, once to merge them and once
to add up what lies below them: every merged node is settled by the family of
its smallest member, which has all nodes above it.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import written
from quarryline.operators.joins import looked_up

#: Conversations of a family, and turns that a conversation takes over from its base are fewer than this.
FAMILY, HEADS = 20, 4
#: Families whose ids are put together before the ids of a node are hashed.
CHUNK = 1024
ROOT = bytes(16)
_NODES = pa.schema([
    ("base", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("ends", pa.list_(pa.int64())),
])
_SUMS = pa.schema([("node", pa.binary()), ("saved_tokens", pa.int64()), ("n_leaves", pa.int64())])


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def heads(conv_id: int) -> int:
    """How many turns a conversation takes over from its base."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def turns(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, turn, digest, words): a turn's role and text as 16 bytes, and the text's words. Rows of null conv_id are left out."""
    said = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *said)
    role, text = F.col("role"), F.col("text")
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    return rows.select(base_of(F.col("conv_id")).alias("base"), "conv_id", "turn", digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def _ordered(rows: pa.Table) -> dict[int, list[tuple]]:
    """Turns by conversation, each in order: null turns first, then by number, equal numbers by digest."""
    out: dict[int, list[tuple]] = {}
    for conv, turn, digest, words in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "turn", "digest", "words")), strict=True):
        out.setdefault(conv, []).append((turn is not None, turn or 0, digest, words))
    return out


def family_trie(own: pa.Table, base: pa.Table) -> pa.Table:
    """The nodes of one family: its conversations rebuilt, and what each prefix of them has there."""
    head = [t[2:] for found in _ordered(base).values() for t in heapq.nsmallest(HEADS - 1, found)]
    key, nodes = own.column("base")[0].as_py(), {}
    for conv, found in sorted(_ordered(own).items()):
        h = heads(conv)
        node, parent, words = ROOT, None, 0
        path = head[:h] + [t[2:] for t in sorted(found)[h:]]
        for depth in range(len(path) + 1):
            if depth:
                digest, words = path[depth - 1]
                parent, node = node, hashlib.blake2b(node + digest, digest_size=16).digest()
            got = nodes.setdefault(node, {"base": key, "node": node, "parent": parent, "depth": depth, "words": words, "conv_id": conv, "n_convs": 0, "ends": []})
            got["n_convs"] += 1
        nodes[node]["ends"].append(conv)
    return pa.Table.from_pylist(list(nodes.values()), schema=_NODES)


def family_sums(family: pa.Table, settled: pa.Table) -> pa.Table:
    """What the nodes settled by one family add to each node above them, and to themselves."""
    own = {r["node"]: (r["saved"], r["leaf"]) for r in settled.to_pylist()}
    rows = sorted(zip(*(family.column(c).to_pylist() for c in ("depth", "node", "parent")), strict=True), key=lambda r: -r[0])
    sums: dict[bytes, list[int]] = {}
    for _, node, parent in rows:
        saved, leaf = own.get(node, (0, 0))
        mine = sums.setdefault(node, [0, 0])
        mine[0] += saved
        mine[1] += leaf
        if parent is not None and any(mine):
            above = sums.setdefault(parent, [0, 0])
            above[0] += mine[0]
            above[1] += mine[1]
    found = [(k, *v) for k, v in sums.items() if any(v)]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True) if found else ([], [], []), _SUMS, strict=True)], schema=_SUMS)


def end_hashes(families: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end: the hash of their ids, ascending, with commas between.

    Ids of a node are put together by families first, in chunks of bounded size, and the chunks of a node pass a hash in order, so a
    node where a third of all conversations end costs memory for one chunk only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    rows = families.where(F.size("ends") > 0).select("node", "base", "ends", F.floor(F.col("base") / (FAMILY * CHUNK)).alias("chunk"))
    inside = F.array_sort(F.flatten(F.collect_list("ends")))
    chunks = rows.groupBy("node", "chunk").agg(F.array_join(F.transform(inside, lambda x: x.cast("string")), ",").alias("ids"))
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations ``conversations(conv_id, turn, role, text)``; columns as the registered query returns.

    Null roles and texts are empty, null turns come first, turns of one number are ordered by a hash of role and text and
    repeated rows are turns of their own; rows of null conv_id and other columns are left out; an empty table has no node. A
    conversation is taken as a unit: a family's turns are in one task as 16 bytes and a few numbers each, never their texts.
    """
    rows = turns(conversations)
    bases = rows.where("conv_id = base")
    families = written(
        rows.groupBy("base").cogroup(bases.groupBy("base")).applyInArrow(
            family_trie, "base long, node binary, parent binary, depth long, words long, conv_id long, n_convs long, ends array<long>"
        ), "families",
    )
    merged = written(
        families.groupBy("node").agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        ), "merged",
    )
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(merged.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    settled = nodes.select(
        base_of(F.col("conv_id")).alias("base"), "node", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"),
    ).where("saved > 0 or leaf > 0")
    below = families.select("base", "node", "parent", "depth").groupBy("base").cogroup(settled.groupBy("base")).applyInArrow(family_sums, "node binary, saved_tokens long, n_leaves long")
    below = below.groupBy("node").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))

    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("below"))
    with_parent = looked_up(nodes.where("parent is not null"), parents, "parent", "below")
    top = nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = with_parent.select(top.columns).unionByName(top).join(below, "node").join(end_hashes(families), "node", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        "node", "parent",
    )
