"""Prefix trie of conversations that are rebuilt within families, merged family by family first.

A family is the conversations of one base id, ``conv_id - conv_id % FAMILY``. Conversation c is rebuilt as the
base's first h turns (h is the unsigned crc32 of the decimal c, modulo ``HEADS``; all, if the base
has fewer) and then its own turns after its own first h. A node of the trie is a distinct sequence of the
first d turns (role and text) of rebuilt conversations, its members are those that begin with it.

1. Turns shrink to a digest and a number of words before anything moves. A family's turns then meet
   in one partition, base first: a task keeps the base's first turns, goes through the other
   conversations in order, and names every prefix by a digest chained over its turns.
2. It gathers the nodes of a family in memory (flushing at ``HELD`` of them) and sends on combined family
   nodes only; a grouping by name merges families, adding up partial sums before they move.
3. A node belongs to its smallest member. What a conversation owns is the tail of its path, as the members
   of a node below are among those above. So the sum over a node's subtree is what all its members own,
   less what its owner has above it: a second round of family nodes, with what each conversation owns as its
   weight, and a running sum along each owner's nodes give all subtrees at once, however deep.

Parents with over ``HOT`` children go to their children by broadcast, if a count shows them to be
few, so that no parent's children meet in one task. Ids of the conversations that end at a node are joined in
blocks of ids before they meet in order.

Turns are ordered by number, null first, and those of one number by the digest of role and text. Defined
results: null roles and texts are empty; rows without a conv_id belong to no conversation and take no part;
given twice, a turn is there twice; a base of which there are no rows has no turns; other columns are
ignored; an empty table has no conversation, thus no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialize

FAMILY = 20
HEADS = 4
#: Nodes that a task holds before it sends them on.
HELD = 1 << 16
#: Children of a hot parent, and how many hot parents are broadcast at most.
HOT = 10_000
BROADCAST_PARENTS = 200_000
#: Ids that agree but for so many bits are joined to one text.
ID_BLOCK_BITS = 14

ROOT = bytes(16)
_NODES = "node binary, parent binary, depth bigint, words bigint, conv bigint, n bigint, owned bigint, leaves bigint, ends array<bigint>"
_ARROW = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("conv", pa.int64()), ("n", pa.int64()), ("owned", pa.int64()), ("leaves", pa.int64()), ("ends", pa.list_(pa.int64()))])


def _turns(conversations: DataFrame) -> DataFrame:
    """Every turn as its digest and number of words, with what decides how its conversation is rebuilt."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    conv = F.col("conv_id").cast("long")
    digest = F.sha2(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")).cast("binary"), 256)
    return conversations.where(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("base"), conv.alias("conv"), F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(digest, 1, 32)).alias("digest"),
        F.size(F.regexp_extract_all(text("text"), F.lit(WORD), F.lit(0))).cast("long").alias("words"), (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int").alias("heads"))


class _Family:
    """The nodes of the families that a task has gone through since it last sent nodes on."""

    def __init__(self) -> None:
        self.nodes: dict[bytes, list] = {}

    def add(self, node: bytes, parent: bytes | None, depth: int, words: int, conv: int, owned: int, leaves: int) -> None:
        known = self.nodes.get(node)
        if known is None:
            self.nodes[node] = [parent, depth, words, conv, 1, owned, leaves, []]
        else:
            known[3] = min(known[3], conv)
            known[4] += 1
            known[5] += owned
            known[6] += leaves

    def end(self, node: bytes, conv: int) -> None:
        self.nodes[node][7].append(conv)

    def sent(self) -> pa.RecordBatch:
        columns = [list(self.nodes), *map(list, zip(*self.nodes.values(), strict=True))]
        self.nodes = {}
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _family_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by base, conversation (the base itself first, ``own`` 0) and turn, each conversation
    after a row of place -1 that holds its weights."""
    family = _Family()
    base = None
    heads: list[tuple[bytes, int]] = []  # the base's first turns, HEADS - 1 at most
    conv, node, depth, owned, leaves, skip = None, ROOT, 0, 0, 0, 0

    def grown(digest: bytes, words: int) -> None:
        nonlocal node, depth
        child = hashlib.blake2b(node + digest, digest_size=16).digest()
        depth += 1
        family.add(child, node, depth, words, conv, owned, leaves)
        node = child

    for batch in batches:
        for b, c, place, digest, words, h, own, leaf in zip(*(batch.column(n).to_pylist() for n in ("base", "conv", "place", "digest", "words", "heads", "owned", "leaves")), strict=True):
            if place < 0:  # a conversation begins, and the one before ends
                if conv is not None:
                    family.end(node, conv)
                    if len(family.nodes) >= HELD:
                        yield family.sent()
                if b != base:
                    base, heads = b, []
                conv, node, depth, owned, leaves, skip = c, ROOT, 0, own, leaf, h
                family.add(ROOT, None, 0, 0, c, owned, leaves)
                if c != b:
                    for turn in heads[:h]:
                        grown(*turn)
                continue
            if c == base:
                if len(heads) < HEADS - 1:
                    heads.append((digest, words))
                grown(digest, words)
            elif skip:
                skip -= 1
            else:
                grown(digest, words)
            if len(family.nodes) >= HELD:
                yield family.sent()
                family.nodes[node] = [None, depth, 0, conv, 0, 0, 0, []]  # its conversation may end here
    if conv is not None:
        family.end(node, conv)
        yield family.sent()


def _merged_families(turns: DataFrame, weights: DataFrame | None) -> DataFrame:
    """The nodes of all families, before they are merged. ``weights``: (conv, owned, leaves)."""
    zero = F.lit(0).cast("long")
    if weights is None:
        weights = turns.groupBy("base", "conv", "heads").agg(zero.alias("owned"), zero.alias("leaves"))
    rows = turns.withColumn("place", F.lit(0)).unionByName(weights.withColumn("place", F.lit(-1)), allowMissingColumns=True)
    other = F.col("conv") != F.col("base")
    dealt = rows.repartition("base").sortWithinPartitions("base", other, "conv", "place", "turn", "digest")
    return dealt.select("base", "conv", "place", "digest", "words", "heads", "owned", "leaves").mapInArrow(_family_nodes, _NODES)


def _ends(partial: DataFrame) -> DataFrame:
    """(node, ends_sha256) where conversations end: the digest of their ids in order, comma-joined."""
    ids = partial.select("node", F.explode("ends").alias("id"))
    blocks = ids.groupBy("node", F.shiftright("id", ID_BLOCK_BITS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed = None, None
        shape = ["node", "ends_sha256"]
        for batch in batches:
            done = []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node != now:
                    if hashed is not None:
                        done.append((now, hashed.hexdigest()))
                    now, hashed = node, hashlib.sha256()
                else:
                    hashed.update(b",")
                hashed.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], shape)
        if hashed is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([hashed.hexdigest()])], shape)

    return blocks.repartition("node").sortWithinPartitions("node", "block").mapInArrow(run, "node binary, ends_sha256 string")


def _parents_named(tops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, parent_conv) for nodes whose parent belongs to another conversation."""
    names = nodes.select(F.col("node").alias("__p"), F.col("conv").alias("parent_conv"))
    counted = materialize(tops.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "trie-hot")
    if counted.isEmpty() or counted.count() > BROADCAST_PARENTS:
        return tops.join(names, F.col("parent") == F.col("__p")).select("node", "parent_conv")
    hot = F.broadcast(materialize(names.join(counted, F.col("__p") == F.col("parent"), "left_semi"), "trie-hot-names"))
    apart = materialize(tops.join(hot, F.col("parent") == F.col("__p"), "left").drop("__p"), "trie-tops")
    rest = apart.where("parent_conv is null").drop("parent_conv").join(names, F.col("parent") == F.col("__p")).select("node", "parent_conv")
    return apart.where("parent_conv is not null").select("node", "parent_conv").union(rest)


def build(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node,
    parent): a row for each node; ``node`` is the digest that names it, the root's is all zeros."""
    turns = materialize(_turns(conversations), "trie-turns")
    partial = materialize(_merged_families(turns, None), "trie-families")
    merged = materialize(partial.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.min("conv").alias("conv"), F.sum("n").alias("n")), "trie-merged")
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(merged.join(children, "node", "left").fillna({"n_children": 0}).withColumn("gain", (F.col("n") - 1) * F.col("words")), "trie-nodes")
    discard(merged)

    owned = nodes.groupBy("conv").agg(F.sum("gain").alias("owned"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    everyone = turns.groupBy("base", "conv", "heads").agg(F.lit(1).alias("one")).drop("one")
    weights = everyone.join(owned, "conv", "left").fillna({"owned": 0, "leaves": 0})
    sums = _merged_families(turns, weights).groupBy("node").agg(F.sum("owned").alias("owned"), F.sum("leaves").alias("n_leaves"))

    along = Window.partitionBy("conv").orderBy("depth")
    chains = materialize(nodes.withColumn("above", F.coalesce(F.sum("gain").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("place", F.row_number().over(along)), "trie-chains")
    named = _parents_named(chains.where("place = 1 and depth > 0").select("node", "parent"), nodes)
    parts = [chains.select("node", "parent", "depth", "conv", "n", "n_children", "above", "place"), sums, _ends(partial), named]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more, allowMissingColumns=True)
    once = both.groupBy("node").agg(*[F.max(c).alias(c) for c in both.columns if c != "node"])
    parent_conv = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("place") > 1, F.col("conv")).otherwise(F.col("parent_conv"))
    return once.select(
        F.col("conv").alias("conv_id"), "depth", parent_conv.cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", (F.col("owned") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "node", "parent")
