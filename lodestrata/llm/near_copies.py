"""Near-duplicates by similarity: SimHash over distinct shingles, Golay-code fuzzy hashing, wide enough
to find texts that share four fifths of their five-word shingles.

At a Jaccard similarity J of equally long texts, SimHash bits differ with probability
``acos(2J / (1 + J)) / pi``: 0.15 at J = 0.8, about ten bits of 64. Three bits, which ``simhash`` finds
without fail, are far too few for that, so a text gets two fingerprints of 256 bits here:

* that of its pairs of words, which an edit disturbs less, gives the keys. Each of its sixteen 16-bit
  blocks is paired with the codeword indices of the 23 bits that follow (see ``simhash.indices``), which
  agree where those differ in one bit and often where they differ in two or three;
* that of its five-word shingles decides: texts link if it differs in at most ``DISTANCE`` bits. 39 are
  expected at J = 0.8, with a deviation of 6; 48 hold nineteen of twenty such pairs.

A link can be missed where no key agrees, and a pair somewhat below 0.8 can link; README.md has the
measured recall. Only different fingerprints are joined, keys held by many are compared in pairs of
blocks, and tasks give back spanning forests, as in ``simhash``.

Defined results of ``keep_first``: of each group the row with the smallest id stays, of rows with one id
the one whose text has the smallest digest, and of equal rows one; a null id comes after all others. A
text with fewer words than a shingle is one shingle; null and blank texts are one group. Other columns
are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, key_runs, materialize, text_groups, whole_rows
from .components import components
from .simhash import STEP, WIDE, _forest, indices

SHINGLE = 5
KEY_SHINGLE = 2
DISTANCE = 48
#: 64-bit lanes of a fingerprint; a lane has four 16-bit blocks, each of which makes a table of keys.
LANES = 4
SEED = 42
#: Words whose hashes a worker remembers before it starts anew.
WORDS = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STARTS = np.arange(1, LANES + 1, dtype=np.uint64) * _ODD


# ---- fingerprints


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: a bijection whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` words, given the words' hashes; of all words if fewer."""
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = _mixed(h * _ODD + words[j:j + n])
    return np.unique(h)


def fingerprint(hashes: np.ndarray) -> bytes:
    """256 bits; one is set if it is in over half of the hashes, all of them stretched to 256 bits."""
    counts = np.zeros(64 * LANES, np.int64)
    for first in range(0, len(hashes), STEP):
        some = hashes[first:first + STEP]
        lanes = _mixed(some[:, None] + _STARTS).astype(">u8")
        counts += np.unpackbits(lanes.view(np.uint8).reshape(len(some), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, near, key): a row's id and MD5 of its text, and both fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch, texts in text_groups(batches, 2):
            near, key = [], []
            for text in texts:
                words = (text or b"").lower().split()
                if len(known) > WORDS:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = xxhash.xxh64_intdigest(w, SEED)
                hashes = np.fromiter((known[w] for w in words), np.uint64, len(words))
                near.append(fingerprint(shingles(hashes, SHINGLE)) if words else bytes(8 * LANES))
                key.append(fingerprint(shingles(hashes, KEY_SHINGLE)) if words else bytes(8 * LANES))
            yield pa.record_batch({"doc_id": batch.column(0), "digest": batch.column(1), "near": pa.array(near, pa.binary()), "key": pa.array(key, pa.binary())})

    text = F.col(text_col)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"), text.alias("text")).mapInArrow(
        run, "doc_id long, digest string, near binary, key binary")


# ---- links


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``fps``, key) for all keys of fingerprints of ``LANES`` unsigned numbers."""
    tables = 4 * LANES
    blocks = np.stack([(fps[:, t // 4] >> np.uint64(48 - 16 * (t % 4)) & np.uint64(0xFFFF)).astype(np.int64) for t in range(tables)], axis=1)
    rows, keys = [], []
    for t in range(tables):
        word = (blocks[:, (t + 1) % tables] << 7) | (blocks[:, (t + 2) % tables] >> 9)
        index, counts = indices(word)
        r, c = np.nonzero(counts)
        rows.append(r)
        keys.append(t << 28 | blocks[r, t] << 12 | index[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _lanes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, LANES)


def _linked(key: np.ndarray, node: np.ndarray, fp: np.ndarray, distance: int) -> pa.RecordBatch:
    """A spanning forest of the links among rows that share a key; rows come sorted by key."""
    nodes, at = np.unique(node, return_inverse=True)
    parent = np.arange(len(nodes))
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    left = np.repeat(begin + size, size) - np.arange(len(key)) - 1  # rows of the run that follow
    live, step = np.flatnonzero(left >= 1), 1
    while len(live):
        near = live[np.bitwise_count(fp[live] ^ fp[live + step]).sum(1) <= distance]
        parent = _forest(len(nodes), at[near], at[near + step], parent)
        step += 1
        live = live[left[live] >= step]
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return pa.record_batch({"a": pa.array(nodes[child]), "b": pa.array(nodes[parent[child]])})


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between the nodes of ``classes`` (node, near, key), where a key is shared."""
    names = [f"n{k}" for k in range(LANES)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, near, fps = batch.column(0).to_numpy(), _lanes(batch.column(1)).view(np.int64), _lanes(batch.column(2))
            rows, keys = keys_of(fps)
            for first in range(0, len(rows), STEP):
                r = rows[first:first + STEP]
                yield pa.record_batch({"key": pa.array(keys[first:first + STEP]), "node": pa.array(node[r])} | {name: pa.array(near[r, k]) for k, name in enumerate(names)})

    keys = classes.select("node", "near", "key").mapInArrow(emit, "key long, node long, " + ", ".join(f"{n} long" for n in names))
    wide = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n > {WIDE}"), "wide-keys")
    if not wide.isEmpty():
        # a block per WIDE/2 rows; each pair of blocks is a part that holds both, told apart above the key's 32 bits
        blocks = F.ceil(F.col("n") * 2 / WIDE)
        mine = F.pmod(F.xxhash64("node"), blocks)
        parts = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.shiftleft(F.least(mine, j) * blocks + F.greatest(mine, j), 32))
        part = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(parts)).alias("part")
        keys = keys.join(wide, "key", "left").select("key", "node", *names, part).withColumn("key", F.col("key").bitwiseOR(F.col("part"))).drop("part")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, STEP):
            fp = np.stack([table.column(n).to_numpy() for n in names], axis=1).view(np.uint64)
            yield _linked(table.column("key").to_numpy(), table.column("node").to_numpy(), fp, distance)

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a long, b long")


# ---- groups


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, digest, root): rows with one root are one group. A digest is the MD5 of the row's text."""
    marked = materialize(fingerprints(docs, id_col, text_col), "near-marked")
    # 64 bits of a hash name a class; were two ever to meet, their groups would become one
    node = F.xxhash64("near", "key")
    classes = materialize(marked.groupBy("near", "key").agg(F.count(F.lit(1)).alias("n")).select(node.alias("node"), "near", "key"), "near-classes")
    roots = components(links(classes, distance))
    discard(classes)
    return marked.select("doc_id", "digest", node.alias("node")).join(roots, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each group."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    first = groups(docs, id_col, text_col, distance).groupBy("root").agg(F.min(order).alias("f")).select(F.col("f.doc_id").alias("__i"), F.col("f.digest").alias("__d"))
    rows = whole_rows(docs, __id=docs[id_col].cast("long"), __digest=F.md5(F.coalesce(docs[text_col], F.lit(""))))
    once = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__digest").orderBy("__digest"))).where("__n = 1")
    kept = once.join(first, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__digest") == F.col("__d")), "left_semi")
    return kept.select("__row.*")
