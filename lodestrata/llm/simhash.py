"""Near-duplicates by SimHash, found with Golay-code fuzzy hashing.

A fingerprint has 64 bits. Two that differ in at most three of them agree wholly on one of four
16-bit blocks (three errors cannot touch four). The other 48 bits are two 24-bit halves, one of
which has at most one error. Its first 23 bits are decoded with the perfect binary Golay code: a
word within distance two of its codeword gets that codeword's 12-bit index; a word at distance
three also gets the indices of the five codewords at distance four. Any two 23-bit words at
distance one then share an index. So every linked pair shares a key (block, its value, half,
index), and a join on keys followed by counting differing bits finds all links.

Only different fingerprints are joined; exact copies meet in one class. Keys held by many
fingerprints are cut into blocks of fingerprints whose pairs are compared block by block, and every
task gives back a spanning forest of the links it finds, never all pairs.

Defined results: a null or blank text has fingerprint zero, linked like any other; rows that share
an id are separate rows of the same id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, key_runs, materialize
from .components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: A key with more fingerprints than this is compared in blocks of half as many.
WIDE = 4096
#: Hashes whose bits are counted at a time.
STEP = 1 << 16

#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


# ---- fingerprints


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles; zero if it has no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends, at = [], 0
    for w in words:
        ends.append(at + len(w))
        at += len(w) + 1
    starts = [0, *(e + 1 for e in ends)]
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for first in range(0, n, STEP):
        last = min(n, first + STEP)
        hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[first:last], ends[first + shingle - 1:last + shingle - 1], strict=True)], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fingerprints as signed 64-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---- Golay keys


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator: zero for codewords, else what the error leaves."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of weight three or less (there is exactly one, the code being perfect)
    with its weight; and, where that weight is three, the five errors of weight four."""
    single = _syndromes(1 << np.arange(23, dtype=np.int64))
    nearest, weight, far = np.zeros(1 << 11, np.int64), np.zeros(1 << 11, np.int64), [[] for _ in range(1 << 11)]
    for k in range(1, 5):
        for bits in combinations(range(23), k):
            syndrome = int(np.bitwise_xor.reduce(single[list(bits)]))
            error = sum(1 << b for b in bits)
            if k < 4:
                nearest[syndrome], weight[syndrome] = error, k
            elif weight[syndrome] == 3:
                far[syndrome].append(error)
    return np.stack([nearest, weight]), np.array([x or [0] * 5 for x in far], np.int64)


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six codeword indices of each 23-bit word, and which of them count: the first always, the
    others where the word is at distance three from its codeword."""
    (nearest, weight), far = golay()
    s = _syndromes(words)
    errors = np.concatenate([nearest[s][:, None], far[s]], axis=1)
    counts = np.concatenate([np.ones((len(words), 1), bool), np.repeat((weight[s] == 3)[:, None], 5, axis=1)], axis=1)
    return (words[:, None] ^ errors) >> 11, counts


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``fps``, key) for all keys of unsigned fingerprints."""
    rows, keys = [], []
    for block in range(4):
        value = (fps >> np.uint64(48 - 16 * block) & np.uint64(0xFFFF)).astype(np.int64)
        others = [b for b in range(4) if b != block]
        rest = np.zeros(len(fps), np.int64)
        for b in others:
            rest = rest << 16 | (fps >> np.uint64(48 - 16 * b) & np.uint64(0xFFFF)).astype(np.int64)
        for half in range(2):
            word = (rest >> (24 * half) & 0xFFFFFF) >> 1
            index, counts = indices(word)
            key = ((block << 1 | half) << 28) | value[:, None] << 12 | index
            r, c = np.nonzero(counts)
            rows.append(r)
            keys.append(key[r, c])
    return np.concatenate(rows), np.concatenate(keys)


# ---- links


def _forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Join the ends of links in a parent array whose entries are roots."""
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _linked(table: pa.Table, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among rows that share a key; rows come sorted by key."""
    key = table.column("key").to_numpy()
    fp = table.column("fp").to_numpy().view(np.uint64)
    nodes, node = np.unique(fp, return_inverse=True)
    parent = np.arange(len(nodes))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(key)))
    left = np.repeat(size - 1, size) - (np.arange(len(key)) - np.repeat(begin, size))  # rows of the run that follow
    live = np.flatnonzero(left >= 1)
    step = 1
    while len(live):
        near = np.bitwise_count(fp[live] ^ fp[live + step]) <= distance
        parent = _forest(len(nodes), node[live[near]], node[live[near] + step], parent)
        step += 1
        live = live[left[live] >= step]
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child].view(np.int64), nodes[parent[child]].view(np.int64)


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links whose components are those of all pairs of fingerprints (column ``fp``, each
    once) that differ in at most ``distance`` (3 or fewer) bits."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for first in range(0, len(values), 1 << 14):
                some = values[first:first + (1 << 14)]
                rows, keys = keys_of(some)
                yield pa.record_batch({"key": pa.array(keys), "fp": pa.array(some[rows].view(np.int64))})

    keys = fps.select("fp").mapInArrow(emit, "key long, fp long")
    wide = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n > {WIDE}"), "wide-keys")
    if not wide.isEmpty():
        # a block per WIDE/2 fingerprints; each pair of blocks is a part that holds both, told apart above the key's 31 bits
        blocks = F.ceil(F.col("n") * 2 / WIDE)
        mine = F.pmod(F.xxhash64("fp"), blocks)
        parts = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.shiftleft(F.least(mine, j) * blocks + F.greatest(mine, j), 32))
        part = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(parts)).alias("part")
        keys = keys.join(wide, "key", "left").select("key", "fp", part).select(F.col("key").bitwiseOR(F.col("part")).alias("key"), "fp")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, STEP):
            a, b = _linked(table, distance)
            yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a long, b long")


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest id that links lead to."""
    marked = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(links(classes, distance)).select(F.col("node").alias("fp"), "root")
    met = classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = met.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(met.join(least, "root").select("fp", "component_id"), "simhash-components")
    discard(classes)
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
