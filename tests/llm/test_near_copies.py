"""Near-duplicates by similarity, against plain fingerprints, all pairs and exact similarities."""

import hashlib
import itertools

import numpy as np
import pytest
import xxhash

from lodestrata.llm import components, near_copies

from .test_operators import EDGES, WORD, lower, plain_components

ONES = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ONES
    x = (x ^ x >> 27) * 0x94D049BB133111EB & ONES
    return x ^ x >> 31


def plain_fingerprint(text, size=5):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(lower(text or ""))]
    if not words:
        return 0
    found = set()
    for i in range(max(1, len(words) - size + 1)):
        h = 0
        for w in words[i:i + size]:
            h = mixed((h * ODD + w) & ONES)
        found.add(h)
    counts = [0] * 256
    for h in found:
        for lane in range(4):
            for bit, c in enumerate(format(mixed((h + ODD * (lane + 1)) & ONES), "064b")):
                counts[64 * lane + bit] += c == "1"
    return int("".join("1" if 2 * c > len(found) else "0" for c in counts), 2)


def plain_groups(texts):
    fps = [plain_fingerprint(t) for t in texts]
    return plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 48)


def similarity(a, b):
    a, b = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def plain_kept(rows):
    """Indices of the rows that stay."""
    best = {}
    for n, ((i, t), g) in enumerate(zip(rows, plain_groups([t for _, t in rows]), strict=True)):
        order = (i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest())
        if g not in best or order < best[g][0]:
            best[g] = (order, n)
    return {n for _, n in best.values()}


def test_fingerprints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in near_copies.fingerprints(docs, "doc_id", "text").collect():
        assert int.from_bytes(r.near, "big") == plain_fingerprint(texts[r.doc_id])
        assert int.from_bytes(r.key, "big") == plain_fingerprint(texts[r.doc_id], 2)


def similar_pairs(texts):
    """Pairs that share four fifths of their five-word shingles."""
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (WORD.findall(lower(t or "")) for t in texts)]
    return [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def test_rows_against_all_pairs(spark, sf_dir):
    """A row goes only if all pairs of fingerprints say so too (the smallest of a group always
    stays), and of the pairs at 0.8 or more nine in ten are broken up."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns
    stay = {r.doc_id for r in kept.collect()}
    assert {rows[n][0] for n in plain_kept(rows)} <= stay and len(stay) == kept.count()
    pairs = similar_pairs([t for _, t in rows])
    both = sum(rows[a][0] in stay and rows[b][0] in stay for a, b in pairs)
    assert len(pairs) > 10 and both <= 0.1 * len(pairs)


def test_edges(spark):
    """Null, blank and long texts, null and repeated ids, repeated rows, one id with two texts."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [*EDGES, (20, text), (21, text), (21, "something else that is in no other row"), (21, "something else that is in no other row")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, digest int").repartition(3)
    got = near_copies.keep_first(df).collect()
    same = {(rows[n][0], rows[n][1] or "") for n in plain_kept(rows)}
    assert len(got) == len(same) and {(r.doc_id, r.text or "") for r in got} == same
    assert (20, text) in same and (21, rows[-1][1]) in same and (21, text) not in same
    assert near_copies.keep_first(df.where("false")).count() == 0


def edited(rng, words, share):
    return [f"x{rng.integers(1 << 40)}" if rng.random() < share else w for w in words]


def test_recall_of_similar_texts_and_peace_for_others(spark):
    rng = np.random.default_rng(5)
    rows, pairs = [], []
    for n in range(400):
        words = [f"v{int(v)}" for v in rng.zipf(1.3, int(rng.integers(60, 600))) % 5000]
        a, b = " ".join(words), " ".join(edited(rng, words, 0.002 + 0.018 * rng.random()))
        rows += [(2 * n, a), (2 * n + 1, b)]
        pairs.append(similarity(a, b))
    got = {r.doc_id for r in near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * n for n in range(400)} <= got
    near = [n for n, s in enumerate(pairs) if s >= 0.8]
    caught = sum(2 * n + 1 not in got for n in near)
    assert len(near) > 250 and caught >= 0.9 * len(near)
    assert all(2 * n + 1 in got for n, s in enumerate(pairs) if s < 0.6)


@pytest.mark.parametrize("wide", [4096, 8])
def test_crowded_keys(spark, monkeypatch, wide):
    """A chain and a crowd of fingerprints give the components of all pairs, in blocks too."""
    monkeypatch.setattr(near_copies, "WIDE", wide)
    rng = np.random.default_rng(3)
    key = rng.bytes(32)
    fps = [int.from_bytes(rng.bytes(32), "big") for _ in range(5)]
    for _ in range(200):
        flips = sum(1 << int(b) for b in rng.choice(256, int(rng.integers(1, 60)), replace=False))
        fps.append(fps[int(rng.integers(len(fps)))] ^ flips)
    df = spark.createDataFrame([(n, fp.to_bytes(32, "big"), key) for n, fp in enumerate(fps)], "node long, near binary, key binary").repartition(5)
    roots = {r.node: r.root for r in components.components(near_copies.links(df)).collect()}
    want = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 48)
    least = {}
    for n, r in enumerate(want):
        least.setdefault(r, n)
    assert [roots.get(n, n) for n in range(len(fps))] == [least[r] for r in want]
