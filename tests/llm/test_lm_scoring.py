"""Language-model scoring against plain counting, and that the model is one."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import lm_scoring as lm

from .test_operators import EDGES, docs, edges, empty, rows  # noqa: F401


def held(i):
    return zlib.crc32((str(i) if i is not None else "").encode()) % 5 == 1


def plain_scores(rows):  # noqa: F811
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return n, [(held(i), len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for (i, _), ws in zip(rows, tokens, strict=True)]


@pytest.mark.parametrize("block", [24 << 20, 20_000])
def test_base_score_matches_plain_counts(docs, rows, monkeypatch, block):  # noqa: F811
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    n, want = plain_scores(rows)
    got = {r.doc_id: r for r in lm.score(docs.repartition(5)).collect()}
    for (i, _), (out, tokens, known, base) in zip(rows, want, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    test = [r for r in got.values() if r.held_out]
    bits = sum(r.bits_per_byte * len((dict(rows)[r.doc_id] or "").encode()) for r in test) / sum(len((dict(rows)[r.doc_id] or "").encode()) for r in test)
    assert bits < 2.6  # single bytes of this text take over four bits


def test_next_byte_probabilities_add_up(docs):  # noqa: F811
    model = lm.train_from(docs)
    for prefix in (b"", b"th", b"ea", b"qqq"):
        def log_of(text, at):  # of one byte of a word, after the bytes before it
            e = lm.Events.of_words([text])
            p = model.ones_probability(e).reshape(-1, 8)
            return np.where(e.bit == 1, p, 1 - p).prod(1)[at]
        total = sum(log_of(prefix + bytes([b]), len(prefix)) for b in range(256) if b != 32) + log_of(prefix, len(prefix))
        assert total == pytest.approx(1, abs=1e-4)


def test_units_match_plain_contexts(docs, rows):  # noqa: F811
    """Counts and logits of the units, against a dictionary of (context, node) filled token by token."""
    model = lm.train_from(docs)
    n = {}
    for i, text in rows:
        if held(i):
            continue
        words, line = (text or "").encode().lower().split() + [lm.END], b"    "
        for w in words:
            for k, byte in enumerate(w + b" "):
                node = 1
                for shift in range(7, -1, -1):
                    bit = byte >> shift & 1
                    for c in (*(line[-o:] for o in lm.ORDERS), ("word", w[:k])):
                        n.setdefault((len(c) if isinstance(c, bytes) else 0, c, node), [0, 0])[bit] += 1
                    node = node << 1 | bit
                line = line[-3:] + bytes([byte])
    e = lm.Events.of_words(b"the house of xqz".split())
    x = model.logit[model.slots.of(e)].reshape(lm.CONTEXTS, -1, 8)
    line, at, same, all_ = b"    ", 0, 0, 0
    for w in b"the house of xqz".split():
        for k, byte in enumerate(w + b" "):
            for j, c in enumerate((*(line[-o:] for o in lm.ORDERS), ("word", w[:k]))):
                for s in range(8):
                    zero, one = n.get((len(c) if j < 4 else 0, c, (256 | byte) >> (8 - s)), (0, 0))
                    same += abs(x[j, at, s] - math.log((one + lm.PRIOR) / (zero + lm.PRIOR))) < 1e-3
                    all_ += 1
            line, at = line[-3:] + bytes([byte]), at + 1
    assert same > 0.93 * all_  # slots are shared now and then


@pytest.mark.parametrize("lane_bytes", [1 << 22, 1 << 14])
def test_scores_do_not_depend_on_partitions(spark, docs, monkeypatch, lane_bytes):  # noqa: F811
    monkeypatch.setattr(lm, "LANE_BYTES", lane_bytes)
    out = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (2, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append({r.doc_id: (r.base_score, r.score) for r in lm.score(docs.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out[0] == out[1]


def test_model_beats_the_base_on_held_out_text(docs):  # noqa: F811
    got = [r for r in lm.score(docs).collect() if r.held_out]
    assert sum(r.score for r in got) > 1.25 * sum(r.base_score for r in got)  # which gives unseen words no proper share


def test_score_is_the_sum_over_the_words(docs, rows):  # noqa: F811
    model = lm.train_from(docs)
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    for i, text in rows[:20]:
        words = text.encode().lower().split()
        assert got[i] == pytest.approx(model.score(words + [lm.END]).sum(), rel=1e-4)


def test_common_words_are_likelier(docs):  # noqa: F811
    p = lm.train_from(docs).score([b"the", b"of", b"xqzkv"])
    assert min(p[:2]) > p[2] + 4


def test_edges(edges, empty):  # noqa: F811
    found = lm.score(edges).collect()
    assert len(found) == len(EDGES) and all(r.n_tokens >= 1 for r in found)
    assert lm.score(empty).count() == 0


def test_order_of_words_matters(spark, docs):  # noqa: F811
    model = lm.train_from(docs)
    texts = ["the house of a man and I b c d", "d c b I and man a of house the", "a\u0000b x \u0000yz q"]
    out = [i for i in range(10**6, 10**6 + 99) if held(i)]  # held out, so that the model is the same
    extra = spark.createDataFrame(list(zip(out, texts, strict=False)), "doc_id long, text string")
    got = {r.text: r.score for r in lm.score(docs.select("doc_id", "text").unionByName(extra)).join(extra, "doc_id").collect()}
    for text, found in got.items():
        assert found == pytest.approx(model.score(text.encode().lower().split() + [lm.END]).sum(), rel=1e-3)
    assert abs(got[texts[0]] - got[texts[1]]) > 0.1
