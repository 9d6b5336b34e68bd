"""The pipeline, stage by stage, against brute force on the smallest tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
from lodestrata.llm import mixing, quality

from .test_near_copies import plain_groups, similar_pairs
from .test_operators import PII_KINDS, lower, plain_contamination, plain_counts


def plain_copies(doc_id, rate):
    parts = max(1, math.ceil(rate / mixing.PART))
    total = 0
    for j in range(1, parts + 1):
        u = int(hashlib.md5(f"{mixing.SEED}:{j}:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        mean, k, p = rate / parts, 0, math.exp(-rate / parts)
        f = p
        while f <= u:
            k += 1
            p *= mean / k
            f += p
        total += k
    return total


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test")
        out[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns

    kept = {i for i, r in rows.items() if judged[i].kept}
    assert {r.doc_id for r in out["quality rules"]} == kept
    for i, r in rows.items():
        n_words, _, _, _, n_repeat = plain_counts(r.text)
        if n_words < 50 or 100 * n_repeat > 50 * n_words:
            assert i not in kept

    order = sorted(kept)
    groups = defaultdict(list)
    for i, root in zip(order, plain_groups([rows[i].text for i in order]), strict=True):
        groups[root].append(i)
    first = {min(g) for g in groups.values()}
    left = {r.doc_id for r in out["near-duplicates"]}
    assert first <= left <= kept  # a link without a common key can be missed
    pairs = similar_pairs([rows[i].text for i in order])
    assert sum(order[a] in left and order[b] in left for a, b in pairs) <= 0.1 * len(pairs)

    items = [(r.item_id, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i for i in left if not plain_contamination(rows[i].text, items)[-1]}
    assert {r.doc_id for r in out["decontamination"]} == clean

    assert {r.doc_id for r in out["personal data"]} == clean
    for r in out["personal data"]:
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (rows[r.doc_id].lang, rows[r.doc_id].source)
        left = [m[0] for _, pattern, ok in PII_KINDS for m in re.finditer(pattern, r.text) if ok(m)]
        assert not left
        pieces = re.split(r"\[(?:EMAIL|IP|CARD|PHONE|IBAN|SSN|SHORT_CARD)\]", r.text)
        at = 0
        for piece in pieces:
            at = rows[r.doc_id].text.index(piece, at) + len(piece)

    sizes = Counter(rows[i].source for i in clean)
    want = {s: math.sqrt(n) for s, n in sizes.items()}
    rate = {s: round(want[s] / sum(want.values()) * len(clean) / n, 9) for s, n in sizes.items()}
    expected = Counter({i: n for i in clean if (n := plain_copies(i, rate[rows[i].source]))})
    assert Counter(r.doc_id for r in out["mixing"]) == expected
    assert sorted((r.doc_id, r.copy_no) for r in out["mixing"]) == sorted((i, k) for i, n in expected.items() for k in range(1, n + 1))


def test_run_gives_the_last_stage(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() > 50 and {"doc_id", "text", "lang", "source", "n_chars", "copy_no"} <= set(found.columns)


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = quality.judge(docs)
    good = judged.where("not base_failed")
    assert good.where("not kept").count() <= 0.02 * good.count()
