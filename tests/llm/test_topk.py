"""Top-k search against scoring all pairs."""

import math

import pytest

from lodestrata.llm import topk


def brute(rows, k=topk.K, every=topk.QUERY_EVERY):
    usable = [(i, [math.floor(topk.SCALE * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(usable):
        if i is None or i % every:
            continue
        scored = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c, strict=True)))), j is None, j or 0) for m, (j, c) in enumerate(usable) if m != n and len(c) == len(q)]
        out += [(i, rank, None if null else j, -s) for rank, (s, null, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank string")
    return sorted((tuple(r) for r in topk.search(df, **more).collect()), key=repr)


@pytest.fixture(scope="module")
def some(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.integers(-6, 7, 4) / 4]) for i in range(400)]  # many ties
    rows += [(i, rows[0][1]) for i in range(400, 560)]  # a third of the rows is one vector
    rows += [(561, None), (562, [1.0, None, 2.0, 0.0]), (563, [math.nan, 0.0, 0.0, 0.0]), (564, [math.inf, 0.0, 0.0, 0.0]), (None, rows[3][1]), (None, None)]
    rows += [(50, rows[1][1]), (50, rows[1][1]), (565, [1.0, 2.0]), (1000, [1.0, -2.0]), (1050, []), (566, []), (567, [0.001] * 4)]
    return rows


@pytest.mark.parametrize("more", [{}, {"step_bits": 3}, {"broadcast_bytes": 0}])
def test_equals_all_pairs(spark, some, more, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "TILE", 3)
    monkeypatch.setattr(topk, "CELL_BLOCKS", 1)
    monkeypatch.setattr(topk, "CELL_CHUNKS", 2)
    assert found(spark, [(*r, "x", "y") for r in some], **more) == brute(some)


@pytest.mark.parametrize("scale", [300.0, 1e6, 1e10, 1e30])
def test_large_components_stay_exact(spark, scale):
    import random
    rng = random.Random(int(scale))
    rows = [(i, [rng.uniform(-scale, scale) for _ in range(5)]) for i in range(60)]
    clipped = [(i, [max(-(2.0**62), min(2.0**62, math.floor(256 * x))) / 256 for x in v]) for i, v in rows]
    assert found(spark, [(*r, None, None) for r in rows], every=7) == brute(clipped, every=7)


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [0.0, 0.0]), (1, [-1.0, 0.5]), (50, [-3.0, 2.0])]
    assert found(spark, [(*r, "", "") for r in rows]) == brute(rows) and len(brute(rows)) == 4


@pytest.mark.parametrize("rows", [[], [(1, [1.0])], [(0, [1.0])], [(0, None)]])
def test_no_candidates(spark, rows):
    assert found(spark, [(*r, "", "") for r in rows]) == []


@pytest.mark.parametrize("bound", [2.0**20, 2.0**50, 2.0**60, 2.0**70])
def test_products(bound):
    import numpy as np
    side = int(math.sqrt(bound) / 4)
    rng = np.random.default_rng(1)
    a, b = rng.integers(-side, side, (5, 8)), rng.integers(-side, side, (6, 8))
    want = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for q in b] for p in a]
    assert topk.products(a, b, bound * 8).tolist() == want
