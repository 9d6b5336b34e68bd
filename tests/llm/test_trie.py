"""The prefix trie against one built in memory."""

import hashlib
import random
import re
import zlib

import pytest

from lodestrata.llm import trie

SHAPE = "conv_id long, turn long, role string, text string, node string, depth string"


def brute(rows):
    convs: dict[int, list] = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r or "", x or ""))
    digest = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()
    for c, turns in convs.items():
        convs[c] = [(r, x) for t, r, x in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, digest(*t[1:])))]
    members: dict[tuple, list] = {}
    rebuilt = {}
    for c, turns in convs.items():
        base, h = c - (abs(c) % 20) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = (*convs.get(base, [])[:h], *turns[h:])
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(rebuilt[c][:d], []).append(c)
    out = []
    for path, convs_of in members.items():
        subtree = [p for p in members if p[:len(path)] == path]
        children = [p for p in members if len(p) == len(path) + 1 and p[:len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in subtree if p)
        leaves = sum(not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in members) for p in subtree)
        ends = ",".join(str(c) for c in sorted(c for c in convs_of if len(rebuilt[c]) == len(path)))
        out.append((min(convs_of), len(path), min(members[path[:-1]]) if path else None, len(convs_of), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SHAPE)
    return sorted((tuple(r) for r in trie.build(df).drop("node", "parent").collect()), key=repr)


def some_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-45, 90), 2**62 + 7, None]:
        if c in (0, 40):  # families without a base
            continue
        for t in range(rng.randint(1, 5)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", "", None]), rng.choice(["hi", "hi", "a b  c\n", "", None, "é  x"])))
    rows += [(c, t, "user", f"common {t}") for c in range(100, 160) for t in range(6)]  # copies of one conversation
    return rows + rows[:9]


@pytest.mark.parametrize("held, hot", [(1 << 16, 10_000), (2, 1), (7, 3)])
def test_equals_a_trie_in_memory(spark, monkeypatch, held, hot):
    monkeypatch.setattr(trie, "HELD", held)
    monkeypatch.setattr(trie, "HOT", hot)
    monkeypatch.setattr(trie, "ID_BLOCK_BITS", 3)
    rows = some_rows(held)
    assert found(spark, rows) == brute(rows)


def test_a_deep_conversation(spark):
    rows = [(1, t, "user", f"turn {t}") for t in range(600)] + [(2, t, "user", f"turn {t}") for t in range(300)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_no_conversation(spark, rows):
    assert found(spark, rows) == []


def test_turnless_conversations(spark):
    few = [c for c in range(200) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:2]
    rows = [(c, 0, "user", "only") for c in few]  # shorter than what the absent base replaces
    assert found(spark, rows) == brute(rows) == [(few[0], 0, None, 2, 0, 1, 0, hashlib.sha256(",".join(map(str, few)).encode()).hexdigest())]
