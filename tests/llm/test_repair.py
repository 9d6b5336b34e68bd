"""Conversation repair against trying out all edits, and in pieces of any size."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lodestrata.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """Of (turn, role, text) in order: the first fault of each."""
    seen, out = set(), []
    for _, role, text in rows:
        words = WORD.findall(text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def tried(rows):
    """(cost, audit, repaired) of the best of all ways to edit a few turns."""
    found = []
    options = []
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        ways = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            ways += [(more, "K", (role, text)), (3 + more, "R", ("user", text)), (3 + more, "R", ("assistant", text))]
        options.append(ways)
    inserted = [list(itertools.product(["user", "assistant"], repeat=n)) for n in range(3)]
    for chosen in itertools.product(*options):
        for added in itertools.product(*[[x for some in inserted for x in some]] * (len(rows) + 1)):
            if sum(map(len, added)) > len(rows) + 1:
                continue
            cost, audit, turns = 0, "", []
            for i in range(len(rows) + 1):
                cost += 3 * len(added[i])
                audit += "I" * len(added[i])
                turns += [(r, "") for r in added[i]]
                if i < len(rows):
                    cost += chosen[i][0]
                    audit += chosen[i][1]
                    turns += [chosen[i][2]] * (chosen[i][2] is not None)
            if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in turns)):
                found.append((cost, audit, turns))
    return min(found)


def ordered(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    return sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=key)


def counted(rows):
    turns = [t for t, _, _ in rows if t is not None]
    f = faults(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs))


def run(spark, conversations):
    rows = [(c, t, r, x, "clash") for c, turns in conversations.items() for t, r, x in turns]
    random.Random(1).shuffle(rows)
    report, mended = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string"))
    got = {r.conv_id: (tuple(r[1:6]), r.cost, r.audit) for r in report.collect()}
    turns = {c: [] for c in got}
    for r in sorted(mended.collect(), key=lambda r: r.place):
        turns[r.conv_id].append((r.role, r.text))
    return got, turns, {r.conv_id: r.repaired_sha256 for r in repair.digests(mended).collect()}


ROLES = ["user", "assistant", "system", "tool", "", None, "User"]
TEXTS = ["Yes.", "No", " ", "", "Why?\n", None, "é!", "a. b"]


def conversations(n, size, seed):
    rng = random.Random(seed)
    return {c: [(rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randint(1, size))] for c in [None, *range(n)]}


def test_equals_trying_everything(spark):
    some = conversations(60, 3, 5)
    got, turns, hashed = run(spark, some)
    assert set(got) == set(some)
    for c, rows in some.items():
        rows = ordered(rows)
        cost, audit, repaired = tried(rows)
        assert (got[c], turns[c]) == ((counted(rows), cost, audit), repaired), rows
        want = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest()
        assert hashed.get(c, hashlib.sha256().hexdigest()) == want


def test_pieces_make_no_difference(spark, monkeypatch):
    some = conversations(12, 60, 9) | {100: [(t, ["user", "assistant"][t % 2], f"turn {t}." if t % 5 else "ok") for t in range(700)]}
    whole = run(spark, some)
    assert {c: v[0] for c, v in whole[0].items()} == {c: counted(ordered(rows)) for c, rows in some.items()}
    for text in whole[1].values():
        assert LEGAL.fullmatch("".join(r[0] for r, _ in text))
    monkeypatch.setattr(repair, "RUN", 4)
    monkeypatch.setattr(repair, "FAN", 3)
    monkeypatch.setattr(repair, "BATCH", 8)
    monkeypatch.setattr(repair, "BATCH_BYTES", 2000)
    assert run(spark, some) == whole


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(3)] + [(None, 1, "x", None), (3, None, None, "y?")]
    want = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        new = {1: [(c, t, r, "")], 2: [(c, t, r, x.translate(str.maketrans("", "", ".!?")))], 3: [(c, t, r, x)] * 2, 4: [(c, t, "user", x)], 0: []}
        want += new.get(what, [(c, t, r, x)])
    got = [tuple(r) for r in repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_every_conversation_returns(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    shape = "conv_id long, turn long, role string, text string"
    assert repair.damaged_and_repaired(spark.createDataFrame([], shape)).collect() == []
    rows = repair.damaged_and_repaired(spark.createDataFrame([(dropped, 0, "user", "Hello.")], shape)).collect()
    assert [tuple(r) for r in rows] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


@pytest.mark.parametrize("turn", [-(2**63), 2**63 - 1])
def test_gaps_beyond_a_long(spark, turn):
    got, _, _ = run(spark, {1: [(turn, "user", "a."), (0, "assistant", "b."), (-turn // 2, "user", "c.")]})
    assert 0 <= got[1][0][0] <= 2**63 - 1
