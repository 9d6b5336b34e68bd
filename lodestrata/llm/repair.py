"""Repair of the structure of conversations, as the cheapest edits that give a legal sequence of roles.

A conversation is legal if its roles' initials are ``(s?(ua)+)?``. Its turns, in order, are kept (cost
0), given the role that the grammar wants next (3) or deleted (4, which a blank or duplicate turn must be),
and empty turns can be inserted anywhere (3); a truncated turn that stays costs 3 more. Of the cheapest
edits those count whose initials (K, R, D, I) are ASCII-least.

A state of the grammar is what has been read: nothing, s, an unanswered u, or an answered one. What a turn
does is a table of moves from state to state, each with its least cost and audit, and so is what a run of
turns does. Turns are numbered over all conversations by one global sort, and runs of up to ``RUN`` turns
of a conversation are dealt to hash partitions. There DuckDB goes through a batch of runs with one
recursive query: each recursion advances one turn in all of them and keeps the least cost and audit for
every pair of first and last state. Runs of a conversation that has several are joined by the same query,
``FAN`` at a time, until one is left. So no task sees more than a run of a long conversation. Only the
last step, which writes a conversation's repaired turns in order, streams through it in one task.

Turns of one number are ordered by the digest of role and text. Defined results: a null role or text
counts as one space; a null id is a conversation like any other; null turns come first and count for
no gap; turns given again are duplicates; roles of any other initial, or none, can only be reroled or
deleted; gaps beyond a long count as the largest long. Other columns are ignored; an empty table gives
an empty result. An audit is one cell, so a conversation must stay below some hundred million turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns of a run (a power of two), and runs joined at a time.
RUN = 256
FAN = 16
#: Turns, or bytes of audits, that a task's query takes at a time.
BATCH, BATCH_BYTES = 1 << 14, 4 << 20

BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing read, s read, a user turn open, a user turn answered.
NONE, SYSTEM, OPEN, ANSWERED = range(4)
#: The initial that an inserted or reroled turn gets in a state, and where that leads.
WANTED = {NONE: "u", SYSTEM: "u", OPEN: "a", ANSWERED: "u"}
AFTER = {(NONE, "s"): SYSTEM, (NONE, "u"): OPEN, (SYSTEM, "u"): OPEN, (OPEN, "a"): ANSWERED, (ANSWERED, "u"): OPEN}
ROLE = {"u": "user", "a": "assistant"}
INITIALS = "sua"

_MOVES = pa.list_(pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_STATS = ["n_blank", "n_duplicate", "n_truncated", "n_illegal", "n_turns"]
_RUN_DDL = "conv bigint, run bigint, " + ", ".join(f"{n} bigint" for n in _STATS) + ", first_initial int, last_initial int, first_turn bigint, last_turn bigint, low bigint, high bigint, moves array<struct<start:int,state:int,cost:bigint,audit:string>>"


# ---- damage


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a turn, 1 empties its
    text, 2 removes its sentence marks, 3 repeats it, 4 gives it the role of the user."""
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(what == 1, F.lit("")).when(what == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(what == 3, 2).otherwise(1)))
    return rows.where(what != 0).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(what == 4, F.lit("user")).otherwise(filled("role")).alias("role"), text.alias("text"), times.alias("__time")).drop("__time")


# ---- moves


def moves_of(initial: int, must_go: bool, truncated: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> (cost, audit) for one turn and the inserts that follow it."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        ways = [(before, DELETE, "D")]
        if not must_go:
            more = TRUNCATED * truncated
            kept = AFTER.get((before, INITIALS[initial])) if initial >= 0 else None
            if kept is not None:
                ways.append((kept, KEEP + more, "K"))
            ways.append((AFTER[before, WANTED[before]], REROLE + more, "R"))
        for state, cost, audit in ways:
            for _ in range(3):
                best[before, state] = min(best.get((before, state), (cost, audit)), (cost, audit))
                state, cost, audit = AFTER[state, WANTED[state]], cost + INSERT, audit + "I"
    return best


#: What can stand before the first turn: nothing, or inserts.
OPENING = [(NONE, 0, ""), (OPEN, INSERT, "I"), (ANSWERED, 2 * INSERT, "II")]


def _kind(initial: np.ndarray, must_go: np.ndarray, truncated: np.ndarray) -> np.ndarray:
    return (initial + 1) * 4 + must_go * 2 + truncated


def _turn_moves() -> pa.Table:
    rows = [(k, before, state, cost, audit) for k in range(16) for (before, state), (cost, audit) in moves_of(k // 4 - 1, bool(k & 2), bool(k & 1)).items()]
    return pa.table(dict(zip(["kind", "start", "state", "cost", "audit"], map(list, zip(*rows, strict=True)), strict=True)))


#: Over ``steps`` (k, p, start, state, cost, audit), the moves at place p of run k, and ``sizes`` (k, n).
_ADVANCE = """
WITH RECURSIVE path AS (
  SELECT k, start, CAST(0 AS BIGINT) AS p, start AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM sizes, (SELECT unnest([0, 1, 2, 3]) AS start)
  UNION ALL
  SELECT k, start, p + 1, state, least_one.cost, least_one.audit FROM (
    SELECT path.k, path.start, path.p, steps.state, min({'cost': path.cost + steps.cost, 'audit': path.audit || steps.audit}) AS least_one
    FROM path JOIN steps ON steps.k = path.k AND steps.p = path.p AND steps.start = path.state
    GROUP BY path.k, path.start, path.p, steps.state))
SELECT path.k, path.start, path.state, path.cost, path.audit FROM path JOIN sizes ON sizes.k = path.k AND sizes.n = path.p ORDER BY path.k, path.start, path.state"""


def _connection() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})


def _advanced(db: duckdb.DuckDBPyConnection, sizes: np.ndarray) -> pa.Array:
    """The moves of every run, as a list for each."""
    table = pa.table({"k": np.arange(len(sizes)), "n": sizes})
    db.register("sizes", table)
    found = db.sql(_ADVANCE).to_arrow_table().combine_chunks()
    ends = np.searchsorted(found.column("k").to_numpy(), np.arange(len(sizes) + 1))
    fields = [found.column(f.name).combine_chunks().cast(f.type) for f in _MOVES.value_type]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_MOVES.value_type)))


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], weigh: Callable[[pa.RecordBatch], int], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables that do not end within a run of equal ``names``, and where each run begins."""
    held: list[pa.RecordBatch] = []
    weight = 0

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for n in names:
            c = table.column(n).combine_chunks()
            value, null = c.fill_null(0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
        return np.flatnonzero(new)

    for batch in batches:
        for first in range(0, batch.num_rows, BATCH):
            some = batch.slice(first, BATCH)
            held.append(some)
            weight += weigh(some)
            if weight >= most:
                table = pa.Table.from_batches(held).combine_chunks()
                at = begins(table)
                if len(at) > 1:
                    yield table.slice(0, at[-1]).combine_chunks(), at[:-1]
                held = table.slice(at[-1]).combine_chunks().to_batches()
                weight = sum(map(weigh, held))
    if sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, begins(table)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)


def _first_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of turns, in order and each first one of its text after a mark, as one row each."""
    db, moves = _connection(), _turn_moves()
    db.register("moves", moves)
    for table, at in _runs(batches, ["conv", "run"], lambda b: b.num_rows, BATCH):
        mark = _numbers(table, "mark").astype(bool)
        real = np.flatnonzero(~mark)
        run = np.searchsorted(at, real, "right") - 1
        sizes = np.bincount(run, minlength=len(at))
        begin = np.cumsum(sizes) - sizes  # marks never stand alone: every run has a turn
        turns = table.take(pa.array(real))
        initial, blank, truncated = (_numbers(turns, n) for n in ("initial", "blank", "truncated"))
        duplicate = (blank == 0) & ~mark[real - 1]  # the last row is no mark, so neither is what stands "before" row 0
        truncated = (truncated == 1) & ~duplicate
        db.register("turns", pa.table({"k": run, "p": np.arange(len(run)) - begin[run], "kind": _kind(initial, (blank == 1) | duplicate, truncated)}))
        db.execute("CREATE OR REPLACE TEMP VIEW steps AS SELECT turns.k, turns.p, moves.start, moves.state, moves.cost, moves.audit FROM turns JOIN moves USING (kind)")
        inner = np.ones(len(run), bool)
        inner[begin] = False
        turn, null = _numbers(turns, "turn"), turns.column("turn").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        changed = ~null
        changed[1:] &= ~inner[1:] | null[:-1] | (turn[1:] != turn[:-1])
        bad = inner.copy()
        bad[1:] &= ~legal(initial[:-1], initial[1:])
        total = lambda x, run=run, m=len(at): np.bincount(run, x, m).astype(np.int64)
        end = begin + sizes - 1
        first_real = np.searchsorted(np.cumsum(~null), np.cumsum(~null)[begin] - (~null)[begin] + 1)  # nulls come first
        none = total(~null) == 0
        nullable = lambda x, gone: pa.array(np.where(gone, 0, x), pa.int64(), mask=gone)
        low = turn[np.minimum(first_real, len(turn) - 1)]
        yield pa.RecordBatch.from_arrays([
            turns.column("conv").combine_chunks().take(pa.array(begin)), turns.column("run").combine_chunks().take(pa.array(begin)), *(pa.array(total(x)) for x in (blank, duplicate, truncated, bad, changed)),
            pa.array(initial[begin].astype(np.int32)), pa.array(initial[end].astype(np.int32)), nullable(turn[begin], null[begin]), nullable(turn[end], null[end]), nullable(low, none), nullable(turn[end], none),
            _advanced(db, sizes)], ["conv", "run", *_STATS, "first_initial", "last_initial", "first_turn", "last_turn", "low", "high", "moves"])


def _joined_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring runs as one."""
    db = _connection()
    for table, at in _runs(batches, ["conv", "run"], lambda b: b.nbytes, BATCH_BYTES):
        moves = table.column("moves").combine_chunks()
        row = np.repeat(np.arange(len(moves)), pc.list_value_length(moves).to_numpy())
        run = np.searchsorted(at, np.arange(table.num_rows), "right") - 1
        flat = moves.flatten()
        steps = pa.table({"k": run[row], "p": (np.arange(table.num_rows) - at[run])[row]} | {f.name: flat.field(f.name) for f in _MOVES.value_type})
        db.register("steps", steps)
        heads = table.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([heads.column("conv").combine_chunks(), heads.column("run").combine_chunks(), _advanced(db, np.diff(np.append(at, table.num_rows)))], ["conv", "run", "moves"])


def legal(before, after):
    """Whether initials (places in ``INITIALS``) may stand beside each other: su, ua or au."""
    return (before == 0) & (after == 1) | (before == 1) & (after == 2) | (before == 2) & (after == 1)


# ---- repair


def _placed(rows: DataFrame) -> DataFrame:
    """Turns with their place in the order of all, and what the repair has to know of each."""
    filled = rows.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate(INITIALS)], F.lit(-1))
    known = filled.withColumns({"digest": digest, "initial": initial, "blank": (trimmed == "").cast("int"), "truncated": (~F.right(trimmed, F.lit(1)).isin(".", "!", "?") & (trimmed != "")).cast("int")})
    ordered = known.repartitionByRange("conv", "turn", "digest").sortWithinPartitions("conv", "turn", "digest")
    return materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "repair-turns")


def _per_run(turns: DataFrame) -> DataFrame:
    """The moves and counts of every run. A mark goes before the first turn of each role and text of a
    conversation; marks are as many as different texts, so a text that is repeated often is no burden."""
    narrow = ["conv", "place", "turn", "initial", "blank", "truncated"]
    firsts = turns.groupBy("conv", "digest").agg(F.min("place").alias("place")).select("conv", "place", F.lit(1).alias("mark"))
    both = turns.select(*narrow, F.lit(0).alias("mark")).unionByName(firsts, allowMissingColumns=True)
    dealt = both.withColumn("run", F.col("place").bitwiseAND(F.lit(-RUN))).repartition("conv", "run").sortWithinPartitions("conv", "run", "place", F.col("mark").desc())
    return materialize(dealt.mapInArrow(_first_moves, _RUN_DDL), "repair-runs")


def _whole(runs: DataFrame) -> DataFrame:
    """(conv, moves): one row for each conversation."""
    by = Window.partitionBy("conv")
    numbered = lambda df: df.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("at", F.row_number().over(by.orderBy("run")) - 1)
    left = materialize(numbered(runs.select("conv", "run", "moves")), "repair-moves")
    done = []
    while True:
        done.append(left.where("n = 1").select("conv", "moves"))
        rest = left.where("n > 1")
        if rest.isEmpty():
            break
        dealt = rest.select("conv", F.floor(F.col("at") / FAN).cast("long").alias("run"), "at", "moves").repartition("conv", "run").sortWithinPartitions("conv", "run", "at").drop("at")
        left = materialize(numbered(dealt.mapInArrow(_joined_moves, "conv bigint, run bigint, moves array<struct<start:int,state:int,cost:bigint,audit:string>>")), "repair-moves")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _totals(runs: DataFrame) -> DataFrame:
    """Counts of a conversation from those of its runs and from what meets where they meet."""
    along = Window.partitionBy("conv").orderBy("run")
    last, turn = F.lag("last_initial").over(along), F.lag("last_turn").over(along)
    fits = legal(last, F.col("first_initial"))
    met = runs.drop("moves").withColumn("n_illegal", F.col("n_illegal") + F.when(last.isNotNull() & ~fits, 1).otherwise(0)).withColumn("n_turns", F.col("n_turns") - F.coalesce((turn == F.col("first_turn")).cast("long"), F.lit(0)))
    summed = met.groupBy("conv").agg(*[F.sum(n).alias(n) for n in _STATS], F.min("low").alias("low"), F.max("high").alias("high"))
    exact = F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1 - F.col("n_turns")
    gaps = F.coalesce(F.least(exact, F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long"), F.lit(0).cast("long"))
    return summed.select("conv", gaps.alias("gaps"), F.col("n_blank").alias("blank"), F.col("n_duplicate").alias("duplicate"), F.col("n_truncated").alias("truncated"), F.col("n_illegal").alias("illegal"))


def _cheapest(moves: Column) -> Column:
    """The least (cost, audit) that begins with an opening and ends in a legal state."""
    ended = F.filter(moves, lambda m: m["state"].isin(NONE, ANSWERED))

    def opened(state: int, cost: int, audit: str) -> Column:
        mine = F.filter(ended, lambda m: m["start"] == state)
        return F.transform(mine, lambda m: F.struct((m["cost"] + cost).alias("cost"), F.concat(F.lit(audit), m["audit"]).alias("audit")))

    ways = F.concat(*[opened(*way) for way in OPENING])
    return F.array_min(ways)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text), a report (conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit) for each conversation, and the repaired turns (conv_id, place, edit, role, text), those of
    a conversation in order and in one partition."""
    turns = _placed(rows)
    runs = _per_run(turns)
    edits = materialize(_whole(runs).withColumn("best", _cheapest(F.col("moves"))).select("conv", "best.cost", "best.audit"), "repair-edits")
    report = _beside(_totals(runs), edits)
    mixed = turns.select("conv", "place", "role", "text").union(edits.select("conv", F.lit(-1).cast("long"), F.lit(None).cast("string"), "audit"))
    mended = mixed.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(_mended, "conv_id bigint, place bigint, edit string, role string, text string")
    return report, mended


def _beside(totals: DataFrame, edits: DataFrame) -> DataFrame:
    theirs = edits.withColumnRenamed("conv", "__conv")
    return totals.join(theirs, F.col("conv").eqNullSafe(F.col("__conv"))).drop("__conv").withColumnRenamed("conv", "conv_id")


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order, a conversation's audit before its first one, as the turns that the audit leaves."""
    audit, at, state, place = "", 0, NONE, 0
    for batch in batches:
        conv, places, roles, texts = (batch.column(i) for i in range(4))
        out: list[tuple] = []
        for i, kind in enumerate(places.to_pylist()):
            if kind < 0:
                audit, at, state, place = texts[i].as_py(), 0, NONE, 0
            else:
                edit, role = audit[at], roles[i].as_py()
                at += 1
                if edit != "D":
                    role = ROLE[WANTED[state]] if edit == "R" else role
                    out.append((conv[i].as_py(), place, edit, role, texts[i].as_py()))
                    state, place = AFTER[state, role[0]], place + 1
            while at < len(audit) and audit[at] == "I":
                role = ROLE[WANTED[state]]
                out.append((conv[i].as_py(), place, "I", role, ""))
                state, place, at = AFTER[state, role[0]], place + 1, at + 1
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["conv_id", "place", "edit", "role", "text"])


def digests(mended: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired turns as ``repair`` returns them: the SHA-256 of their
    ``role:text``, joined by line feeds. A conversation without turns has no row here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = ["conv_id", "repaired_sha256"]
        now, hashed = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, place, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if place == 0:
                    if hashed is not None:
                        done.append((now, hashed.hexdigest()))
                    now, hashed = conv, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], shape)
        if hashed is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([hashed.hexdigest()])], shape)

    return mended.mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Every conversation's report after damage, with the digest of its repaired turns; zeros, an empty
    audit and the digest of nothing where no turn is left."""
    report, mended = repair(damage(conversations))
    everyone = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    parts = everyone.withColumnRenamed("conv_id", "__c")
    zero = F.lit(0).cast("long")
    for i, df in enumerate((report, digests(mended))):
        other = df.withColumnRenamed("conv_id", f"__c{i}")
        parts = parts.join(other, F.col("__c").eqNullSafe(F.col(f"__c{i}")), "left").drop(f"__c{i}")
    counts = [F.coalesce(n, zero).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return parts.select(F.col("__c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
