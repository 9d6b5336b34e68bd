"""Exact top-k search by distributed histogram selection.

A vector's components become the integers ``floor(256 * x)``, and a score is the inner product of two
rows of them. Queries are the rows whose id is divisible by ``QUERY_EVERY``; every other row is a
candidate of every query. No list of scores is ever made. Instead

1. vectors are packed into chunks of rows, queries into blocks of rows, and both are written once;
2. every block meets every chunk and all scores are counted into a histogram for each query, whose
   bins are the leading bits of the score. A task sends on the bins from the top until they hold as
   many scores as are asked for, which is all that can matter. Summed over all tasks, the bins tell
   where the kth best score lies. The next pass splits that bin by the bits that follow, until a bin
   is one score. The number of passes follows from the longest vectors alone;
3. a last pass keeps what reaches a query's kth score, and ties go by id.

Blocks are broadcast if a count has shown that they take up to ``BROADCAST_BYTES``. Beyond that both sides
are dealt to cells of some blocks and some chunks, so that no task holds all queries or all vectors.
Products are worked out in the narrowest floating type in which every partial sum is exact (they are
whole numbers, bounded by the product of lengths), beyond that in whole numbers.

Defined results: a vector that is null or holds a null, NaN or infinite component takes no part; a vector
of no component is one like any other, all its scores zero; vectors of different lengths do not
meet. A row without an id is no query, and as a candidate comes after all others of its score. Of
repeated ids each row is a query and a candidate of its own, and only the row itself is left out.
Components beyond 2**62, and scores beyond a long, count as the nearest number that fits. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

K = 5
QUERY_EVERY = 50
SCALE = 256
#: Vectors of a chunk, and queries of a block; queries whose scores a worker holds at a time.
ROWS = 4096
TILE = 256
#: Bits of a score that one pass settles, at most.
STEP_BITS = 10
BROADCAST_BYTES = 64 << 20
#: Beyond the broadcast: blocks and chunks that meet in a cell.
CELL_BLOCKS, CELL_CHUNKS = 4, 32

_LONG = (-(1 << 63), (1 << 63) - 1)
_CHUNK = "chunk long, dims int, longest double, width int, ids array<bigint>, parts binary"
_QUERY = "dims int, longest double, query_id bigint, own_chunk bigint, own_row int, parts array<bigint>"
_BLOCK = "block long, dims int, longest double, width int, query_ids array<bigint>, own_chunks array<bigint>, own_rows array<int>, parts binary"


# ---- packing


def whole_parts(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors take part, and the whole numbers of those."""
    held, rows = [], []
    for i, v in enumerate(vectors):
        if not v.is_valid or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all():
            with np.errstate(over="ignore"):  # a product beyond a double is beyond 2**62 too
                held.append(i)
                rows.append(np.clip(np.floor(x * SCALE), -(2.0**62), 2.0**62).astype(np.int64))
    return np.array(held, np.int64), rows


def _packed(parts: np.ndarray) -> tuple[int, bytes]:
    """The numbers in the narrowest type that holds them, and its bytes per number."""
    most = int(np.abs(parts).max(initial=0))
    kind = next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
    return np.dtype(kind).itemsize, parts.astype(kind).tobytes()


def _unpacked(row: dict, n: int) -> np.ndarray:
    return np.frombuffer(row["parts"], f"<i{row['width']}").astype(np.int64).reshape(n, row["dims"])


def _length(parts: np.ndarray) -> float:
    """The largest Euclidean length of the rows, not below the true one."""
    return float(np.sqrt((parts.astype(np.float64) ** 2).sum(1).max(initial=0))) * (1 + 1e-9)


def _by_dims(rows: Iterator[tuple[int, tuple]], most: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of one number of dimensions, ``most`` at a time; what waits for its like is bounded too."""
    waiting: dict[int, list[tuple]] = {}
    held = 0
    for dims, row in rows:
        waiting.setdefault(dims, []).append(row)
        held += 1
        if len(waiting[dims]) >= most or held >= 8 * most:
            full = dims if len(waiting[dims]) >= most else max(waiting, key=lambda d: len(waiting[d]))
            held -= len(waiting[full])
            yield full, waiting.pop(full)
    yield from waiting.items()


def chunks(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The vectors that take part, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def each() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                held, rows = whole_parts(batch.column(1))
                for i, x in zip(held.tolist(), rows, strict=True):
                    yield len(x), (batch.column(0)[i].as_py(), x)

        for dims, rows in _by_dims(each(), ROWS):
            parts = np.stack([x for _, x in rows])
            width, data = _packed(parts)
            yield pa.RecordBatch.from_pylist([{"chunk": number, "dims": dims, "longest": _length(parts), "width": width, "ids": [i for i, _ in rows], "parts": data}], _arrow(_CHUNK))
            number += 1

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(run, _CHUNK)


def blocks(packed: DataFrame, every: int) -> DataFrame:
    """The queries among the chunks, packed in turn."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = [j for j, i in enumerate(row["ids"]) if i is not None and i % every == 0]
                parts = _unpacked(row, len(row["ids"]))
                own = [{"dims": row["dims"], "longest": _length(parts[j:j + 1]), "query_id": row["ids"][j], "own_chunk": row["chunk"], "own_row": j, "parts": parts[j].tolist()} for j in at]
                yield pa.RecordBatch.from_pylist(own, _arrow(_QUERY))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for dims, rows in _by_dims(((r["dims"], r) for b in batches for r in b.to_pylist()), ROWS):
            width, data = _packed(np.array([r["parts"] for r in rows], np.int64).reshape(len(rows), dims))
            yield pa.RecordBatch.from_pylist([{
                "block": number, "dims": dims, "longest": max(r["longest"] for r in rows), "width": width, "query_ids": [r["query_id"] for r in rows],
                "own_chunks": [r["own_chunk"] for r in rows], "own_rows": [r["own_row"] for r in rows], "parts": data}], _arrow(_BLOCK))
            number += 1

    queries = materialize(packed.mapInArrow(pick, _QUERY), "topk-queries")
    dealt = queries.repartition(max(1, -(-queries.count() // ROWS)), "own_chunk", "own_row")
    out = materialize(dealt.mapInArrow(pack, _BLOCK), "topk-blocks")
    discard(queries)
    return out


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))])


# ---- scoring


def products(queries: np.ndarray, rows: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of all pairs, exactly. ``bound`` is the product of the largest lengths: no partial
    sum is beyond it, so below 2**24 and 2**53 floating sums of whole numbers are exact."""
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return (queries.astype(kind) @ rows.astype(kind).T).astype(np.int64)
    if bound < 2**62:
        return queries @ rows.T
    return np.clip(queries.astype(object) @ rows.astype(object).T, *_LONG).astype(np.int64)


def _tiles(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, scores of some queries with all rows of the chunk, which are the queries' own)."""
    candidates = _unpacked({"parts": row["c_parts"], "width": row["c_width"], "dims": row["dims"]}, len(row["ids"]))
    queries = _unpacked(row, len(row["query_ids"]))
    own = np.where(np.array(row["own_chunks"], np.int64) == row["chunk"], np.array(row["own_rows"], np.int64), -1)
    for first in range(0, len(queries), TILE):
        scores = products(queries[first:first + TILE], candidates, row["longest"] * row["c_longest"])
        mine = np.zeros(scores.shape, bool)
        r = np.flatnonzero(own[first:first + TILE] >= 0)
        mine[r, own[first:first + TILE][r]] = True
        yield first, scores, mine


def _bins(scores: np.ndarray, mine: np.ndarray, prefix: np.ndarray, bits: int, shift: int, step: int) -> np.ndarray:
    """For each query, how many of the scores under its prefix have each value of the next ``step`` bits."""
    places = scores.view(np.uint64) + np.uint64(1 << (bits - 1))  # from zero; wraps if all 64 bits are in use
    n, size = len(scores), 1 << step
    flat = (places >> np.uint64(shift) & np.uint64(size - 1)).view(np.int64) + np.arange(n)[:, None] * size
    out = mine if shift + step >= bits else mine | (places >> np.uint64(shift + step) != prefix.view(np.uint64)[:, None])
    flat[out] = n * size
    return np.bincount(flat.ravel(), minlength=n * size + 1)[:-1].reshape(n, size)


def _joined(pairs: DataFrame, run, ddl: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from run(batch.slice(i, 1).to_pylist()[0])

    return pairs.mapInArrow(each, ddl)


def _paired(packed: DataFrame, queries: DataFrame, broadcast: bool, n_blocks: int, n_chunks: int) -> DataFrame:
    """Every block beside every chunk of its number of dimensions."""
    theirs = packed.withColumnsRenamed({"longest": "c_longest", "width": "c_width", "parts": "c_parts"})
    if broadcast:
        return theirs.join(F.broadcast(queries), "dims")
    across, down = -(-n_blocks // CELL_BLOCKS), -(-n_chunks // CELL_CHUNKS)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    theirs = theirs.withColumn("down", dealt("chunk", down)).withColumn("across", every(across))
    return theirs.join(queries.withColumn("across", dealt("block", across)).withColumn("down", every(down)), ["dims", "across", "down"]).drop("across", "down")


def search(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding", step_bits: int = STEP_BITS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best candidates, ties to the smaller id."""
    packed = materialize(chunks(vectors, id_col, vector_col), "topk-chunks")
    queries = blocks(packed, every)
    longest, n_chunks = packed.agg(F.max("longest"), F.count(F.lit(1))).first()
    n_blocks, taken = queries.agg(F.count(F.lit(1)), F.sum(F.length("parts") + 64 * F.size("query_ids"))).first()
    broadcast = (taken or 0) <= broadcast_bytes
    bits = min(64, (int((longest or 0.0) ** 2) + 1).bit_length() + 1)
    passes = -(-bits // step_bits)

    def with_state(state: DataFrame) -> DataFrame:
        rows = state.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("slot", "prefix", "need"))).alias("s"))  # a block's queries: ROWS at most
        return queries.join(rows, "block").withColumn("prefix", F.col("s.prefix")).withColumn("need", F.col("s.need")).drop("s")

    # of each query: the bits of its kth score that are known, and how many scores are still to come under them
    state = queries.select("block", F.posexplode("query_ids").alias("slot", "query_id")).select("block", "slot", F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"))
    for p in range(passes):
        shift = bits * (passes - 1 - p) // passes
        step = bits * (passes - p) // passes - shift
        found = _located(_paired(packed, with_state(state), broadcast, n_blocks, n_chunks), bits, shift, step)
        moved = state.join(found, ["block", "slot"], "left")
        zero = F.lit(0).cast("long")
        after = materialize(moved.select("block", "slot", (F.shiftleft("prefix", step) + F.coalesce("bin", zero)).alias("prefix"), (F.col("need") - F.coalesce("above", zero)).alias("need")), "topk-state")
        discard(state)
        state = after
    best = _reaching(_paired(packed, with_state(state), broadcast, n_blocks, n_chunks), bits, k)
    order = Window.partitionBy("block", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "chunk", "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _located(pairs: DataFrame, bits: int, shift: int, step: int) -> DataFrame:
    """(block, slot, bin, above): the bin that holds a query's kth score, the lowest if there are fewer, and
    how many scores lie above it."""
    def run(row: dict) -> Iterator[pa.RecordBatch]:
        for first, scores, mine in _tiles(row):
            last = first + len(scores)
            bins = _bins(scores, mine, np.array(row["prefix"][first:last], np.int64), bits, shift, step)
            above = bins[:, ::-1].cumsum(1)[:, ::-1] - bins
            slot, b = np.nonzero((bins > 0) & (above < np.array(row["need"][first:last], np.int64)[:, None]))
            yield pa.record_batch({"block": pa.array(np.full(len(slot), row["block"])), "slot": pa.array((slot + first).astype(np.int32)), "bin": pa.array(b), "n": pa.array(bins[slot, b]), "need": pa.array(np.array(row["need"], np.int64)[slot + first])})

    counted = _joined(pairs, run, "block long, slot int, bin long, n long, need long").groupBy("block", "slot", "bin").agg(F.sum("n").alias("n"), F.first("need").alias("need"))
    down = Window.partitionBy("block", "slot").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reached = counted.withColumn("upto", F.sum("n").over(down))
    short = (F.col("upto") < F.col("need")) & (F.col("bin") > 0)
    return reached.groupBy("block", "slot").agg(
        F.coalesce(F.max(F.when(F.col("upto") >= F.col("need"), F.col("bin"))), F.lit(0).cast("long")).alias("bin"), F.coalesce(F.max(F.when(short, F.col("upto"))), F.lit(0).cast("long")).alias("above"))


def _reaching(pairs: DataFrame, bits: int, k: int) -> DataFrame:
    """Scores that reach their query's kth one; of a chunk, no more than ``k`` for a query."""
    def run(row: dict) -> Iterator[pa.RecordBatch]:
        ids = np.array([_LONG[1] if i is None else i for i in row["ids"]], np.int64)
        last_of_ties = np.array([i is None for i in row["ids"]])
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, last_of_ties))] = np.arange(len(ids))
        for first, scores, mine in _tiles(row):
            places = scores.view(np.uint64) + np.uint64(1 << (bits - 1))
            least = np.array(row["prefix"][first:first + len(scores)], np.int64).view(np.uint64)
            slot, at = np.nonzero((places >= least[:, None]) & ~mine)
            order = np.lexsort((rank[at], ~scores[slot, at], slot))
            slot, at = slot[order], at[order]
            begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
            place = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
            slot, at = slot[place < k], at[place < k]
            yield pa.record_batch({
                "block": pa.array(np.full(len(slot), row["block"])), "slot": pa.array((slot + first).astype(np.int32)), "query_id": pa.array([row["query_ids"][s + first] for s in slot], pa.int64()),
                "vec_id": pa.array([row["ids"][a] for a in at], pa.int64()), "score": pa.array(scores[slot, at]), "chunk": pa.array(np.full(len(slot), row["chunk"])), "row": pa.array(at.astype(np.int32))})

    return _joined(pairs, run, "block long, slot int, query_id long, vec_id long, score long, chunk long, row int")
