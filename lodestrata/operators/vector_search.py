"""Nearest neighbours by cosine: for one query as a column, for many by blocks of products."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine_constant, usable
from ..options import FilterOptions
from .filters import filtered

#: Queries that go to every task at once; more are taken in turns.
QUERY_BLOCK = 4096
#: Products of vectors with a block of queries that a task holds at a time.
PRODUCTS = 1 << 22


def scored(chunks: DataFrame, query: Sequence[float], o: FilterOptions | None = None, vector: str = "embedding") -> DataFrame:
    """Chunks with a usable vector, with ``cosine``; null, zero and odd-sized vectors are left out."""
    rows = filtered(chunks, o or FilterOptions()).where(usable(F.col(vector), len(query)))
    return rows.withColumn("cosine", F.round(cosine_constant(vector, query), 6))


def top(chunks: DataFrame, query: Sequence[float], limit: int, o: FilterOptions | None = None, vector: str = "embedding") -> DataFrame:
    """The ``limit`` best, ties by id."""
    return scored(chunks, query, o, vector).orderBy(F.desc("cosine"), "chunk_id").limit(limit)


def nearest(queries: DataFrame, chunks: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding", id_col: str = "chunk_id", digits: int = 6) -> DataFrame:
    """(query_id, chunk_id, cosine, rank) of the k best for each query. Queries go out in blocks of
    ``QUERY_BLOCK``; a task multiplies a batch of vectors with a block and keeps the k best of the
    batch, so pairs are never written out; then a window takes the best k of all tasks."""
    block: list[tuple] = []
    parts: list[DataFrame] = []
    for row in queries.select(query_id, vector).where(F.col(vector).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == QUERY_BLOCK:
            parts.append(_block_best(block, chunks, k, vector, id_col, digits))
            block = []
    if block or not parts:
        parts.append(_block_best(block, chunks, k, vector, id_col, digits))
    best = parts[0]
    for more in parts[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, ties by id: only what reaches the k-th score is sorted."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = np.indices(scores.shape).reshape(2, -1)
    by = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[by], col[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _block_best(block: list[tuple], chunks: DataFrame, k: int, vector: str, id_col: str, digits: int) -> DataFrame:
    ids = np.array([i for i, _ in block], np.int64)
    if len({len(v) for _, v in block}) > 1:
        raise ValueError("query vectors differ in length")
    matrix = np.array([v for _, v in block], np.float64)
    if len(block):
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix /= np.where(length > 0, length, 1)  # of a zero vector all products are zero
    shared = chunks.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        step = max(1, PRODUCTS // max(1, len(ids)))
        for batch in batches:
            for first in range(0, batch.num_rows if len(ids) else 0, step):
                part = batch.slice(first, step)
                own = part.column(0).to_numpy()
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                scores = np.round(matrix @ vectors.T, digits)
                at, col = _best(scores, own, k)
                yield pa.record_batch({"query_id": pa.array(ids[at]), "chunk_id": pa.array(own[col]), "cosine": pa.array(scores[at, col])})

    dim = matrix.shape[1] if len(block) else 0
    usable_rows = chunks.where(usable(F.col(vector), dim)).select(F.col(id_col).cast("long").alias("chunk_id"), F.col(vector))
    return usable_rows.mapInArrow(run, "query_id long, chunk_id long, cosine double")
