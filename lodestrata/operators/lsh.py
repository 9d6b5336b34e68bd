"""Approximate neighbours: an opt-in candidate filter before the exact ranking.

Random hyperplanes cut the space; the signs of a few form a bucket, several tables of buckets are
kept. A query looks into its own bucket of every table. Exact search stays the contract; this is for
stores where reading every vector for a query is too much.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector_search


def planes(dim: int, tables: int, bits: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables, bits, dim))


def buckets_of(vectors: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A row of bucket numbers, one for each table."""
    signs = np.einsum("nd,tbd->ntb", vectors, cut) > 0
    return (signs << np.arange(cut.shape[1])).sum(2)


def index(chunks: DataFrame, dim: int, tables: int = 16, bits: int = 8, vector: str = "embedding") -> DataFrame:
    """(bucket_table, bucket, chunk_id); to be stored clustered by the first two."""
    cut = planes(dim, tables, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                own = buckets_of(vectors, cut)
                yield pa.record_batch({
                    "bucket_table": pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)), "bucket": pa.array(own.ravel()),
                    "chunk_id": pa.array(np.repeat(batch.column(0).to_numpy(), tables))})

    rows = chunks.where(F.size(vector) == dim).select(F.col("chunk_id").cast("long").alias("chunk_id"), vector)
    return rows.mapInArrow(run, "bucket_table int, bucket long, chunk_id long")


def top(chunks: DataFrame, buckets: DataFrame, query: Sequence[float], limit: int, tables: int = 16, bits: int = 8) -> DataFrame:
    """The best of the chunks that share a bucket with the query."""
    own = buckets_of(np.array([query], np.float64), planes(len(query), tables, bits))[0]
    wanted = F.lit(False)
    for t, b in enumerate(own):
        wanted = wanted | ((F.col("bucket_table") == t) & (F.col("bucket") == int(b)))
    near = buckets.where(wanted).select("chunk_id").distinct()
    return vector_search.top(chunks.join(near, "chunk_id", "left_semi"), query, limit)
