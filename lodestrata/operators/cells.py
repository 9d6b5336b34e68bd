"""Cells of vectors: a search by vector reads those nearest to its query and ranks them exactly.

Centroids are learnt by spherical k-means from a sample of at most ``SAMPLE`` vectors, chosen by a hash of
the id, so its size does not follow the store's. Every vector belongs to the cell of its nearest centroid. How many
cells a search reads is settled when they are learnt: enough for ``RECALL`` of the true neighbours of sampled queries
within the sample. Data without any structure then needs half of the cells; the exact scan stays the contract.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import usable

SAMPLE = 32_768
#: Cells at most; sampled queries, and neighbours of each, that settle the number of probes.
MOST = 1024
QUERIES, NEIGHBOURS, RECALL = 256, 10, 0.95
ROUNDS = 12


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def train(rows: DataFrame, n_rows: int, n_cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL, seed: int = 5) -> tuple[np.ndarray | None, dict]:
    """(centroids, facts) from rows (chunk_id, embedding) of about ``n_rows``; vectors of the most common
    length count."""
    lengths = rows.where(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return None, {"n": 0, "probes": 0, "recall": 1.0}
    some = rows.where(usable(F.col("embedding"), lengths["dim"])).select("embedding", F.xxhash64(F.lit(seed), "chunk_id").alias("h")).orderBy("h").limit(sample)
    vectors = np.array([r["embedding"] for r in some.collect()], np.float64)  # SAMPLE at most
    if not len(vectors):
        return None, {"n": 0, "probes": 0, "recall": 1.0}
    vectors = _unit(vectors)
    n = min(n_cells or max(1, round(n_rows**0.5)), MOST, len(vectors))
    centroids = vectors[np.random.default_rng(seed).permutation(len(vectors))[:n]]
    for _ in range(ROUNDS):
        own = (vectors @ centroids.T).argmax(1)
        sums = np.stack([np.bincount(own, vectors[:, d], n) for d in range(vectors.shape[1])], axis=1)
        full = np.bincount(own, minlength=n) > 0
        centroids = np.where(full[:, None], _unit(sums), centroids)
    probes, got = _probes(vectors, centroids, recall)
    return centroids, {"n": n, "dim": int(lengths["dim"]), "probes": probes, "recall": round(got, 4)}


def _probes(vectors: np.ndarray, centroids: np.ndarray, recall: float) -> tuple[int, float]:
    """The least number of cells that hold enough of the neighbours of sampled queries."""
    own = (vectors @ centroids.T).argmax(1)
    asked = vectors[:QUERIES]
    scores = asked @ vectors.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, :min(NEIGHBOURS, len(vectors) - 1)]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)  # of each cell in a query's order
    needed = np.take_along_axis(place, own[near], axis=1).ravel()
    if not len(needed):
        return 1, 1.0
    probes = int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1
    return probes, float((needed < probes).mean())


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(chunk_id, embedding, cell) of the usable vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = (_matrix(batch.column(1), batch.num_rows) @ centroids.T).argmax(1)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own.astype(np.int32))], names=["chunk_id", "embedding", "cell"])

    return rows.where(usable(F.col("embedding"), centroids.shape[1])).select("chunk_id", "embedding").mapInArrow(run, "chunk_id long, embedding array<float>, cell int")


def nearest_cells(centroids: np.ndarray, query: np.ndarray, probes: int) -> list[int]:
    return [int(c) for c in np.argsort(-(centroids @ query), kind="stable")[:probes]]
