"""Embedding texts: the provider contract, a local embedder, and a cache as a table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cache_key
from .packing import requests

BATCH = 64

#: Dimensions of the named presets.
PRESETS = {"fast-local": 768, "quality-code": 1024}


class Embedder(Protocol):
    """What an embedding provider offers. It is pickled to the executors."""

    model: str
    dimensions: int

    def embed_documents(self, texts: Sequence[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashingEmbedder:
    """A deterministic embedder without a model: signed hashes of words and word pairs, unit length."""

    def __init__(self, dimensions: int = PRESETS["fast-local"]):
        self.dimensions, self.model = dimensions, f"hashing-{dimensions}"

    def embed_documents(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            words = re.findall(r"\w+", text.lower())
            for gram in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")
                row[(h >> 1) % self.dimensions] += 1 if h & 1 else -1
            norm = np.linalg.norm(row)
            row /= norm if norm else 1
        return out

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([text])[0]


def keyed(texts: DataFrame, model: str, text_col: str = "text", role: str = "document") -> DataFrame:
    return texts.withColumn("cache_key", cache_key(F.col(text_col), F.lit(model), F.lit(role)))


def embed(texts: DataFrame, embedder: Embedder, text_col: str = "text") -> DataFrame:
    """(cache_key, embedding, error): each text once, in batches. A batch that fails or comes back
    with the wrong shape gives an error for its texts, not for the job."""
    dim = embedder.dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in requests(batch.column(1).to_pylist(), BATCH):
                part = batch.slice(first, last - first)
                error, vectors = None, None
                try:
                    vectors = np.asarray(embedder.embed_documents(part.column(1).to_pylist()), np.float32)
                    if vectors.shape != (part.num_rows, dim):
                        error = f"expected {(part.num_rows, dim)}, got {vectors.shape}"
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                column = pa.nulls(part.num_rows, pa.list_(pa.float32())) if error else pa.array(list(vectors), pa.list_(pa.float32()))
                yield pa.record_batch([part.column(0), column, pa.array([error] * part.num_rows, pa.string())], names=["cache_key", "embedding", "error"])

    once = keyed(texts, embedder.model, text_col).select("cache_key", F.col(text_col).alias("text")).dropDuplicates(["cache_key"])
    return once.mapInArrow(run, "cache_key string, embedding array<float>, error string")


def misses(texts: DataFrame, cache: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    return keyed(texts, model, text_col).join(cache.select("cache_key"), "cache_key", "left_anti")


def merged(cache: DataFrame, other: DataFrame) -> DataFrame:
    """Both caches' entries; of a key in both, the later one."""
    rows = cache.unionByName(other)
    return rows.groupBy("cache_key").agg(F.max_by(F.struct("embedding", "created_at"), "created_at").alias("r")).select("cache_key", "r.embedding", "r.created_at")


def fresh(cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    return cache.where(F.unix_timestamp(now) - F.unix_timestamp("created_at") < ttl_seconds) if ttl_seconds > 0 else cache


def stored_vectors(chunks: DataFrame, model: str) -> DataFrame:
    """The vectors of chunks as a cache (cache_key, embedding): a text that was embedded is not again."""
    return keyed(chunks.where(F.col("embedding").isNotNull()).withColumn("__text", _embedded_text(chunks)), model, "__text").select("cache_key", "embedding").dropDuplicates(["cache_key"])


def _embedded_text(chunks: DataFrame) -> Column:
    return F.coalesce(F.col("embedding_content"), F.col("content")) if "embedding_content" in chunks.columns else F.col("content")


def embedded_chunks(chunks: DataFrame, embedder: Embedder, cache: DataFrame | None = None, once: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Chunks with vectors, of the files all of whose chunks have one, and the newly embedded texts
    (cache_key, embedding, error). A file with one failed chunk is left out whole, to be tried again.
    ``once`` can write the new ones down, so that more than one reader does not embed them twice."""
    rows = keyed(chunks.withColumn("__text", _embedded_text(chunks)), embedder.model, "__text")
    todo = rows if cache is None else rows.join(cache.select("cache_key"), "cache_key", "left_anti")
    new = once(embed(todo.select(F.col("__text").alias("text")), embedder))
    have = new.where("error is null").select("cache_key", "embedding")
    if cache is not None:
        have = have.unionByName(cache.select("cache_key", "embedding"))
    met = rows.join(have, "cache_key", "left")
    # over the chunks of a file, and not by a second look at them: each text is embedded once
    whole = F.bool_and(F.col("embedding").isNotNull()).over(Window.partitionBy("project_root", "relative_path"))
    return met.withColumn("__whole", whole).where("__whole").drop("__text", "__whole", "cache_key"), new
