"""Embeddings by key, kept across indexes: append-only segments behind a pointer.

What is added is one segment, clustered by a prefix of the key; of a key in several segments the entry that was
made last counts. Entries older than the time to live are left out when they are read and go when the segments are
merged, which happens once there are ``MERGE`` of them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embedding
from .store import Files

SCHEMA = "cache_key string, embedding array<float>, created_at timestamp, seg string, prefix string"
MERGE = 8


class EmbeddingCache:
    """``ttl_seconds`` of 0: entries never grow old."""

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int = 0):
        self.spark, self.path, self.ttl, self.files = spark, path.rstrip("/"), ttl_seconds, Files(spark)

    @property
    def segments(self) -> list[str]:
        name = f"{self.path}/pointer.json"
        return json.loads(self.files.read(name)) if self.files.exists(name) else []

    def _all(self) -> DataFrame:
        if not (names := self.segments):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(*[f"{self.path}/{n}" for n in names])

    def entries(self, now: Column | None = None) -> DataFrame:
        """(cache_key, embedding, created_at): the last entry of each key, if it is not too old."""
        rows = embedding.fresh(self._all().select("cache_key", "embedding", "created_at"), F.current_timestamp() if now is None else now, self.ttl)
        last = F.max_by(F.struct("embedding", "created_at"), "created_at")
        return rows.groupBy("cache_key").agg(last.alias("r")).select("cache_key", "r.embedding", "r.created_at")

    def lookup(self, keys: DataFrame, now: Column | None = None) -> DataFrame:
        """The entries of some keys (cache_key)."""
        return self.entries(now).join(keys.select("cache_key").distinct(), "cache_key", "left_semi")

    def add(self, rows: DataFrame, now: Column | None = None) -> None:
        """Add entries (cache_key, embedding and, if known, created_at)."""
        made = F.col("created_at") if "created_at" in rows.columns else F.current_timestamp() if now is None else now
        self._write(rows.select("cache_key", F.col("embedding").cast("array<float>").alias("embedding"), made.cast("timestamp").alias("created_at")), self.segments)
        if len(self.segments) >= MERGE:
            self.compact(now)

    def merge_from(self, other: EmbeddingCache) -> None:
        """Take over another cache's entries; of a key in both the later one counts."""
        self.add(other.entries())

    def compact(self, now: Column | None = None) -> None:
        """One segment of what counts; the old ones go."""
        old = self.segments
        self._write(self.entries(now), [])
        for n in old:
            self.files.delete(f"{self.path}/{n}")

    def _write(self, rows: DataFrame, kept: list[str]) -> None:
        name = f"seg=g{uuid.uuid4().hex}"
        placed = rows.withColumn("prefix", F.substring("cache_key", 1, 1))
        placed.repartition("prefix").sortWithinPartitions("prefix", "cache_key").write.partitionBy("prefix").parquet(f"{self.path}/{name}")
        self.files.write(f"{self.path}/pointer.json", json.dumps([*kept, name]))
