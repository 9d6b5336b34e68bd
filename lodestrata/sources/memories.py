"""The notes of a project, as generations of a small table behind a pointer."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embedding, memory
from ..options import RECALL_LIMIT
from ..schema import MEMORY_SCHEMA
from .store import Files


class MemoryStore:
    """Notes are remembered, recalled and forgotten as of ``now``, by default the time of the call."""

    def __init__(self, spark: SparkSession, path: str, embedder: embedding.Embedder):
        self.spark, self.path, self.embedder, self.files = spark, path.rstrip("/"), embedder, Files(spark)

    def _generation(self) -> int:
        name = f"{self.path}/pointer"
        return int(self.files.read(name)) if self.files.exists(name) else -1

    def read(self) -> DataFrame:
        n = self._generation()
        return self.spark.createDataFrame([], MEMORY_SCHEMA) if n < 0 else self.spark.read.schema(MEMORY_SCHEMA).parquet(f"{self.path}/gen={n}")

    def _commit(self, rows: DataFrame) -> None:
        n = self._generation() + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/gen={n}")
        self.files.write(f"{self.path}/pointer", str(n))
        if self.files.exists(old := f"{self.path}/gen={n - 2}"):
            self.files.delete(old)

    @staticmethod
    def _now(now: datetime | None) -> datetime:
        return now or datetime.now(UTC)

    def remember(self, content: str, *, importance: float = 0.0, tags: Sequence[str] = (), ttl_hours: float = 0.0, now: datetime | None = None) -> int:
        """The new note's id."""
        if not content.strip():
            raise ValueError("empty note")
        vector = [float(x) for x in self.embedder.embed_documents([content])[0]]
        rows = memory.remember(self.read(), content, vector, self._now(now), importance=importance, tags=tags, ttl_hours=ttl_hours)
        self._commit(rows)
        return self.read().agg(F.max("id")).first()[0]

    def recall(self, query: str, *, limit: int = RECALL_LIMIT, tags: Sequence[str] = (), min_importance: float = 0.0, now: datetime | None = None) -> DataFrame:
        if not query.strip():
            raise ValueError("empty query")
        vector = [float(x) for x in self.embedder.embed_query(query)]
        return memory.recall(self.read(), vector, F.lit(self._now(now)), limit=limit, tags=tags, min_importance=min_importance)

    def forget(self, *, confirm: str = "", **what) -> int:
        """How many notes went."""
        before = self.read()
        left = memory.forget(before, confirm=confirm, **what)
        n = before.count() - left.count()
        if n:
            self._commit(left)
        return n

    def forget_expired(self, now: datetime | None = None) -> int:
        before = self.read()
        left = memory.forget_expired(before, F.lit(self._now(now)))
        n = before.count() - left.count()
        if n:
            self._commit(left)
        return n

    def stats(self, now: datetime | None = None) -> dict:
        rows = self.read()
        return memory.statistics(rows, F.lit(self._now(now))).first().asDict() | {"tags": {r["tag"]: r["n"] for r in memory.tag_counts(rows).collect()}}
