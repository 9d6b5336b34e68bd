"""Tagged notes: remember, recall, forget, statistics. "Now" is always given."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import cosine_constant, usable
from ..options import RECALL_LIMIT
from ..schema import MEMORY_SCHEMA

HALF_LIFE_HOURS, BOOST = 720.0, 0.25


def remember(memories: DataFrame, content: str, embedding: Sequence[float], now: datetime, *, importance: float = 0.0, tags: Sequence[str] = (), ttl_hours: float = 0.0) -> DataFrame:
    """The table with one more note: importance of 0 or less means 0.5, over 1 means 1."""
    last = memories.agg(F.max("id")).first()[0] or 0
    weight = 0.5 if importance <= 0 else min(importance, 1.0)
    row = (last + 1, content, weight, [t.strip() for t in tags if t.strip()], now, now + timedelta(hours=ttl_hours) if ttl_hours > 0 else None, [float(x) for x in embedding])
    return memories.unionByName(memories.sparkSession.createDataFrame([row], MEMORY_SCHEMA))


def alive(now: Column) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") >= now)


def has_tags(tags: Sequence[str]) -> Column:
    """All of the tags, exactly."""
    return F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.col("tags"))) == 0 if tags else F.lit(True)


def recall(memories: DataFrame, query: Sequence[float], now: Column, *, limit: int = RECALL_LIMIT, tags: Sequence[str] = (), min_importance: float = 0.0, half_life: float = HALF_LIFE_HOURS, boost: float = BOOST) -> DataFrame:
    """Notes by similarity, faded with age and raised with importance. What has expired is left out
    before the cut."""
    rows = memories.where(alive(now) & has_tags(tags) & usable(F.col("embedding"), len(query)))
    if min_importance > 0:
        rows = rows.where(F.col("importance") >= min_importance)
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp("created_at")) / 3600.0
    fade = F.pow(F.lit(0.5), age / half_life) if half_life > 0 else F.lit(1.0)
    similarity = cosine_constant("embedding", query)
    scored = rows.withColumn("similarity", F.round(similarity, 6)).withColumn("score", F.round(similarity * fade * (1 + boost * F.col("importance")), 6))
    return scored.drop("embedding").orderBy(F.desc("score"), "id").limit(limit)


def _some_tag_with(part: str) -> Column:
    return F.exists("tags", lambda x: F.contains(x, F.lit(part)))


def forgets(*, id: int | None = None, tags: Sequence[str] = (), older_than: Column | None = None) -> Column:
    """What a forget takes: the id alone if it is given; else notes with a tag that contains one of
    the given ones, and notes created before the given time."""
    if id is not None:
        return F.col("id") == id
    out = F.lit(False)
    for t in tags:
        out = out | _some_tag_with(t)
    return out | (F.col("created_at") < older_than) if older_than is not None else out


def forget(memories: DataFrame, *, confirm: str = "", **what) -> DataFrame:
    """The table without what is forgotten; all but a single id needs ``confirm="yes"``."""
    if what.get("id") is None and confirm != "yes":
        raise ValueError('forgetting several memories needs confirm="yes"')
    return memories.where(~forgets(**what))


def forget_expired(memories: DataFrame, now: Column) -> DataFrame:
    return memories.where(alive(now))


def statistics(memories: DataFrame, now: Column) -> DataFrame:
    """One row: notes, expired and live ones, oldest and newest, distinct tags."""
    tags = memories.select(F.explode("tags").alias("t")).agg(F.count_distinct("t").alias("distinct_tags"))
    row = memories.agg(
        F.count(F.lit(1)).alias("memories"), F.count_if(~alive(now)).alias("expired"), F.count_if(alive(now)).alias("live"),
        F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
    return row.crossJoin(F.broadcast(tags))  # one row each


def tag_counts(memories: DataFrame) -> DataFrame:
    return memories.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")
