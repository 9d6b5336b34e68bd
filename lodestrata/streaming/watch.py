"""Keeping an index current from a stream of file events; windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.scan import watch_ignored

TICK = "500 milliseconds"
#: Changed paths of a batch up to so many are looked at one by one, beyond that by a scan.
LISTED = 10_000
INDEXED, REMOVED = ("create", "write"), ("remove", "rename")


def latest(events: DataFrame) -> DataFrame:
    """(path, op, ts): the last event of each path; of events at one time the op that sorts last."""
    return events.groupBy("path").agg(F.max(F.struct("ts", "op")).alias("e")).select("path", "e.op", "e.ts")


def split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths to index, paths to remove) of the latest events, sorted."""
    last = latest(events)
    return tuple(last.where(F.col("op").isin(*ops)).select("path").orderBy("path") for ops in (INDEXED, REMOVED))  # type: ignore[return-value]


def watch(events: DataFrame, apply: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, ignore: list[str] | None = None, tick: str | None = TICK, name: str | None = None) -> StreamingQuery:
    """Apply a stream of events (path, op, ts) tick by tick: ``apply(to_index, to_remove, batch_id)``.
    A batch may come again after a failure, with the same number; applying it must be idempotent, as
    replacing files in a store is. Without a tick what is there is worked off and the query ends."""
    def each(batch: DataFrame, batch_id: int) -> None:
        kept = batch.where(~watch_ignored(F.col("path"), ignore or [])).persist()
        try:
            if not kept.isEmpty():
                apply(*split(kept), batch_id)
        finally:
            kept.unpersist()

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(processingTime=tick) if tick else writer.trigger(availableNow=True)).start()


def event_time(ts: Column) -> Column:
    """Times without a zone as instants: watermarks need them."""
    return ts.cast("timestamp")


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    return _windowed(events, F.window("ts", width), late)


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str | None = None) -> DataFrame:
    return _windowed(events, F.window("ts", width, step), late)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(window_start, window_end, key, n, total) of runs of a key's events without a longer gap."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "key", "n", "total")


def _windowed(events: DataFrame, window: Column, late: str | None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(window.alias("w"), "key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "key", "n", "total")
