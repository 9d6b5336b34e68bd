"""Packing texts into requests under a budget of texts and of bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A request has at most so many texts and bytes; a longer text is a request of its own.
TEXTS, BYTES = 64, 1 << 18


def requests(texts: Sequence[str], most: int = TEXTS, most_bytes: int = BYTES) -> Iterator[tuple[int, int]]:
    """(first, last) of the requests that a task makes of its texts, in order: as many as fit."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text.encode())
        if i > first and (i - first >= most or held + size > most_bytes):
            yield first, i
            first, held = i, 0
        held += size
    if first < len(texts):
        yield first, len(texts)


def summed_before(rows: DataFrame, key: str, size: Column) -> DataFrame:
    """(key, size, before): what the sizes of all smaller keys add up to. Keys are dealt by ranges; each adds up
    its own, and a row for each range says where it begins."""
    spread = rows.select(key, size.cast("long").alias("size")).repartitionByRange(key).sortWithinPartitions(key).withColumn("__p", F.spark_partition_id())
    sums = spread.groupBy("__p").agg(F.sum("size").alias("__s"))
    begin = F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = F.broadcast(sums.select(F.col("__p").alias("__q"), F.coalesce(begin, F.lit(0)).alias("__begin")))
    own = F.sum("size").over(Window.partitionBy("__p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return spread.withColumn("__own", F.coalesce(own, F.lit(0))).join(starts, F.col("__p") == F.col("__q")).select(key, "size", (F.col("__begin") + F.col("__own")).alias("before"))


def packed(rows: DataFrame, key: str, size: Column, most: int = TEXTS, most_bytes: int = BYTES) -> DataFrame:
    """(key, size, request): texts, by a unique key and their bytes, as requests of at most ``most`` texts and
    ``most_bytes`` bytes, all worked out at once. Sizes in the order of keys make a line, cut at every
    ``most_bytes``: what lies between two cuts is one request, what crosses a cut another (one text, or several
    empty ones), and a request of too many texts is split. A request is named ``cut:crossing:part``."""
    line = summed_before(rows, key, size)
    cut, end = F.floor(F.col("before") / most_bytes), F.floor((F.col("before") + F.greatest(F.col("size"), F.lit(1)) - 1) / most_bytes)
    placed = line.withColumn("__cut", cut).withColumn("__over", (end > cut).cast("int"))
    part = F.floor((F.row_number().over(Window.partitionBy("__cut", "__over").orderBy(key)) - 1) / most)
    return placed.select(key, "size", F.concat_ws(":", F.col("__cut").cast("string"), F.col("__over").cast("string"), part.cast("string")).alias("request"))
