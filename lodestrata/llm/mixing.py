"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate (its target share of the rows over its actual share). Each
document draws its count from the Poisson distribution with that mean by inverting the distribution
function at a hash of its id, is repeated that often, and the copies are shuffled globally by a
second hash. The draw depends on nothing but seed, id and rate, so lost executors change nothing.

Defined results: a null source is a source of its own; a null id draws as the text ``null``; rows
with the same id draw the same count; null or empty texts are repeated like any other; every input
column is kept (clashing names: the input's ``copy_no``, ``rate`` or ``shuffle_key`` gives way);
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SEED = 20240
#: Share of a source before normalising: its row count to this power.
ALPHA = 0.5
#: A larger mean is drawn as a sum of parts with at most this mean; a part's table of the
#: distribution function is long enough that what lies beyond is under 2**-52.
PART = 32
TABLE = 160
#: Rates go by broadcast up to so many sources, which is checked, and by a shuffled join beyond.
BROADCAST_SOURCES = 10_000


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, source_col: str = "source") -> DataFrame:
    """(source, n_docs, rate): mean repetitions that bring each source to its target share while the
    expected total stays the number of rows. ``weights`` names shares; other sources get none."""
    counts = materialize(docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs")), "source-counts")
    if weights is None:
        want = F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha)))
    else:
        want = F.lit(0.0)
        for name, w in weights.items():
            want = F.when(F.col("source") == name, F.lit(float(w))).otherwise(want)
    total = counts.agg(F.sum("n_docs").alias("n"), F.sum(want).alias("w")).first()
    n, w = float(total["n"] or 0), float(total["w"] or 0)
    rate = want / F.lit(w) * F.lit(n) / F.col("n_docs") if w else F.lit(0.0)
    return counts.select("source", "n_docs", F.round(rate, 9).alias("rate"))


def uniform(key: Column) -> Column:
    """The first 52 bits of a text's MD5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def poisson_law(rate: Column) -> Column:
    """The Poisson law with this mean: into how many equal parts it is split, and a part's table of
    the distribution function."""
    parts = F.greatest(F.lit(1), F.ceil(rate / PART).cast("int"))
    mean = rate / parts

    def grow(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        return F.struct(p.alias("p"), (acc["f"] + p).alias("f"), F.concat(acc["t"], F.array(acc["f"] + p)).alias("t"))
    first = F.exp(-mean)
    table = F.aggregate(
        F.sequence(F.lit(1), F.lit(TABLE)),
        F.struct(first.alias("p"), first.alias("f"), F.array(first).alias("t")), grow, lambda acc: acc["t"])
    return F.struct(parts.alias("parts"), table.alias("table"))


def draws(law: Column, key: Column) -> Column:
    """The uniform numbers of a document, one for each part of its law."""
    return F.transform(F.sequence(F.lit(1), law["parts"]), lambda j: uniform(F.concat_ws(":", F.lit(str(SEED)), j.cast("string"), key)))


def drawn(law: Column, numbers: Column) -> Column:
    """Copies of a document: the law's distribution function inverted at its uniform numbers."""
    one = lambda acc, u: acc + F.size(F.filter(law["table"], lambda c: c <= u))
    return F.when(F.element_at(law["table"], 1) >= 1, 0).otherwise(F.aggregate(numbers, F.lit(0), one))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The documents, each as often as drawn, with ``copy_no`` (from 1), ``rate`` and
    ``shuffle_key``; partitions and the order within them follow ``shuffle_key``."""
    table = rates(docs, weights, alpha, source_col)
    table = table.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), poisson_law(F.col("rate")).alias("__law"))
    if table.select("__source").count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    kept = [c for c in docs.columns if c not in ("copy_no", "rate", "shuffle_key")]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    many = docs.join(table, docs[source_col].eqNullSafe(F.col("__source"))).withColumn("__n", drawn(F.col("__law"), draws(F.col("__law"), key))).where("__n > 0")
    copies = many.select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n").cast("long"))).alias("copy_no"), F.col("__rate").alias("rate"))
    shuffled = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit("order"), F.lit(str(SEED)), F.col("copy_no").cast("string"), key).cast("binary")))
    return shuffled.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
