"""Keyword ranking by BM25, from text or from a stored index.

``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``, k1 = 1.2, b = 0.75. N, df and the mean length are
those of the whole store; filters only restrict candidates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..options import FilterOptions
from ..schema import TEXT_FIELDS
from .filters import marked

K1, B = 1.2, 0.75
#: Postings of a block, at most; tokens that a task turns into blocks at a time, about.
BLOCK, GROUP = 4096, 2_000_000


def searchable(chunks: DataFrame) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in TEXT_FIELDS if c in chunks.columns])


def terms_of(spark: SparkSession, queries: list[str]) -> list[list[str]]:
    """Distinct terms of each query, tokenised as the texts are."""
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "i int, q string")
    found = rows.select("i", F.array_sort(F.array_distinct(tokens(F.col("q")))).alias("t")).collect()
    return [list(r["t"]) for r in sorted(found, key=lambda r: r["i"])]


def query_terms(chunks: DataFrame, query: str) -> list[str]:
    return terms_of(chunks.sparkSession, [query])[0]


def _occurrences(tokens_: str, term: str) -> Column:
    return F.size(tokens_) - F.size(F.array_remove(tokens_, term))


def _weight(tf: Column, length: Column, df: Column, n: Column, mean: Column) -> Column:
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def counts(chunks: DataFrame, terms: Sequence[str], o: FilterOptions | None = None, *more: Column) -> DataFrame:
    """(chunk_id, __ok, __n, __f0, ..) and ``more`` columns: whether a chunk passes the filters, its
    length, and how often it holds each term. Texts are tokenised once; what is exchanged, for the
    statistics and for the scores, is a few numbers a chunk.

    There is no filter here on purpose: it would be pushed below the exchange, where it would have
    texts tokenised again for every term, and the two uses of the exchange would differ.
    """
    each = marked(chunks, o or FilterOptions(), "__ok").select("chunk_id", "__ok", tokens(searchable(chunks)).alias("__t"), *more)
    kept = [c for c in each.columns if c not in ("chunk_id", "__ok", "__t")]
    return each.select("chunk_id", "__ok", F.size("__t").alias("__n"), *[_occurrences("__t", t).alias(f"__f{i}") for i, t in enumerate(terms)], *kept).repartition("chunk_id")


def with_statistics(counted: DataFrame, terms: Sequence[str], *more: Column) -> DataFrame:
    """Counts beside the one row of statistics that they (and ``more`` aggregates) add up to."""
    sums = counted.agg(
        *more, F.count(F.lit(1)).cast("double").alias("__count"), F.avg("__n").alias("__mean"), F.count_if("__ok").alias("__candidates"),
        *[F.count_if(F.col(f"__f{i}") > 0).cast("double").alias(f"__d{i}") for i in range(len(terms))])
    return counted.crossJoin(F.broadcast(sums))  # one row


def score_of(own: Sequence[str], terms: Sequence[str]) -> Column:
    """The score of a row of ``with_statistics`` for a query of ``own`` terms; null without any of them."""
    total, some = F.lit(0.0), F.lit(False)
    for i in (i for i, t in enumerate(terms) if t in own):
        total = total + _weight(F.col(f"__f{i}"), F.col("__n"), F.col(f"__d{i}"), F.col("__count"), F.col("__mean"))
        some = some | (F.col(f"__f{i}") > 0)
    return F.when(F.col("__ok") & some & (F.col("__candidates") > 0), total)


def scores(chunks: DataFrame, query: str | list[str], o: FilterOptions | None = None) -> DataFrame:
    """(chunk_id, bm25), null for chunks without a term of the query (or of a list of terms)."""
    own = query_terms(chunks, query) if isinstance(query, str) else query
    if not own:
        return chunks.where("false").select("chunk_id", F.lit(0.0).alias("bm25"))
    return with_statistics(counts(chunks, own, o), own).select("chunk_id", score_of(own, own).alias("bm25"))


def top(chunks: DataFrame, query: str | list[str], limit: int, o: FilterOptions | None = None) -> DataFrame:
    """The ``limit`` best chunks, with ``bm25``, ties by id."""
    best = scores(chunks, query, o).withColumn("bm25", F.round("bm25", 6)).orderBy(F.desc_nulls_last("bm25"), "chunk_id").limit(limit).where("bm25 is not null")
    return chunks.join(F.broadcast(best), "chunk_id").orderBy(F.desc("bm25"), "chunk_id")  # at most a limit of rows


# ---- the stored index


def length(chunks: DataFrame) -> Column:
    return F.size(tokens(searchable(chunks)))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, length): one row per term of a chunk. A chunk's tokens are sorted and counted by
    their runs where they are, so nothing is exchanged."""
    ordered = chunks.select("chunk_id", F.array_sort(tokens(searchable(chunks))).alias("t"))
    fresh = lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1))
    begins = ordered.where(F.size("t") > 0).select("chunk_id", "t", F.filter(F.sequence(F.lit(0), F.size("t") - 1), fresh).alias("b"))
    count = lambda at, j: (F.coalesce(F.get("b", j + 1), F.size("t")) - at).cast("long")
    runs = F.transform("b", lambda at, j: F.struct(F.get("t", at).alias("term"), count(at, j).alias("tf")))
    return begins.select("chunk_id", F.size("t").alias("length"), F.explode(runs).alias("r")).select("r.term", "chunk_id", "r.tf", "length")


def blocks(chunks: DataFrame) -> DataFrame:
    """The postings as blocks (term, base, ids, tfs, lengths): for a term up to ``BLOCK`` of its chunks, whose ids
    are ``base`` plus ``ids``. A task takes some ``GROUP`` tokens at a time, and every group has blocks of its
    own, so a common term is no burden."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                held.append(batch.slice(first, 256))
                n += len(held[-1].column(1).flatten())
                if n >= GROUP:
                    yield from _grouped(held, BLOCK)
                    held, n = [], 0
        if n:
            yield from _grouped(held, BLOCK)

    return chunks.select(F.col("chunk_id").cast("long"), tokens(searchable(chunks))).mapInArrow(run, "term string, base long, ids array<int>, tfs array<int>, lengths array<int>")


def _grouped(held: list[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    lists = table.column(1).combine_chunks()
    ids, length = table.column(0).to_numpy(), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    by = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by] = np.arange(len(ids))
    words = lists.flatten().dictionary_encode()
    met, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(place, length), return_counts=True)
    code, own = met // len(ids), by[met % len(ids)]
    high, low = ids[own] >> 31, (ids[own] & 0x7FFFFFFF).astype(np.int32)
    new = np.ones(len(met), bool)
    new[1:] = (code[1:] != code[:-1]) | (high[1:] != high[:-1])
    at = np.arange(len(met))
    begin = np.flatnonzero(new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % most == 0))
    columns = [low, tf.astype(np.int32), length[own].astype(np.int32)]
    for first in range(0, len(begin), 1 << 15):
        some = begin[first:first + (1 << 15)]
        end = begin[first + (1 << 15)] if first + (1 << 15) < len(begin) else len(met)
        offsets = pa.array(np.append(some, end) - some[0], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [words.dictionary.take(pa.array(code[some])), pa.array(high[some] << 31), *(pa.ListArray.from_arrays(offsets, pa.array(c[some[0]:end])) for c in columns)], ["term", "base", "ids", "tfs", "lengths"])


def unpacked(index: DataFrame, *more: str) -> DataFrame:
    """(term, chunk_id, tf, length) and ``more`` columns from blocks."""
    each = index.select("term", "base", *more, F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p"))
    return each.select("term", (F.col("base") + F.col("p.ids")).alias("chunk_id"), F.col("p.tfs").cast("long").alias("tf"), F.col("p.lengths").alias("length"), *more)


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """(term, df, tf) from text: a chunk's tokens count for tf, its different ones for df. No postings are made, and a
    task adds up its terms before they are exchanged."""
    text = chunks.select(tokens(searchable(chunks)).alias("t"))
    sides = text.select(F.explode(F.array(F.struct(F.col("t").alias("t"), F.lit(0).alias("d")), F.struct(F.array_distinct("t").alias("t"), F.lit(1).alias("d")))).alias("s"))
    each = sides.select(F.explode("s.t").alias("term"), F.col("s.d").alias("d"))
    return each.groupBy("term").agg(F.sum("d").alias("df"), F.sum(1 - F.col("d")).alias("tf"))


def length_stats(chunks: DataFrame) -> DataFrame:
    return chunks.select(length(chunks).alias("n")).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n").alias("n_tokens"), F.avg("n").alias("mean_length"), F.max("n").alias("max_length"))


def top_indexed(index: DataFrame, stats: DataFrame, query: str, limit: int) -> DataFrame:
    """(chunk_id, bm25) from stored postings (clustered by term) and length statistics: only the
    query's postings are read."""
    terms = query_terms(index, query)
    own = index.where(F.col("term").isin(terms))
    df = own.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    one = stats.select(F.col("n_chunks").cast("double").alias("N"), "mean_length")
    weighed = own.join(F.broadcast(df), "term").crossJoin(F.broadcast(one))  # as many rows as the query has terms; one row
    total = weighed.groupBy("chunk_id").agg(F.sum(_weight(F.col("tf"), F.col("length"), F.col("df"), F.col("N"), F.col("mean_length"))).alias("bm25"))
    return total.withColumn("bm25", F.round("bm25", 6)).orderBy(F.desc("bm25"), "chunk_id").limit(limit)


def scored(index: DataFrame, n_chunks: float, mean_length: float) -> DataFrame:
    """(term, chunk_id, weight) from the postings of some terms and the whole store's statistics. The
    frequency of a term is the number of its postings."""
    df = index.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    return index.join(F.broadcast(df), "term").select("term", "chunk_id", _weight(F.col("tf"), F.col("length"), F.col("df"), F.lit(float(n_chunks)), F.lit(float(mean_length))).alias("weight"))


def top_stored(index: DataFrame, n_chunks: float, mean_length: float, limit: int, candidates: DataFrame | None = None) -> DataFrame:
    """(chunk_id, bm25) of the ``limit`` best, from a query's postings; of ``candidates`` (chunk_id) only."""
    weights = scored(index, n_chunks, mean_length)
    if candidates is not None:
        weights = weights.join(candidates.select("chunk_id"), "chunk_id", "left_semi")
    return weights.groupBy("chunk_id").agg(F.round(F.sum("weight"), 6).alias("bm25")).orderBy(F.desc("bm25"), "chunk_id").limit(limit)
