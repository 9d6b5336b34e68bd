"""Search modes, similar chunks and batches of queries."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import substance
from ..functions.vector import clamp01, cosine_constant, usable
from ..options import FilterOptions, SearchOptions, fetch_size
from ..schema import RESULT_COLUMNS
from . import bm25, vector_search
from .filters import filtered

Embed = Callable[[str], Sequence[float]]

#: Queries of a batch that share a scan; a plan grows with them.
TOGETHER = 16
#: Hits up to so many are looked up by a list of ids, which prunes the scan, beyond that by a join.
LISTED = 1000
#: Levels of dyadic blocks of lines: line numbers are ints.
LEVELS = 32


class Stored(Protocol):
    """The indexes that a store keeps of its chunks (see ``sources.store.ChunkStore``)."""

    def postings(self, terms: Sequence[str]) -> DataFrame: ...

    def length_stats(self) -> tuple[int, float]: ...

    def near(self, query: Sequence[float], probes: int | None = None) -> DataFrame | None: ...


def fused(weights: tuple[float, float]) -> Column:
    """The score of a row (cosine, bm25, substance, __best) of which either side can be missing."""
    vector, text = weights
    of_text = F.when(F.col("__best") > 0, F.col("bm25") / F.col("__best") * F.col("substance"))
    return F.round(F.lit(vector) * F.coalesce(clamp01(F.col("cosine")), F.lit(0.0)) + F.lit(text) * F.coalesce(of_text, F.lit(0.0)), 6)


def fuse(vector_hits: DataFrame, text_hits: DataFrame, weights: tuple[float, float], limit: int) -> DataFrame:
    """(chunk_id, score, cosine, bm25) from hits (chunk_id, cosine) and (chunk_id, bm25, substance).
    Text scores count against the best of the text hits and are damped for chunks with little in
    them. Both sides are bounded by the fetch size, so the outer join is tiny."""
    best = text_hits.agg(F.max("bm25").alias("__best"))
    met = vector_hits.join(text_hits, "chunk_id", "full_outer").crossJoin(F.broadcast(best))  # one row
    return met.select("chunk_id", fused(weights).alias("score"), "cosine", "bm25").orderBy(F.desc("score"), "chunk_id").limit(limit)


def hybrid(chunks: DataFrame, vector: Sequence[float], query: str | list[str], o: SearchOptions, stored: Stored | None = None) -> DataFrame:
    """(chunk_id, score, cosine, bm25), best first. ``query`` may be a list of terms."""
    n = fetch_size(o.top)
    by_vector = top_by_vector(chunks, vector, n, o.filters, stored).select("chunk_id", "cosine")
    by_text = top_by_text(chunks, query, n, o.filters, stored).select("chunk_id", "bm25", substance(F.col("content")).alias("substance"))
    return fuse(by_vector, by_text, o.weights, o.top)


def semantic(chunks: DataFrame, vector: Sequence[float], o: SearchOptions, stored: Stored | None = None) -> DataFrame:
    return top_by_vector(chunks, vector, o.top, o.filters, stored).select("chunk_id", F.col("cosine").alias("score"), F.col("cosine").alias("distance"))


def candidates(chunks: DataFrame, o: FilterOptions) -> DataFrame | None:
    """(chunk_id) of what passes the filters; None if there are none."""
    return None if o == FilterOptions() else filtered(chunks, o).select("chunk_id")


def looked_up(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """A bounded number of hits (chunk_id, ..) with the columns of their chunks. Their ids go to the
    scan as a filter, so that row groups without any are passed over."""
    rows = hits.collect()  # a limit of rows
    local = hits.sparkSession.createDataFrame(rows, hits.schema)
    near = chunks.where(F.col("chunk_id").isin([r["chunk_id"] for r in rows])) if len(rows) <= LISTED else chunks
    return near.join(F.broadcast(local), "chunk_id")


def top_by_text(chunks: DataFrame, query: str | list[str], n: int, o: FilterOptions, stored: Stored | None = None) -> DataFrame:
    """The ``n`` best chunks, with ``bm25``: from the stored postings of the query's terms if there are any."""
    if stored is None:
        return bm25.top(chunks, query, n, o)
    terms = bm25.query_terms(chunks, query) if isinstance(query, str) else query
    hits = bm25.top_stored(stored.postings(terms), *stored.length_stats(), n, candidates(chunks, o))
    return looked_up(hits, chunks).orderBy(F.desc("bm25"), "chunk_id")


def top_by_vector(chunks: DataFrame, vector: Sequence[float], n: int, o: FilterOptions, stored: Stored | None = None) -> DataFrame:
    """The ``n`` best chunks, with ``cosine``: of the cells nearest to the vector if the store has cells
    and they hold enough candidates, else of all."""
    near = None if stored is None else stored.near(vector)
    if near is not None:
        wanted = candidates(chunks, o)
        rows = near if wanted is None else near.join(wanted, "chunk_id", "left_semi")
        hits = vector_search.top(rows, vector, n).select("chunk_id", "cosine").collect()  # a limit of rows
        if len(hits) == n:
            return chunks.sparkSession.createDataFrame(hits, "chunk_id long, cosine double").orderBy(F.desc("cosine"), "chunk_id")
    return vector_search.top(chunks, vector, n, o)


def normalised(hits: DataFrame) -> DataFrame:
    """Keyword hits with ``score`` against the best of them; ``distance`` keeps the raw value. The
    hits are at most a limit, so one task is enough."""
    best = F.max("bm25").over(Window.partitionBy())
    return hits.withColumn("score", F.when(best > 0, F.round(F.col("bm25") / best, 6)).otherwise(F.lit(0.0))).withColumn("distance", F.col("bm25"))


def keyword(chunks: DataFrame, query: str, o: SearchOptions, stored: Stored | None = None) -> DataFrame:
    return normalised(top_by_text(chunks, query, o.top, o.filters, stored)).select("chunk_id", "score", "distance")


def with_min_score(hits: DataFrame, least: float) -> DataFrame:
    return hits.where(F.col("score") >= least) if least > 0 else hits


def results(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the columns of their chunks, best first."""
    have = hits if "distance" in hits.columns else hits.withColumn("distance", F.col("score"))
    wide = looked_up(have.select("chunk_id", "score", "distance"), chunks)
    return wide.select(*[c for c in RESULT_COLUMNS if c in wide.columns]).orderBy(F.desc("score"), "chunk_id")


def search(chunks: DataFrame, query: str, o: SearchOptions, embed: Embed | None, stored: Stored | None = None) -> tuple[DataFrame, list[str]]:
    """Hits with chunk columns, and warnings. A hybrid search whose embedder fails goes on with
    keywords and says so; a semantic one fails. With ``stored`` indexes no text is tokenised."""
    if not query.strip():
        raise ValueError("empty query")
    warnings: list[str] = []
    vector = None
    if o.mode != "keyword":
        try:
            if embed is None:
                raise RuntimeError("no embedder")
            vector = embed(query)
        except Exception as error:
            if o.mode == "semantic":
                raise
            warnings.append(f"embedding failed, keywords only: {error}")
    if o.mode == "semantic":
        hits = semantic(chunks, vector, o, stored)
    elif vector is None:
        hits = keyword(chunks, query, o, stored)
    else:
        hits = hybrid(chunks, vector, query, o, stored)
    return results(with_min_score(hits, o.min_score), chunks), warnings


def explain(chunks: DataFrame, query: str, o: SearchOptions, embed: Embed | None, stored: Stored | None = None) -> dict:
    """A search in the mode that was asked for: its plan, how many chunks its filters leave, how many
    vectors and postings it looked at, how many hits came back and in how many seconds."""
    begin = time.perf_counter()
    found, warnings = search(chunks, query, o, embed, stored)
    n = found.count()
    seconds = time.perf_counter() - begin
    left = filtered(chunks, o.filters).count()
    by_text, by_vector = o.mode != "semantic", o.mode != "keyword" and not warnings
    near = stored.near(embed(query)) if stored is not None and by_vector else None
    plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return {
        "mode": o.mode, "index": "exact" if near is None else "cells", "candidates": left, "hits": n, "seconds": round(seconds, 3), "warnings": warnings, "plan": plan,
        "vectors": 0 if not by_vector else left if near is None else near.count(), "postings": stored.postings(bm25.query_terms(chunks, query)).count() if stored is not None and by_text else 0}


# ---- similar chunks


def similar_by_vector(chunks: DataFrame, vector: Sequence[float], limit: int, o: FilterOptions | None = None, drop: Column | None = None, min_score: float = 0.0) -> DataFrame:
    """Nearest chunks, unwanted ones left out before the cut, so that the limit is always filled."""
    rows = chunks if drop is None else chunks.where(~drop)
    hits = vector_search.top(rows, vector, limit, o).select("chunk_id", F.col("cosine").alias("score"))
    return with_min_score(hits, min_score)


def vector_of(chunks: DataFrame, chunk_id: int) -> tuple[Sequence[float], str]:
    row = chunks.where(F.col("chunk_id") == chunk_id).select("embedding", "relative_path").first()
    if row is None:
        raise LookupError(f"no chunk {chunk_id}")
    return row["embedding"], row["relative_path"]


def similar_by_id(chunks: DataFrame, chunk_id: int, limit: int, *, exclude_source: bool = True, exclude_same_file: bool = False, o: FilterOptions | None = None, min_score: float = 0.0) -> DataFrame:
    vector, path = vector_of(chunks, chunk_id)
    drop = F.lit(False)
    if exclude_source:
        drop = drop | (F.col("chunk_id") == chunk_id)
    if exclude_same_file:
        drop = drop | (F.col("relative_path") == path)
    return similar_by_vector(chunks, vector, limit, o, drop, min_score)


def _covering(first: Column, last: Column) -> Column:
    """The dyadic blocks (level, block) that a range of lines falls into: at most two at each level."""
    def at(k: Column) -> Column:
        low = F.call_function("shiftright", first + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
        high = F.call_function("shiftright", last + 1, k)
        odd = lambda n: n.bitwiseAND(F.lit(1)) == 1
        block = lambda n, use: F.when((low < high) & use, F.struct(k.alias("level"), n.alias("block")))
        return F.array_compact(F.array(block(low, odd(low)), block(high - 1, odd(high))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at))


def chunk_at(chunks: DataFrame, locations: DataFrame) -> DataFrame:
    """The smallest chunk around each location (relative_path, line), ties by id. The lines of a chunk are cut
    into dyadic blocks, of each of which only the best chunk is kept; a line looks into the block of each
    level that holds it. So both sides meet in an equi-join, however many chunks and lines a file has."""
    span = F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "chunk_id")
    cut = chunks.where("start_line <= end_line").select("relative_path", span.alias("s"), F.explode(_covering(F.col("start_line").cast("long"), F.col("end_line").cast("long"))).alias("b"))
    best = cut.groupBy("relative_path", "b.level", "b.block").agg(F.min("s").alias("s"))
    line = F.col("line").cast("long")
    held = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", line, k).alias("block")))
    asked = locations.select("relative_path", "line").distinct().select("relative_path", "line", F.explode(held).alias("b")).select("relative_path", "line", "b.level", "b.block")
    met = asked.join(best, ["relative_path", "level", "block"]).groupBy("relative_path", "line").agg(F.min("s").alias("b"))
    return met.select("relative_path", "line", "b.chunk_id", "b.span")


def similar_by_location(chunks: DataFrame, path: str, line: int, limit: int, **options) -> DataFrame:
    spot = chunks.sparkSession.createDataFrame([(path, line)], "relative_path string, line int")
    row = chunk_at(chunks.where(F.col("relative_path") == path), spot).first()
    if row is None:
        raise LookupError(f"no chunk at {path}:{line}")
    return similar_by_id(chunks, row["chunk_id"], limit, **(options | {"exclude_source": True}))


def by_file(chunks: DataFrame, path: str) -> DataFrame:
    """All chunks of a file: by relative path, or else by absolute path."""
    own = chunks.where(F.col("relative_path") == path)
    if "file_path" in chunks.columns and own.isEmpty():
        own = chunks.where(F.col("file_path") == path)
    return own.withColumn("score", F.lit(1.0)).withColumn("distance", F.lit(0.0)).orderBy("start_line", "chunk_id")


# ---- batches


def deduplicated(hits: DataFrame) -> DataFrame:
    """Of hits (query_no, rank, chunk_id, ..) each chunk only under the first query that found it."""
    order = Window.partitionBy("chunk_id").orderBy("query_no", "rank")
    return hits.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def _ranked(rows: DataFrame, best: str, limit: int, *groups: str) -> DataFrame:
    """The first ``limit`` of each group by a column, ties by id; each task sends on no more than that."""
    order = Window.partitionBy(*groups).orderBy(F.desc(best), "chunk_id")
    return rows.where(F.col(best).isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _together(chunks: DataFrame, asked: Sequence[tuple[int, Sequence[float], list[str]]], o: SearchOptions) -> DataFrame:
    """(query_no, rank, chunk_id, score) of hybrid searches (number, vector, terms): one scan tokenises
    each text once and works out all cosines, and one window finds the best of both sides."""
    terms = sorted({t for _, _, own in asked for t in own})
    cosines = [F.when(F.col("__ok") & usable(F.col("embedding"), len(v)), F.round(cosine_constant("embedding", v), 6)) for _, v, _ in asked]
    counted = bm25.counts(chunks, terms, o.filters, F.array(substance(F.col("content")), *cosines).alias("__x"))
    # the statistics look at __x as well, or the two uses of the exchange would differ and both be computed
    wide = bm25.with_statistics(counted, terms, F.count_if(F.size("__x") > 0).alias("__rows")).where("__rows > 0")
    scores = wide.select("chunk_id", "__x", *[F.round(bm25.score_of(own, terms), 6).alias(f"__b{j}") for j, (_, _, own) in enumerate(asked)])
    sides = [F.struct(F.lit(no).alias("query_no"), F.lit(side).alias("side"), value.alias("value"))
             for j, (no, _, _) in enumerate(asked) for side, value in enumerate((F.get("__x", F.lit(j + 1)), F.col(f"__b{j}")))]
    rows = scores.select("chunk_id", F.get("__x", F.lit(0)).alias("substance"), F.explode(F.array(*sides)).alias("q")).select("chunk_id", "substance", "q.*")
    best = _ranked(rows, "value", fetch_size(o.top), "query_no", "side")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("value")))
    met = best.groupBy("query_no", "chunk_id").agg(of(0).alias("cosine"), of(1).alias("bm25"), F.max("substance").alias("substance"))
    met = met.withColumn("__best", F.max("bm25").over(Window.partitionBy("query_no")))
    return _ranked(met.withColumn("score", fused(o.weights)), "score", o.top, "query_no").select("query_no", "rank", "chunk_id", "score")


def _together_stored(chunks: DataFrame, asked: Sequence[tuple[int, Sequence[float], list[str]]], o: SearchOptions, stored: Stored) -> DataFrame:
    """As ``_together`` for any number of queries: one read of all their terms' postings, and vectors in blocks
    of queries. The plan does not grow with them."""
    spark = chunks.sparkSession
    n = fetch_size(o.top)
    wanted = candidates(chunks, o.filters)
    words = spark.createDataFrame([(no, t) for no, _, own in asked for t in own], "query_no int, term string")
    weights = bm25.scored(stored.postings(sorted({t for _, _, own in asked for t in own})), *stored.length_stats())
    weights = weights if wanted is None else weights.join(wanted, "chunk_id", "left_semi")
    scored = weights.join(F.broadcast(words), "term").groupBy("query_no", "chunk_id").agg(F.round(F.sum("weight"), 6).alias("bm25"))
    by_text = _ranked(scored, "bm25", n, "query_no").drop("rank")
    vectors = spark.createDataFrame([(no, [float(x) for x in v]) for no, v, _ in asked], "query_id int, embedding array<double>")
    by_vector = vector_search.nearest(vectors, filtered(chunks, o.filters), n).select(F.col("query_id").cast("int").alias("query_no"), "chunk_id", "cosine")
    met = by_text.join(by_vector, ["query_no", "chunk_id"], "full_outer")
    texts = chunks.select("chunk_id", "content")
    met = looked_up(met, texts) if 2 * n * len(asked) <= LISTED else met.join(texts, "chunk_id")
    met = met.withColumn("substance", substance(F.col("content"))).drop("content")
    met = met.withColumn("__best", F.max("bm25").over(Window.partitionBy("query_no")))
    return _ranked(met.withColumn("score", fused(o.weights)), "score", o.top, "query_no").select("query_no", "rank", "chunk_id", "score")


def batch(chunks: DataFrame, queries: Sequence[tuple[str, Sequence[float]]], o: SearchOptions, dedup: bool = True, stored: Stored | None = None) -> DataFrame:
    """(query_no, rank, chunk_id, score) of hybrid searches, in the order of the queries; a scan for
    every ``TOGETHER`` of them, or one read of stored postings for all."""
    if not queries:
        raise ValueError("no queries")
    terms = bm25.terms_of(chunks.sparkSession, [text for text, _ in queries])
    asked = [(no, vector, own) for no, ((_, vector), own) in enumerate(zip(queries, terms, strict=True))]
    if stored is not None:
        out = _together_stored(chunks, asked, o, stored)
    else:
        out = reduce(DataFrame.unionByName, (_together(chunks, asked[i:i + TOGETHER], o) for i in range(0, len(asked), TOGETHER)))
    return deduplicated(out) if dedup else out
