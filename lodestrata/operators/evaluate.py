"""Retrieval quality: ranks, Top-1, recall and mean reciprocal rank, averaged over queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vector_search import nearest

DEPTH = 10


def per_query(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, top1, recall_5, recall_10, reciprocal_rank) from ranked (query_id, doc_id, rank) and
    relevant (query_id, doc_id). Every query that has a relevant document counts."""
    wanted = relevant.distinct()
    met = wanted.join(ranked.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    n = F.count(F.lit(1))
    return met.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("top1"), (F.count_if(F.col("rank") <= 5) / n).alias("recall_5"),
        (F.count_if(F.col("rank") <= 10) / n).alias("recall_10"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))


def per_query_of_groups(ranked: DataFrame, queries: DataFrame, documents: DataFrame, group: str) -> DataFrame:
    """As ``per_query``, where relevant to a query (query_id and its group) are all other documents
    (doc_id and theirs) of its group: these are counted, and never paired with the queries."""
    size = documents.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    asked = queries.join(size, group).join(documents.select(F.col("doc_id").alias("query_id"), F.lit(1).alias("own")), "query_id", "left")
    asked = asked.select("query_id", group, (F.col("n") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")
    hits = ranked.join(asked.select("query_id", F.col(group).alias("wanted")), "query_id").join(documents.select("doc_id", group), "doc_id").where(F.col(group) == F.col("wanted"))
    met = asked.join(hits.select("query_id", "rank"), "query_id", "left")
    return met.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("top1"), (F.count_if(F.col("rank") <= 5) / F.first("n")).alias("recall_5"),
        (F.count_if(F.col("rank") <= 10) / F.first("n")).alias("recall_10"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))


def ranked_others(queries: DataFrame, documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """As ``ranked`` for queries that are documents themselves, each without itself."""
    near = ranked(queries, documents, depth + 1).where("query_id <> doc_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def summary(queries: DataFrame) -> DataFrame:
    return queries.agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("top1"), 6).alias("top1"), F.round(F.avg("recall_5"), 6).alias("recall_5"),
        F.round(F.avg("recall_10"), 6).alias("recall_10"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


def ranked(queries: DataFrame, documents: DataFrame, depth: int | None = None) -> DataFrame:
    """(query_id, doc_id, rank, cosine), the best ``depth`` documents (all if none is given) of each
    query (query_id, embedding) among documents (doc_id, embedding), ties by id."""
    k = depth or documents.count()
    return nearest(queries, documents, k, id_col="doc_id", digits=9).withColumnRenamed("chunk_id", "doc_id")


def problems(documents: DataFrame, queries: DataFrame, relevant: DataFrame) -> DataFrame:
    """(problem, id): what makes a dataset unfit: empty texts, ids that repeat, unknown references."""
    blank = lambda df, what: df.where(F.trim(F.coalesce("text", F.lit(""))) == "").select(F.lit(f"empty {what}").alias("problem"), F.col("id").cast("string").alias("id"))
    twice = lambda df, what: df.groupBy("id").count().where("count > 1").select(F.lit(f"repeated {what}").alias("problem"), F.col("id").cast("string").alias("id"))
    stray = relevant.join(documents.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(F.lit("unknown document").alias("problem"), F.col("doc_id").cast("string").alias("id"))
    lost = relevant.join(queries.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(F.lit("unknown query").alias("problem"), F.col("query_id").cast("string").alias("id"))
    parts = [blank(documents, "document"), blank(queries, "query"), twice(documents, "document"), twice(queries, "query"), stray, lost]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
