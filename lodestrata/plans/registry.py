"""Where queries register, and the tables in the roles of the engine's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents as chunks; vectors by equal number. What the tables lack follows from the id.
CORPUS_SQL = """corpus AS (
  SELECT d.doc_id AS chunk_id, '/corpus' AS project_root, d.source || '/doc_' || d.doc_id || '.txt' AS relative_path, d.lang AS language, d.text AS content,
         sha256(d.text) AS file_hash, sha256(d.text) AS source_hash, CAST(strlen(d.text) AS BIGINT) AS file_size, 0 AS chunk_index,
         CAST((d.doc_id % 40) * 10 + 1 AS INT) AS start_line, CAST((d.doc_id % 40) * 10 + 1 + d.doc_id % 7 AS INT) AS end_line,
         CASE d.doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'block' ELSE 'generic' END AS chunk_type,
         'sym_' || d.doc_id % 50 AS symbol_name, CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""


#: Vectors from which on they are hashed in a join, so that texts are not sorted for it; fewer may go by broadcast.
HASHED = 10_000


def corpus(spark: SparkSession, sf_dir: str, vectors: bool = True, whole: bool = False) -> DataFrame:
    """``whole``: all texts are wanted, and their join with the vectors should hold none back."""
    n = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("function", "class", "block", "generic"))), (n % 4 + 1).cast("int"))
    digest = F.sha2("text", 256)
    rows = table(spark, sf_dir, "documents").select(
        n.alias("chunk_id"), F.lit("/corpus").alias("project_root"), F.concat("source", F.lit("/doc_"), n.cast("string"), F.lit(".txt")).alias("relative_path"),
        F.col("lang").alias("language"), F.col("text").alias("content"), digest.alias("file_hash"), digest.alias("source_hash"),
        F.octet_length("text").cast("long").alias("file_size"), F.lit(0).alias("chunk_index"), ((n % 40) * 10 + 1).cast("int").alias("start_line"),
        ((n % 40) * 10 + 1 + n % 7).cast("int").alias("end_line"), kind.alias("chunk_type"), F.concat(F.lit("sym_"), (n % 50).cast("string")).alias("symbol_name"))
    if vectors:
        own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
        rows = rows.join(own.hint("shuffle_hash") if whole and own.count() > HASHED else own, "chunk_id", "left")
    return rows


def vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def cos_sql(v: str, vec_id: int) -> str:
    return f"round(list_cosine_similarity({v}, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {vec_id})), 6)"
