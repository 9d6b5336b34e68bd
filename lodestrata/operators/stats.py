"""Counts and histograms over chunks and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFIRM_FILES, CONFIRM_BYTES, CONFIRM_CHUNKS = 2000, 200 << 20, 10_000
LARGE_FILES, LARGE_BYTES = 5000, 500 << 20


def index_stats(chunks: DataFrame, project_root: str = "") -> DataFrame:
    """One row: chunks, files (by root and path) and projects; of one project if it is named."""
    rows = chunks.where(F.col("project_root") == project_root) if project_root else chunks
    return rows.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("project_root", "relative_path").alias("files"),
        F.count_distinct("project_root").alias("projects"), F.count(F.lit(1)).alias("embeddings"))


def histogram(chunks: DataFrame, column: str) -> DataFrame:
    """Counts by value, empty ones left out; by count, then value."""
    return chunks.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def file_list(chunks: DataFrame) -> DataFrame:
    """One row per file: what its first chunk says, and how many it has."""
    first = F.min_by(F.struct("language", "file_hash", "file_size"), F.struct("chunk_index", "chunk_id"))
    found = chunks.groupBy("project_root", "relative_path").agg(first.alias("f"), F.count(F.lit(1)).alias("chunks"))
    return found.select("project_root", "relative_path", "f.language", "f.file_hash", "f.file_size", "chunks")


def file_hashes(chunks: DataFrame) -> DataFrame:
    """(path, hash), the last chunk's."""
    return chunks.groupBy("relative_path").agg(F.max_by("file_hash", F.struct("chunk_index", "chunk_id")).alias("file_hash"))


def source_hashes(chunks: DataFrame) -> DataFrame:
    """(path, source_hash, complete): the hash if all chunks of a file agree and none is empty."""
    clean = F.coalesce(F.col("source_hash"), F.lit(""))
    seen = chunks.groupBy("relative_path").agg(F.min(clean).alias("lo"), F.max(clean).alias("hi"))
    agree = (F.col("lo") == F.col("hi")) & (F.col("lo") != "")
    return seen.select("relative_path", F.when(agree, F.col("lo")).alias("source_hash"), agree.alias("complete"))


def health(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("total_size"), F.max("indexed_at").alias("last_indexed"))


def dry_run(current: DataFrame, indexed: DataFrame, chunk_bytes: int = 2048) -> DataFrame:
    """One row: what an incremental run would do, with chunks estimated from sizes, and whether it is
    large enough to ask first. ``current``: relative_path, file_hash, file_size."""
    met = current.select("relative_path", F.col("file_hash").alias("new"), "file_size").join(
        indexed.select("relative_path", F.col("file_hash").alias("old")), "relative_path", "full_outer")
    added = F.col("old").isNull()
    changed = F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new"))
    estimate = F.sum(F.when(added | changed, F.greatest(F.ceil(F.col("file_size") / chunk_bytes), F.lit(1)))).cast("long")
    row = met.agg(
        F.count("new").alias("scanned_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("scanned_bytes"),
        F.count_if(added).alias("new_files"), F.count_if(changed).alias("modified_files"), F.count_if(F.col("new").isNull()).alias("deleted_files"),
        F.coalesce(estimate, F.lit(0)).alias("estimated_chunks"))
    ask = (F.col("scanned_files") >= CONFIRM_FILES) | (F.col("scanned_bytes") >= CONFIRM_BYTES) | (F.col("estimated_chunks") >= CONFIRM_CHUNKS)
    return row.withColumn("confirm", ask).withColumn("large", (F.col("scanned_files") >= LARGE_FILES) | (F.col("scanned_bytes") >= LARGE_BYTES))


def context_pressure(texts: DataFrame, context: int, text: str = "text") -> DataFrame:
    """One row: texts whose estimated tokens (a quarter of the bytes) reach the context."""
    estimate = F.ceil(F.octet_length(text) / 4).cast("long")
    return texts.select(estimate.alias("e")).agg(F.count_if(F.col("e") >= context).alias("over"), F.max("e").alias("most"), F.count(F.lit(1)).alias("inputs"))


def origin_counts(chunks: DataFrame) -> DataFrame:
    """(origin, chunks, files): a file counts under every origin that one of its chunks has."""
    return chunks.groupBy("origin").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("relative_path").alias("files")).orderBy("origin")


def honest_percent(done: int, queued: int, walk_complete: bool) -> float:
    """Progress in percent: nothing until the walk has ended, as the total is not known before."""
    return min(max(100.0 * done / queued, 0.0), 100.0) if walk_complete and queued > 0 else 0.0


def throughput(count: int, seconds: float) -> float:
    return count / seconds if seconds > 0 else 0.0
