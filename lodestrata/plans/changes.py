"""What changed between the files and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import freshness, stats
from .registry import CORPUS_SQL, corpus, query

_OLD = """old AS (SELECT relative_path, CASE WHEN chunk_id % 7 = 0 THEN 'x' ELSE file_hash END AS h FROM corpus WHERE chunk_id % 10 <> 0
UNION ALL SELECT 'gone/' || relative_path, file_hash FROM corpus WHERE chunk_id % 13 = 0)"""


def indexed_before(rows: DataFrame, name: str = "source_hash") -> DataFrame:
    """An index that lacks a tenth of the files, has old hashes of a seventh and some files too many."""
    old = F.when(F.col("chunk_id") % 7 == 0, "x").otherwise(F.col("file_hash"))
    kept = rows.where("chunk_id % 10 <> 0").select("relative_path", old.alias(name))
    return kept.unionByName(rows.where("chunk_id % 13 = 0").select(F.concat(F.lit("gone/"), "relative_path").alias("relative_path"), F.col("file_hash").alias(name)))


@query(f"""WITH {CORPUS_SQL}, {_OLD}, m AS (SELECT c.file_hash AS now, o.h AS was FROM corpus c FULL JOIN old o ON c.relative_path = o.relative_path)
SELECT *, new_files + modified_files + deleted_files AS total_pending FROM (SELECT count(*) FILTER (WHERE was IS NULL) AS new_files, count(*) FILTER (WHERE was <> now) AS modified_files, count(*) FILTER (WHERE now IS NULL) AS deleted_files FROM m)""")
def pending_changes(spark, sf_dir):
    rows = corpus(spark, sf_dir, False)
    return freshness.pending(rows, indexed_before(rows))


@query(f"WITH {CORPUS_SQL}, {_OLD} SELECT relative_path FROM old WHERE relative_path NOT IN (SELECT relative_path FROM corpus)")
def prune_deleted(spark, sf_dir):
    rows = corpus(spark, sf_dir, False)
    return freshness.to_prune(indexed_before(rows), rows).select("relative_path")


@query(f"WITH {CORPUS_SQL}, {_OLD} SELECT c.relative_path, c.file_hash FROM corpus c WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.relative_path = c.relative_path AND o.h = c.file_hash)")
def incremental_skip(spark, sf_dir):
    rows = corpus(spark, sf_dir, False)
    return freshness.to_index(rows, indexed_before(rows, "file_hash")).select("relative_path", "file_hash")


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id > 0 AND vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 1)")
def orphan_cleanup(spark, sf_dir):
    from .registry import table

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    valid = table(spark, sf_dir, "documents").where("doc_id % 3 <> 1").select(F.col("doc_id").alias("chunk_id"))
    return freshness.orphans(rows, valid)


@query(f"WITH {CORPUS_SQL} SELECT chunk_id FROM corpus WHERE relative_path = 'src3/doc_3.txt' OR relative_path = 'src1' OR starts_with(relative_path, 'src1/')")
def path_selection(spark, sf_dir):
    rows = corpus(spark, sf_dir, False)
    return rows.where(freshness.under(F.col("relative_path"), ["src3/doc_3.txt", "src1/"])).select("chunk_id")


@query(f"""WITH {CORPUS_SQL}, s AS (SELECT relative_path, CASE WHEN chunk_id % 4 = 0 THEN 'other' ELSE source_hash END AS source_hash, chunk_id % 3 AS n_chunks, 'i' || chunk_id AS index_hash FROM corpus WHERE chunk_id % 2 = 0)
SELECT c.relative_path, coalesce(s.index_hash, c.file_hash) AS file_hash FROM corpus c LEFT JOIN s ON s.relative_path = c.relative_path AND s.source_hash = c.source_hash AND s.n_chunks > 0""")
def structural_file_hash(spark, sf_dir):
    rows = corpus(spark, sf_dir, False)
    old = F.when(F.col("chunk_id") % 4 == 0, "other").otherwise(F.col("source_hash"))
    made = rows.where("chunk_id % 2 = 0").select("relative_path", old.alias("source_hash"), (F.col("chunk_id") % 3).alias("n_chunks"), F.concat(F.lit("i"), F.col("chunk_id").cast("string")).alias("index_hash"))
    return freshness.structural_hashes(rows.select("relative_path", "source_hash", "file_hash"), made).select("relative_path", "file_hash")


@query("""WITH o AS (SELECT source AS relative_path, CASE WHEN doc_id % 3 = 0 THEN 'structural' WHEN doc_id % 3 = 1 THEN 'gap' ELSE 'local' END AS origin FROM documents)
SELECT origin, count(*) AS chunks, count(DISTINCT relative_path) AS files FROM o GROUP BY origin""")
def origin_counts(spark, sf_dir):
    from .registry import table

    origin = F.when(F.col("doc_id") % 3 == 0, "structural").when(F.col("doc_id") % 3 == 1, "gap").otherwise("local")
    return stats.origin_counts(table(spark, sf_dir, "documents").select(F.col("source").alias("relative_path"), origin.alias("origin")))
