"""Statistics, histograms, evaluation and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, memory, stats
from .registry import CORPUS_SQL, corpus, query, table, vector


@query(f"WITH {CORPUS_SQL} SELECT count(*) AS chunks, count(DISTINCT relative_path) AS files, count(DISTINCT project_root) AS projects, count(*) AS embeddings FROM corpus WHERE project_root = '/corpus'")
def index_stats(spark, sf_dir):
    return stats.index_stats(corpus(spark, sf_dir, False), "/corpus")


def _histogram(name, column):
    def run(spark, sf_dir):
        return stats.histogram(corpus(spark, sf_dir, False), column)
    run.__name__ = name
    query(f"WITH {CORPUS_SQL} SELECT {column}, count(*) AS n FROM corpus WHERE coalesce({column}, '') <> '' GROUP BY {column}")(run)


_histogram("language_histogram", "language")
_histogram("chunk_type_histogram", "chunk_type")


@query("""SELECT '/corpus' AS project_root, source AS relative_path, arg_min(lang, doc_id) AS language, sha256(arg_min(text, doc_id)) AS file_hash, CAST(strlen(arg_min(text, doc_id)) AS BIGINT) AS file_size, count(*) AS chunks FROM documents GROUP BY source""")
def file_list(spark, sf_dir):
    rows = corpus(spark, sf_dir, False)
    return stats.file_list(rows.withColumn("relative_path", F.split("relative_path", "/")[0]).withColumn("chunk_index", F.col("chunk_id")))


@query("""WITH c AS (SELECT source AS relative_path, CASE WHEN source = 'src3' THEN CAST(doc_id % 2 AS VARCHAR) WHEN source = 'src4' THEN '' ELSE sha256(source) END AS h FROM documents)
SELECT relative_path, CASE WHEN min(h) = max(h) AND min(h) <> '' THEN min(h) END AS source_hash, min(h) = max(h) AND min(h) <> '' AS complete FROM c GROUP BY relative_path""")
def source_hash_completeness(spark, sf_dir):
    h = F.when(F.col("source") == "src3", (F.col("doc_id") % 2).cast("string")).when(F.col("source") == "src4", "").otherwise(F.sha2("source", 256))
    return stats.source_hashes(table(spark, sf_dir, "documents").select(F.col("source").alias("relative_path"), h.alias("source_hash")))


@query("WITH e AS (SELECT CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS e FROM documents) SELECT count(*) FILTER (WHERE e >= 512) AS over, max(e) AS most, count(*) AS inputs FROM e")
def context_pressure(spark, sf_dir):
    return stats.context_pressure(table(spark, sf_dir, "documents"), 512)


@query(f"""WITH {CORPUS_SQL}, old AS (SELECT relative_path, CASE WHEN chunk_id % 7 = 0 THEN 'x' ELSE file_hash END AS h FROM corpus WHERE chunk_id % 10 <> 0
UNION ALL SELECT 'gone/' || relative_path, file_hash FROM corpus WHERE chunk_id % 13 = 0),
m AS (SELECT c.file_hash AS now, o.h AS was, c.file_size FROM corpus c FULL JOIN old o ON c.relative_path = o.relative_path)
SELECT *, scanned_files >= 2000 OR scanned_bytes >= 209715200 OR estimated_chunks >= 10000 AS confirm, scanned_files >= 5000 OR scanned_bytes >= 524288000 AS large FROM (
SELECT count(now) AS scanned_files, CAST(sum(file_size) AS BIGINT) AS scanned_bytes, count(*) FILTER (WHERE was IS NULL) AS new_files, count(*) FILTER (WHERE was <> now) AS modified_files,
count(*) FILTER (WHERE now IS NULL) AS deleted_files, CAST(sum(CASE WHEN was IS NULL OR was <> now THEN greatest(ceil(file_size / 2048.0), 1) END) AS BIGINT) AS estimated_chunks FROM m)""")
def dry_run_totals(spark, sf_dir):
    from .changes import indexed_before

    rows = corpus(spark, sf_dir, False)
    return stats.dry_run(rows.select("relative_path", "file_hash", "file_size"), indexed_before(rows, "file_hash"))


# ---- retrieval quality

_RANKED = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
r AS (SELECT q.vec_id AS query_id, q.label = d.label AS relevant, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, d.e), 9) DESC, d.vec_id) AS rank
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
m AS (SELECT query_id, max(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS top1, count(*) FILTER (WHERE rank <= 5) / count(*) AS recall_5,
      count(*) FILTER (WHERE rank <= 10) / count(*) AS recall_10, CASE WHEN min(rank) <= 10 THEN 1.0::DOUBLE / min(rank) ELSE 0.0 END AS reciprocal_rank FROM r WHERE relevant GROUP BY query_id)"""


def _evaluated(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    asked = rows.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding", "label")
    best = evaluate.ranked_others(asked.drop("label"), rows.drop("label"))
    return evaluate.per_query_of_groups(best, asked.drop("embedding"), rows.drop("embedding"), "label")


@query(f"WITH {_RANKED} SELECT query_id, top1, round(recall_5, 9) AS recall_5, round(recall_10, 9) AS recall_10, round(reciprocal_rank, 9) AS reciprocal_rank FROM m")
def ir_per_query(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("query_id", "top1", *[F.round(c, 9).alias(c) for c in ("recall_5", "recall_10", "reciprocal_rank")])


@query(f"WITH {_RANKED} SELECT count(*) AS queries, round(avg(top1), 6) AS top1, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(reciprocal_rank), 6) AS mrr FROM m")
def ir_metrics(spark, sf_dir):
    return evaluate.summary(_evaluated(spark, sf_dir))


# ---- notes

NOW = "2024-02-01 00:00:00"

_MEMORIES = """mem AS (SELECT conv_id * 100 + turn AS id, text AS content, CAST((conv_id * 100 + turn) % 10 AS DOUBLE) / 10 AS importance, [role, 'c' || conv_id % 5] AS tags,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((conv_id * 7 + turn) % 900 AS INT)) AS created_at,
  CASE WHEN (conv_id + turn) % 4 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((conv_id * 7 + turn) % 900 + 200 AS INT)) END AS expires_at,
  CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM conversations JOIN embeddings e ON (conv_id * 100 + turn) % 500 = e.vec_id)"""
_ALIVE = f"(expires_at IS NULL OR expires_at >= TIMESTAMP '{NOW}')"


def memories(spark, sf_dir):
    n = F.col("conv_id") * 100 + F.col("turn")
    hours = (F.col("conv_id") * 7 + F.col("turn")) % 900
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = lambda h: F.timestamp_seconds(F.unix_timestamp(start) + h * 3600)
    rows = table(spark, sf_dir, "conversations").select(
        n.alias("id"), F.col("text").alias("content"), ((n % 10).cast("double") / 10).alias("importance"),
        F.array(F.col("role"), F.concat(F.lit("c"), (F.col("conv_id") % 5).cast("string"))).alias("tags"), at(hours).alias("created_at"),
        F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, at(hours + 200)).alias("expires_at"), (n % 500).alias("vec_id"))
    return rows.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id").drop("vec_id")


def _now():
    return F.lit(NOW).cast("timestamp")


def _recall_sql(where: str) -> str:
    sim = "list_cosine_similarity(embedding, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 1))"
    return f"""WITH {_MEMORIES} SELECT id, round({sim}, 6) AS similarity, round({sim} * pow(0.5, (epoch(TIMESTAMP '{NOW}') - epoch(created_at)) / 3600.0 / 720.0) * (1 + 0.25 * importance), 6) AS score
FROM mem WHERE {_ALIVE} AND {where} ORDER BY score DESC, id LIMIT 10"""


@query(_recall_sql("importance >= 0.2"))
def memory_recall_decay(spark, sf_dir):
    return memory.recall(memories(spark, sf_dir), vector(spark, sf_dir, 1), _now(), min_importance=0.2).select("id", "similarity", "score")


@query(_recall_sql("list_has_all(tags, ['user', 'c1'])"))
def memory_tags_and(spark, sf_dir):
    return memory.recall(memories(spark, sf_dir), vector(spark, sf_dir, 1), _now(), tags=["user", "c1"]).select("id", "similarity", "score")


@query(f"WITH {_MEMORIES} SELECT id FROM mem WHERE NOT (len([t for t in tags if contains(t, 'sist')]) > 0 OR len([t for t in tags if contains(t, '3')]) > 0 OR created_at < TIMESTAMP '2024-01-05 00:00:00')")
def memory_forget_substring(spark, sf_dir):
    left = memory.forget(memories(spark, sf_dir), confirm="yes", tags=["sist", "3"], older_than=F.lit("2024-01-05 00:00:00").cast("timestamp"))
    return left.select("id")


@query(f"""WITH {_MEMORIES} SELECT count(*) AS memories, count(*) FILTER (WHERE NOT {_ALIVE}) AS expired, count(*) FILTER (WHERE {_ALIVE}) AS live,
CAST(epoch(min(created_at)) AS BIGINT) AS oldest, CAST(epoch(max(created_at)) AS BIGINT) AS newest, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM mem)) AS distinct_tags FROM mem""")
def memory_stats(spark, sf_dir):
    out = memory.statistics(memories(spark, sf_dir), _now())
    return out.withColumn("oldest", F.unix_timestamp("oldest")).withColumn("newest", F.unix_timestamp("newest"))


@query(f"WITH {_MEMORIES} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM mem) GROUP BY tag")
def memory_tag_counts(spark, sf_dir):
    return memory.tag_counts(memories(spark, sf_dir))


@query(f"WITH {_MEMORIES} SELECT id FROM mem WHERE {_ALIVE}")
def memory_forget_expired(spark, sf_dir):
    return memory.forget_expired(memories(spark, sf_dir), _now()).select("id")
