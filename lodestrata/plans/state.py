"""States that follow from facts, and event streams in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import freshness
from ..streaming import watch
from .registry import query, table

@query("""WITH f AS (SELECT doc_id, n_chars % 7 <> 0 AS indexed, doc_id % 3 <> 0 AS fresh, n_chars % 5 <> 0 AS profile_matches, CASE n_chars % 4 WHEN 0 THEN 'fresh' WHEN 1 THEN 'stale' WHEN 2 THEN 'unknown' END AS freshness_state FROM documents),
st AS (SELECT *, CASE WHEN NOT indexed THEN 'empty' WHEN NOT profile_matches THEN 'profile_mismatch' WHEN freshness_state = 'unknown' THEN 'unknown' WHEN NOT fresh OR freshness_state = 'stale' THEN 'stale' ELSE 'ready' END AS state FROM f)
SELECT *, CASE state WHEN 'empty' THEN 'index' WHEN 'stale' THEN 'index' WHEN 'ready' THEN '' ELSE 'index_force' END AS action, state IN ('empty', 'profile_mismatch') AS blocks_search FROM st""")
def readiness_matrix(spark, sf_dir):
    n, size = F.col("doc_id"), F.col("n_chars")
    freshness_state = F.when(size % 4 == 0, "fresh").when(size % 4 == 1, "stale").when(size % 4 == 2, "unknown")
    facts = table(spark, sf_dir, "documents").select("doc_id", (size % 7 != 0).alias("indexed"), (n % 3 != 0).alias("fresh"), (size % 5 != 0).alias("profile_matches"), freshness_state.alias("freshness_state"))
    return freshness.readiness(facts)


@query("SELECT doc_id, lang || ':' || doc_id % 3 || ':cosine' AS stored, lang || ':' || doc_id % 2 || ':cosine' AS active, doc_id % 3 = doc_id % 2 AS matches FROM documents")
def profile_match(spark, sf_dir):
    n = F.col("doc_id")
    name = lambda k: F.concat_ws(":", "lang", (n % k).cast("string"), F.lit("cosine"))
    rows = table(spark, sf_dir, "documents").select("doc_id", name(3).alias("stored"), name(2).alias("active"))
    return rows.withColumn("matches", F.col("stored") == F.col("active"))


def events(spark, sf_dir):
    """Events as the watcher sees them."""
    return table(spark, sf_dir, "events").select(watch.event_time(F.col("ts")).alias("ts"), F.col("event_type").alias("key"), F.col("user_id"), F.col("event_id"), "value")


_OPS = "CASE event_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'write' WHEN 2 THEN 'remove' ELSE 'rename' END"


@query(f"""WITH e AS (SELECT 'f' || user_id || '.go' AS path, {_OPS} AS op, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, op DESC) AS n FROM e)
SELECT path, op, CAST(epoch_us(ts) AS BIGINT) AS at FROM r WHERE n = 1""")
def watch_latest_per_path(spark, sf_dir):
    op = F.element_at(F.array(*map(F.lit, ("create", "write", "remove", "rename"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = events(spark, sf_dir).select(F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".go")).alias("path"), op.alias("op"), "ts")
    return watch.latest(rows).select("path", "op", F.unix_micros("ts").alias("at"))


def _epochs(df):
    return df.withColumn("window_start", F.unix_micros("window_start")).withColumn("window_end", F.unix_micros("window_end"))


@query("""SELECT epoch_us(w) AS window_start, epoch_us(w) + 3600000000 AS window_end, key, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT date_trunc('hour', ts) AS w, event_type AS key, value FROM events) GROUP BY w, key""")
def events_tumbling(spark, sf_dir):
    return _epochs(watch.tumbling(events(spark, sf_dir)))


@query("""WITH b AS (SELECT epoch_us(ts) // 1800000000 * 1800000000 AS w, event_type AS key, value FROM events), x AS (SELECT unnest([w, w - 1800000000]) AS w, key, value FROM b)
SELECT w AS window_start, w + 3600000000 AS window_end, key, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY w, key""")
def events_sliding(spark, sf_dir):
    return _epochs(watch.sliding(events(spark, sf_dir)))


@query("""WITH g AS (SELECT user_id AS key, epoch_us(ts) AS t, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS s FROM events),
i AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT min(t) AS window_start, max(t) + 1800000000 AS window_end, key, count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY key, island""")
def events_session(spark, sf_dir):
    return _epochs(watch.sessions(events(spark, sf_dir).drop("key").withColumnRenamed("user_id", "key")))
