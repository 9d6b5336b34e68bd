"""Searches of a store that has gone through edits, and what its maintenance needs to know."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import freshness, graph, packing, search
from ..options import FilterOptions, SearchOptions
from ..sources.store import ChunkStore
from .registry import CORPUS_SQL, corpus, query, table, vector
from .searches import OTHER, TERMS, TEXT, bm25_sql, hybrid_sql

#: As in tests only: a session that names no shared folder keeps its stores on the one machine it runs on.
LOCAL_DIR = "file:///tmp/lodestrata-stores"

_STORES: dict[tuple[str, str], ChunkStore] = {}


def edited_store(spark: SparkSession, sf_dir: str) -> ChunkStore:
    """The corpus as a store, brought there by a load of old texts, an upsert and a deletion; built once
    for each session and folder, as an index is."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        store = ChunkStore(spark, f"{(named or LOCAL_DIR).rstrip('/')}/store-{uuid.uuid4().hex}")
        rows = corpus(spark, sf_dir, whole=True).withColumn("doc", F.col("chunk_id")).drop("chunk_id")
        old = rows.where("doc % 50 <> 0").withColumn("content", F.when(F.col("doc") % 31 == 0, F.lit("an old text that the thing")).otherwise(F.col("content")))
        extra = rows.where("doc % 53 = 0").withColumn("relative_path", F.concat(F.lit("gone/"), "relative_path"))
        store.replace_files(old.unionByName(extra).drop("doc"), "/corpus")
        store.upsert(rows.where("doc % 50 = 0 or doc % 31 = 0").drop("doc"))
        store.delete_where(F.col("relative_path").startswith("gone/"))
        _STORES[key] = store
    return _STORES[key]


#: The store numbers chunks by bucket and path, those that came later after the others.
_EDITED = f"""{CORPUS_SQL.replace('corpus AS (', 'loaded AS (', 1)},
corpus AS (SELECT row_number() OVER (ORDER BY chunk_id % 50 = 0, CAST('0x' || substr(md5(project_root || chr(0) || relative_path), 1, 2) AS INT) // 8, relative_path) AS chunk_id, * EXCLUDE (chunk_id) FROM loaded)"""


def _with_paths(hits: DataFrame, store: ChunkStore) -> DataFrame:
    kept = [c for c in hits.columns if c != "chunk_id"]
    return search.looked_up(hits, store.read().select("chunk_id", "relative_path")).select(*kept, "relative_path")


@query(f"WITH {_EDITED}, {bm25_sql(TERMS)} SELECT relative_path, bm25 FROM text_hits JOIN corpus USING (chunk_id)")
def bm25_topk_indexed(spark, sf_dir):
    store = edited_store(spark, sf_dir)
    return search.top_by_text(store.read(), TEXT, 10, FilterOptions(), store).select("relative_path", "bm25")


@query(f"""WITH {_EDITED}, {bm25_sql(TERMS, "language = 'en' AND chunk_type = 'block'")} SELECT relative_path, bm25 FROM text_hits JOIN corpus USING (chunk_id)""")
def bm25_filtered_indexed(spark, sf_dir):
    store = edited_store(spark, sf_dir)
    return search.top_by_text(store.read(), TEXT, 10, FilterOptions(language="en", chunk_type="block"), store).select("relative_path", "bm25")


@query(f"WITH {_EDITED}, {hybrid_sql(0.7, 0.3)} SELECT relative_path, score, cosine, bm25 FROM fused JOIN corpus USING (chunk_id)")
def hybrid_topk_indexed(spark, sf_dir):
    store = edited_store(spark, sf_dir)
    hits = search.hybrid(store.read(), vector(spark, sf_dir, 0), TEXT, SearchOptions(text_weight=0.3), store)
    return _with_paths(hits, store)


_ASKED = [(TERMS, 0), (("and", "of", "ther"), 3)]
_BATCH = [hybrid_sql(0.7, 0.3, terms=t, vec=v, limit=4, name=f"r{i}", prefix=f"q{i}_") for i, (t, v) in enumerate(_ASKED)]


@query(f"""WITH {_EDITED}, {', '.join(_BATCH)}, every AS ({' UNION ALL '.join(f'SELECT {i} AS query_no, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INT) AS rank, chunk_id, score FROM r{i}' for i in range(2))})
SELECT query_no, rank, relative_path, score FROM every JOIN corpus USING (chunk_id)""")
def batch_search_indexed(spark, sf_dir):
    store = edited_store(spark, sf_dir)
    asked = [(TEXT, vector(spark, sf_dir, 0)), (OTHER, vector(spark, sf_dir, 3))]
    return _with_paths(search.batch(store.read(), asked, SearchOptions(limit=4, text_weight=0.3), False, store), store)


@query(f"WITH {_EDITED} SELECT relative_path, file_hash, language, chunk_type, start_line, end_line, sha256(content) AS content_sha256 FROM corpus")
def store_after_edits(spark, sf_dir):
    rows = edited_store(spark, sf_dir).read()
    return rows.select("relative_path", "file_hash", "language", "chunk_type", "start_line", "end_line", F.sha2("content", 256).alias("content_sha256"))


def semantic_cells(spark, sf_dir):
    """Near-neighbour hits out of trained cells: no twin, as the cells are learnt; tests measure the recall."""
    store = edited_store(spark, sf_dir)
    if not store.state["cells"]:
        store.train_cells()
    hits = search.top_by_vector(store.read(), vector(spark, sf_dir, 0), 10, FilterOptions(), store)
    return _with_paths(hits.select("chunk_id", "cosine"), store)


query()(semantic_cells)


@query(f"WITH {CORPUS_SQL} SELECT count(*) AS files, CAST(sum(CAST('0x' || substr(sha256(relative_path || chr(0) || source_hash), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM corpus")
def feed_digest(spark, sf_dir):
    return freshness.feed_digest(corpus(spark, sf_dir, False))


_CUT = packing.BYTES


@query(f"""WITH s AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS size FROM documents),
l AS (SELECT *, CAST(coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM s),
c AS (SELECT *, before // {_CUT} AS cut, CAST((before + greatest(size, 1) - 1) // {_CUT} > before // {_CUT} AS INT) AS crossing FROM l)
SELECT doc_id, size, cut || ':' || crossing || ':' || (row_number() OVER (PARTITION BY cut, crossing ORDER BY doc_id) - 1) // {packing.TEXTS} AS request FROM c""")
def provider_requests(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return packing.packed(rows, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)))


_LONG_WORD = "[A-Za-z]{12,}"


@query(f"""WITH f AS (SELECT source || '/doc_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.ts' END AS relative_path, text AS content, regexp_extract(text, '{_LONG_WORD}') AS word, doc_id FROM documents),
t AS (SELECT DISTINCT 'lib/' || word || '.py' AS target, word FROM f WHERE word <> '')
SELECT DISTINCT target, relative_path FROM t JOIN f ON contains(content, t.word) WHERE ends_with(relative_path, '.py') AND relative_path <> target""")
def reverse_imports_mentions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".py").otherwise(".ts"))
    word = F.regexp_extract("text", _LONG_WORD, 0)
    targets = docs.where(word != "").select(F.concat(F.lit("lib/"), word, F.lit(".py")).alias("relative_path")).distinct()
    return graph.imported_by_mentions(docs.select(path.alias("relative_path"), F.col("text").alias("content")), targets)
