"""Searches: by vector, by keyword, both, similar chunks, batches, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import substance
from ..functions.vector import cosine_constant, squared_norm
from ..operators import bm25, graph, search, vector_search
from ..operators.filters import filtered
from ..options import FilterOptions, SearchOptions
from .registry import CORPUS_SQL, corpus, cos_sql, query, table, vector

TEXT = "the thing that ered"
TERMS = ("ered", "that", "the", "thing")
OTHER = "of and ther"

_VECTORS = "v AS (SELECT * FROM corpus WHERE embedding IS NOT NULL)"


def _semantic_sql(where: str = "true", limit: int = 10, vec: int = 0, score: str = "score") -> str:
    return f"WITH {CORPUS_SQL}, {_VECTORS} SELECT chunk_id, {cos_sql('embedding', vec)} AS {score} FROM v WHERE {where} ORDER BY {score} DESC, chunk_id LIMIT {limit}"


def bm25_sql(terms: tuple[str, ...], where: str = "true", limit: int = 10, name: str = "text_hits", prefix: str = "") -> str:
    """CTEs that end in ``name``: (chunk_id, content, bm25)."""
    p = prefix
    tf = ", ".join(f"len([x for x in t if x = '{w}']) AS f{i}" for i, w in enumerate(terms))
    df = ", ".join(f"CAST(count(*) FILTER (WHERE f{i} > 0) AS DOUBLE) AS d{i}" for i in range(len(terms)))
    weight = " + ".join(f"ln(1 + (docs_n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""{p}tok AS (SELECT *, regexp_extract_all(lower(concat_ws(' ', content, symbol_name, relative_path, language, chunk_type)), '[\\p{{L}}\\p{{N}}_]+') AS t FROM corpus),
{p}cnt AS (SELECT * EXCLUDE (t), CAST(len(t) AS DOUBLE) AS n, {tf} FROM {p}tok),
{p}st AS (SELECT CAST(count(*) AS DOUBLE) AS docs_n, avg(n) AS mean, {df} FROM {p}cnt),
{name} AS (SELECT chunk_id, content, round({weight}, 6) AS bm25 FROM {p}cnt, {p}st WHERE ({some}) AND ({where}) ORDER BY bm25 DESC, chunk_id LIMIT {limit})"""


_SUBSTANCE = r"CASE WHEN strlen(regexp_replace(content, '^\s+|\s+$', '', 'g')) >= 200 THEN 1.0 ELSE 0.3 + 0.7 * strlen(regexp_replace(content, '^\s+|\s+$', '', 'g')) / 200.0 END"


def hybrid_sql(vw: float, tw: float, *, terms: tuple[str, ...] = TERMS, vec: int = 0, where: str = "true", limit: int = 10, fetch: int = 30, name: str = "fused", prefix: str = "") -> str:
    p = prefix
    return f"""{bm25_sql(terms, where, fetch, f'{p}text_hits', p)},
{p}vec_hits AS (SELECT chunk_id, {cos_sql('embedding', vec)} AS cosine FROM corpus WHERE embedding IS NOT NULL AND ({where}) ORDER BY cosine DESC, chunk_id LIMIT {fetch}),
{name} AS (
  SELECT chunk_id, round({vw}::DOUBLE * CASE WHEN cosine IS NULL OR cosine < 0 THEN 0.0 WHEN cosine > 1 THEN 1.0 ELSE cosine END + {tw}::DOUBLE * coalesce(CASE WHEN best > 0 THEN bm25 / best * CAST({_SUBSTANCE} AS DOUBLE) END, 0.0), 6) AS score, cosine, bm25
  FROM {p}vec_hits FULL JOIN {p}text_hits USING (chunk_id), (SELECT max(bm25) AS best FROM {p}text_hits)
  ORDER BY score DESC, chunk_id LIMIT {limit})"""


# ---- by vector


@query(_semantic_sql())
def semantic_topk(spark, sf_dir):
    return search.semantic(corpus(spark, sf_dir), vector(spark, sf_dir, 0), SearchOptions("semantic")).select("chunk_id", "score")


@query(_semantic_sql("language = 'de'"))
def semantic_topk_filtered_lang(spark, sf_dir):
    o = SearchOptions("semantic", filters=FilterOptions(language="DE"))
    return search.semantic(corpus(spark, sf_dir), vector(spark, sf_dir, 0), o).select("chunk_id", "score")


@query(f"SELECT * FROM ({_semantic_sql(limit=50)}) WHERE score >= 0.3")
def semantic_min_score(spark, sf_dir):
    hits = search.semantic(corpus(spark, sf_dir), vector(spark, sf_dir, 0), SearchOptions("semantic", limit=50)).select("chunk_id", "score")
    return search.with_min_score(hits, 0.3)


@query(_semantic_sql("chunk_id <> 7", vec=7))
def similar_by_id(spark, sf_dir):
    return search.similar_by_id(corpus(spark, sf_dir), 7, 10)


@query(_semantic_sql("relative_path NOT LIKE 'src7/%' AND chunk_id <> 7", vec=7))
def similar_exclude_same_source(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    drop = (F.col("chunk_id") == 7) | F.col("relative_path").startswith("src7/")
    return search.similar_by_vector(rows, vector(spark, sf_dir, 7), 10, drop=drop)


@query(_semantic_sql("split_part(relative_path, '/', 1) <> (SELECT source FROM documents WHERE doc_id = 7)", vec=7))
def similar_exclude_same_file(spark, sf_dir):
    """A source is a file here, so that files have many chunks."""
    rows = corpus(spark, sf_dir).withColumn("relative_path", F.split_part("relative_path", F.lit("/"), F.lit(1)))
    return search.similar_by_id(rows, 7, 10, exclude_same_file=True)


@query(_semantic_sql("chunk_id <> (SELECT min(chunk_id) FROM corpus WHERE relative_path = 'src5/doc_5.txt')", vec=5, limit=5))
def similar_by_location(spark, sf_dir):
    return search.similar_by_location(corpus(spark, sf_dir), "src5/doc_5.txt", 52, 5)


@query("""WITH p AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS cosine
FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM p)
SELECT query_id, chunk_id, cosine, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def knn_join_all_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_search.nearest(asked, rows, 5, id_col="vec_id")


@query("""SELECT vec_id, round(list_dot_product(e, e), 6) AS norm2, CASE WHEN list_dot_product(e, e) > 0 THEN round(list_cosine_similarity(e, [1.0 for i in range(64)]), 6) END AS cosine
FROM (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN [0.0::DOUBLE for x in embedding] ELSE CAST(embedding AS DOUBLE[]) END AS e FROM embeddings)""")
def cosine_zero_guard(spark, sf_dir):
    e = F.when(F.col("vec_id") % 50 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    norm = squared_norm(F.col("e"))
    return rows.select("vec_id", F.round(norm, 6).alias("norm2"), F.when(norm > 0, F.round(cosine_constant("e", [1.0] * 64), 6)).alias("cosine"))


# ---- by keyword


@query(f"WITH {CORPUS_SQL}, {bm25_sql(TERMS)} SELECT chunk_id, bm25 FROM text_hits")
def bm25_topk(spark, sf_dir):
    return bm25.top(corpus(spark, sf_dir, False), TEXT, 10).select("chunk_id", "bm25")


@query(f"WITH {CORPUS_SQL}, {bm25_sql(TERMS)} SELECT chunk_id, round(bm25 / max(bm25) OVER (), 6) AS score, bm25 AS distance FROM text_hits")
def bm25_normalized(spark, sf_dir):
    return search.keyword(corpus(spark, sf_dir, False), TEXT, SearchOptions("keyword"))


@query(f"""WITH {CORPUS_SQL}, {bm25_sql(TERMS, "chunk_type = 'class' AND start_line BETWEEN 1 AND 200")} SELECT chunk_id, bm25 FROM text_hits""")
def bm25_filtered(spark, sf_dir):
    o = FilterOptions(chunk_type="class", min_line=1, max_line=200)
    return bm25.top(corpus(spark, sf_dir, False), TEXT, 10, o).select("chunk_id", "bm25")


_TOKENS = r"regexp_extract_all(lower(concat_ws(' ', content, symbol_name, relative_path, language, chunk_type)), '[\p{L}\p{N}_]+')"


@query(f"WITH {CORPUS_SQL}, x AS (SELECT chunk_id, unnest({_TOKENS}) AS term FROM corpus) SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM x GROUP BY term")
def postings_df(spark, sf_dir):
    return bm25.term_frequencies(corpus(spark, sf_dir, False))


@query(f"WITH {CORPUS_SQL}, x AS (SELECT len({_TOKENS}) AS n FROM corpus) SELECT count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_tokens, avg(n) AS mean_length, CAST(max(n) AS INT) AS max_length FROM x")
def doc_length_stats(spark, sf_dir):
    return bm25.length_stats(corpus(spark, sf_dir, False))


# ---- both


@query(f"WITH {CORPUS_SQL}, {hybrid_sql(0.7, 0.3)} SELECT * FROM fused")
def hybrid_topk(spark, sf_dir):
    return search.hybrid(corpus(spark, sf_dir), vector(spark, sf_dir, 0), TEXT, SearchOptions(text_weight=0.3))


@query(f"""WITH {CORPUS_SQL}, {hybrid_sql(0.7 / 1.6, 0.9 / 1.6, where="language = 'en'", limit=12, fetch=36)} SELECT * FROM fused""")
def hybrid_weights_normalized(spark, sf_dir):
    o = SearchOptions(limit=12, vector_weight=0.7, text_weight=0.9, filters=FilterOptions(language="en"))
    return search.hybrid(corpus(spark, sf_dir), vector(spark, sf_dir, 0), TEXT, o)


@query(f"WITH {CORPUS_SQL}, {hybrid_sql(0.0, 1.0)} SELECT * FROM fused")
def hybrid_keyword_only(spark, sf_dir):
    return search.hybrid(corpus(spark, sf_dir), vector(spark, sf_dir, 0), TEXT, SearchOptions(vector_weight=0.0))


@query(f"WITH {CORPUS_SQL} SELECT chunk_id, round(CAST({_SUBSTANCE} AS DOUBLE), 6) AS substance FROM corpus")
def substance_factor(spark, sf_dir):
    return corpus(spark, sf_dir, False).select("chunk_id", F.round(substance(F.col("content")), 6).alias("substance"))


def _batch_sql(tail: str) -> str:
    parts = [hybrid_sql(0.7, 0.3, terms=t, vec=v, limit=3, name=f"r{i}", prefix=f"q{i}_") for i, (t, v) in enumerate(_BATCH_TERMS)]
    rows = " UNION ALL ".join(f"SELECT {i} AS query_no, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INT) AS rank, chunk_id, score FROM r{i}" for i in range(len(parts)))
    return f"WITH {CORPUS_SQL}, {', '.join(parts)}, every AS ({rows}) {tail}"


_BATCH_TERMS = [(TERMS, 0), (("and", "of", "ther"), 3), (TERMS, 0)]


def _batch(spark, sf_dir, dedup):
    asked = [(TEXT, vector(spark, sf_dir, 0)), (OTHER, vector(spark, sf_dir, 3)), (TEXT, vector(spark, sf_dir, 0))]
    return search.batch(corpus(spark, sf_dir), asked, SearchOptions(limit=3, text_weight=0.3), dedup)


@query(_batch_sql("SELECT query_no, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY query_no, rank) AS n FROM every) WHERE n = 1"))
def batch_search_dedup(spark, sf_dir):
    return _batch(spark, sf_dir, True)


@query(_batch_sql("SELECT * FROM every"))
def batch_search_no_dedup(spark, sf_dir):
    return _batch(spark, sf_dir, False)


# ---- filters and scopes


def _filter(name, o, where):
    def run(spark, sf_dir):
        return filtered(corpus(spark, sf_dir, False), o).select("chunk_id", "relative_path", "start_line")
    run.__name__ = name
    query(f"WITH {CORPUS_SQL} SELECT chunk_id, relative_path, start_line FROM corpus WHERE {where}")(run)


_filter("filter_language_in", FilterOptions(languages=("FR", "es")), "language IN ('fr', 'es')")
_filter("filter_glob", FilterOptions(file_glob="src1?/**/*_?5.txt"), r"regexp_matches(relative_path, '^src1[^/]/(.*/)?[^/]*_[^/]5\.txt$')")
_filter("filter_directory", FilterOptions(directory="src1"), "starts_with(relative_path, 'src1/')")
_filter("filter_allow_list", FilterOptions(files=("src3/doc_3.txt", "src5/doc_5.txt", "nothing.txt")), "relative_path IN ('src3/doc_3.txt', 'src5/doc_5.txt', 'nothing.txt')")
_filter("filter_line_range", FilterOptions(min_line=50, max_line=120, chunk_types=("Block", "class")), "start_line BETWEEN 50 AND 120 AND chunk_type IN ('block', 'class')")
_filter("filter_project", FilterOptions(project_root="/corpus", min_line=300), "project_root = '/corpus' AND start_line >= 300")


@query(f"""WITH {CORPUS_SQL}, l AS (SELECT relative_path, unnest([start_line, start_line + 3, start_line + 20]) AS line FROM corpus),
m AS (SELECT l.relative_path, l.line, c.chunk_id, c.end_line - c.start_line AS span FROM l JOIN corpus c ON l.relative_path = c.relative_path AND l.line BETWEEN c.start_line AND c.end_line)
SELECT relative_path, line, chunk_id, span FROM (SELECT *, row_number() OVER (PARTITION BY relative_path, line ORDER BY span, chunk_id) AS n FROM m) WHERE n = 1""")
def location_lookup(spark, sf_dir):
    rows = corpus(spark, sf_dir, False)
    line = F.explode(F.array(F.col("start_line"), F.col("start_line") + 3, F.col("start_line") + 20)).alias("line")
    return search.chunk_at(rows, rows.select("relative_path", line))


@query(f"WITH {CORPUS_SQL} SELECT chunk_id, relative_path FROM corpus WHERE relative_path IN (SELECT source || '/doc_' || doc_id || '.txt' FROM documents WHERE doc_id % 9 = 4)")
def blast_radius_scope(spark, sf_dir):
    path = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    nodes = table(spark, sf_dir, "documents").where("doc_id % 9 = 4").select(path.alias("file"), F.col("doc_id").alias("ord"), F.lit("caller").alias("role"))
    files = graph.impact_files(nodes).select(F.col("file").alias("relative_path"))
    return graph.in_scope(corpus(spark, sf_dir, False), files).select("chunk_id", "relative_path")


@query(f"""WITH {CORPUS_SQL}, {_VECTORS}, hits AS (SELECT chunk_id, symbol_name, {cos_sql('embedding', 0)} AS score FROM v ORDER BY score DESC, chunk_id LIMIT 30),
hot AS (SELECT 'sym_' || l_suppkey % 60 AS symbol, count(*) AS in_degree, l_suppkey % 3 AS shared_name FROM lineitem GROUP BY l_suppkey),
hubs AS (SELECT symbol, max(CASE WHEN shared_name > 1 THEN in_degree / shared_name ELSE CAST(in_degree AS DOUBLE) END) AS hub FROM hot GROUP BY symbol),
most AS (SELECT greatest(max(hub), 1.0) AS m FROM hubs)
SELECT chunk_id, symbol_name, score, round(coalesce(hub, 0.0) / m, 6) AS structural_score, round(score * (1 - 0.15) + coalesce(hub, 0.0) / m * 0.15, 6) AS final_score
FROM hits LEFT JOIN hubs ON symbol = symbol_name, most""")
def rerank_hub(spark, sf_dir):
    hits = vector_search.top(corpus(spark, sf_dir), vector(spark, sf_dir, 0), 30).select("chunk_id", "symbol_name", F.col("cosine").alias("score"))
    hot = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("in_degree"))
    hot = hot.select(F.concat(F.lit("sym_"), (F.col("l_suppkey") % 60).cast("string")).alias("symbol"), "in_degree", (F.col("l_suppkey") % 3).alias("shared_name"))
    return graph.reranked(hits, hot)


@query("""WITH i AS (SELECT 'f' || doc_id || CASE WHEN doc_id % 11 = 0 THEN '_test.go' ELSE '.go' END AS relative_path, 'example.com/m/' || source || '/p' || doc_id % 3 AS imp FROM documents),
t AS (SELECT DISTINCT source || '/p1/x.go' AS target, source || '/p1' AS dir FROM documents)
SELECT DISTINCT target, relative_path FROM i JOIN t ON imp = dir OR ends_with(imp, '/' || dir) WHERE NOT ends_with(relative_path, '_test.go')""")
def reverse_imports_suffix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 11 == 0, "_test.go").otherwise(".go"))
    imported = docs.select(name.alias("relative_path"), F.concat(F.lit("example.com/m/"), "source", F.lit("/p"), (F.col("doc_id") % 3).cast("string")).alias("import"))
    targets = docs.select(F.concat("source", F.lit("/p1/x.go")).alias("relative_path")).distinct()
    return graph.imported_by_suffix(imported, targets)
