"""Scalar functions and chunking over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import chunking, structural
from ..sources.scan import language
from .registry import CORPUS_SQL, corpus, query, table

_NORMAL = r"array_to_string([x for x in [regexp_replace(l, '^\s+|\s+$', '', 'g') for l in string_split(text, chr(10))] if x <> ''], chr(10))"


@query(f"SELECT doc_id, sha256({_NORMAL}) AS cache_key FROM documents")
def cache_key_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.cache_key(F.col("text")).alias("cache_key"))


@query(f"SELECT sha256({_NORMAL}) AS cache_key, count(*) AS texts, min(doc_id) AS leader FROM documents GROUP BY 1")
def cache_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(fn.cache_key(F.col("text")).alias("cache_key")).agg(F.count(F.lit(1)).alias("texts"), F.min("doc_id").alias("leader"))


@query(f"WITH {CORPUS_SQL} SELECT chunk_id, sha256(project_root || chr(0) || relative_path || chr(0) || '0:' || file_size || ':' || start_line || ':' || chunk_index) AS chunk_key, sha256('file:' || project_root || chr(0) || relative_path) AS file_key FROM corpus")
def chunk_key(spark, sf_dir):
    c = F.col
    key = fn.chunk_key(c("project_root"), c("relative_path"), F.lit(0), c("file_size"), c("start_line"), c("chunk_index"))
    return corpus(spark, sf_dir, False).select("chunk_id", F.sha2(key, 256).alias("chunk_key"), F.sha2(fn.file_key(c("project_root"), c("relative_path")), 256).alias("file_key"))


@query("SELECT doc_id, sha256(text) AS file_hash, substr(sha1(source), 1, 12) AS project_key FROM documents")
def file_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.file_hash(F.col("text")).alias("file_hash"), fn.project_key(F.col("source")).alias("project_key"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT) AS n_lines, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents")
def line_count(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", fn.line_count(t).alias("n_lines"), fn.lines_between(t, F.lit(2), F.lit(4)).alias("lines"))


_BRANCH = "regexp_replace(replace(translate(b, '/\\: ~', '-----'), '..', '--'), '^-+|-+$', '', 'g')"


@query(f"SELECT doc_id, CASE WHEN {_BRANCH} = '' THEN 'unnamed' ELSE {_BRANCH} END AS branch FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '//' ELSE '~' || source || '/' || lang || '..' || doc_id || ': ' || text || '\\' END AS b FROM documents)")
def sanitize_branch(spark, sf_dir):
    n = F.col("doc_id")
    raw = F.concat(F.lit("~"), "source", F.lit("/"), "lang", F.lit(".."), n.cast("string"), F.lit(": "), "text", F.lit("\\"))
    return table(spark, sf_dir, "documents").select("doc_id", fn.branch_name(F.when(n % 9 == 0, "//").otherwise(raw)).alias("branch"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'q: ' || t || ' [' || t || ']' ELSE 'query: ' || t END AS prompt FROM (SELECT doc_id, text AS t FROM documents)")
def template_apply(spark, sf_dir):
    template = F.when(F.col("doc_id") % 2 == 0, "q: {{text}} [{{text}}]").otherwise("query: ")
    return table(spark, sf_dir, "documents").select("doc_id", fn.template_applied(template, F.col("text")).alias("prompt"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'terraform' WHEN 2 THEN 'shell' WHEN 3 THEN 'unknown' ELSE 'json' END AS language FROM documents")
def language_detect(spark, sf_dir):
    names = F.array(*map(F.lit, ("a.PY", "x.tf.json", "Dockerfile.dev", "notes", "y.json")))
    path = F.concat("source", F.lit("/"), F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", language(path).alias("language"))


@query("SELECT doc_id, [t for t in [trim(x) for x in string_split(source || ', ' || lang || ',,' || ' x', ',')] if t <> ''] AS tags FROM documents")
def tag_parse(spark, sf_dir):
    raw = F.concat("source", F.lit(", "), "lang", F.lit(",, x"))
    return table(spark, sf_dir, "documents").select("doc_id", fn.tag_list(raw).alias("tags"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'function' ELSE 'block' END AS chunk_type, doc_id % 2 = 0 AS is_hex,
sha256('v1' || chr(0) || sha256(text) || chr(0) || source) AS index_hash, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS selector FROM documents""")
def symbol_keys(spark, sf_dir):
    n = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("method", "interface", "test", "variable"))), (n % 4 + 1).cast("int"))
    digits = F.when(n % 2 == 0, F.sha2("text", 256)).otherwise(F.concat(F.lit("X"), F.substring(F.sha2("text", 256), 2, 63)))
    return table(spark, sf_dir, "documents").select(
        "doc_id", fn.symbol_type(kind).alias("chunk_type"), fn.is_hex(digits, 64).alias("is_hex"),
        fn.structural_hash("v1", F.sha2("text", 256), F.col("source")).alias("index_hash"), fn.selector_key(n).alias("selector"))


@query("""SELECT doc_id, 'example.com/' || source AS go, './' || source AS js, source || '/x' AS required, source || '.y' AS py_from, source AS py_import FROM documents""")
def import_lines(spark, sf_dir):
    line = lambda *parts: F.concat(*[F.col("source") if x == "@" else F.lit(x) for x in parts])
    return table(spark, sf_dir, "documents").select(
        "doc_id", fn.go_import(line('  f "example.com/', "@", '"')).alias("go"), fn.js_import(line("import x from './", "@", "';")).alias("js"),
        fn.required(line("const a = require('", "@", "/x')")).alias("required"), fn.python_import(line("from ", "@", ".y import z")).alias("py_from"),
        fn.python_import(line("import ", "@", " as q, other")).alias("py_import"))


# ---- chunking


def _files(spark, sf_dir):
    return corpus(spark, sf_dir, False).select("project_root", "relative_path", "language", "file_hash", "source_hash", "file_size", "content")


@query("""WITH RECURSIVE d AS (SELECT source || '/doc_' || doc_id || '.txt' AS relative_path, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents),
w AS (
  SELECT relative_path, l, 0 AS first, coalesce(list_max([k + 1 for k in range(13, least(25, len(l))) if trim(l[k + 1]) = '']), least(25, len(l))) AS cut FROM d WHERE len(l) > 0
  UNION ALL
  SELECT relative_path, l, f, coalesce(list_max([k + 1 for k in range(f + 13, least(f + 25, len(l))) if trim(l[k + 1]) = '']), least(f + 25, len(l)))
  FROM (SELECT relative_path, l, CASE WHEN cut - 3 > first THEN cut - 3 ELSE cut END AS f FROM w) WHERE f < len(l))
SELECT relative_path, CAST(first + 1 AS INT) AS start_line, CAST(cut AS INT) AS end_line, CAST(strlen(array_to_string(l[first + 1:cut], chr(10))) AS BIGINT) AS n_bytes FROM w""")
def chunk_line_windows(spark, sf_dir):
    made = chunking.chunk_files(_files(spark, sf_dir), chunking.ChunkOptions(max_bytes=0, verbatim=True), ["relative_path", "start_line", "end_line", "content"])
    return made.select("relative_path", "start_line", "end_line", F.octet_length("content").cast("long").alias("n_bytes"))


@query()
def chunk_clamp_bytes(spark, sf_dir):
    return chunking.chunk_files(_files(spark, sf_dir)).select("relative_path", "chunk_index", "start_line", "end_line", F.octet_length("content").alias("n_bytes"))


def _code(spark, sf_dir, lang):
    """A function for each word: what stands between two words becomes the end of one and the head of the next."""
    begin, head, rest = ("package p\n\nimport \"fmt\"\n\n", "func ", "(a int) {\n\tfmt.Println(\"{\")\n}\n") if lang == "go" else ("import os\n\n", "def f_", "(a):\n    return a\n")
    words = F.regexp_replace("content", r"[^A-Za-z ]", " ")
    body = F.concat(F.lit(begin + head), F.regexp_replace(words, " +", f"{rest}\n{head}"), F.lit(rest))
    return _files(spark, sf_dir).withColumn("content", body).withColumn("language", F.lit(lang))


_BLOCKS = ["relative_path", "chunk_index", "chunk_type", "symbol_name", "start_line", "end_line"]


@query()
def chunk_semantic_go(spark, sf_dir):
    return chunking.chunk_files(_code(spark, sf_dir, "go"), columns=_BLOCKS)


@query()
def chunk_semantic_python(spark, sf_dir):
    return chunking.chunk_files(_code(spark, sf_dir, "python"), columns=_BLOCKS)


@query("""WITH s AS (SELECT doc_id AS relative_path, 0 AS ordinal, doc_id % 5 + 1 AS a, doc_id % 5 + 6 AS b, 'outer' AS symbol FROM documents UNION ALL SELECT doc_id, 1, doc_id % 5 + 3, doc_id % 5 + 4, 'inner' FROM documents
UNION ALL SELECT doc_id, 2, doc_id % 5 + 3, doc_id % 5 + 4, 'late' FROM documents),
l AS (SELECT relative_path, ordinal, b - a AS span, symbol, unnest(range(a, b + 1)) AS line FROM s),
o AS (SELECT relative_path, line, arg_min(symbol, span * 1000 + ordinal) AS symbol FROM l GROUP BY relative_path, line),
g AS (SELECT *, line - row_number() OVER (PARTITION BY relative_path, symbol ORDER BY line) AS island FROM o)
SELECT CAST(relative_path AS VARCHAR) AS relative_path, min(line) AS start_line, max(line) AS end_line, symbol FROM g GROUP BY relative_path, symbol, island""")
def structural_partition(spark, sf_dir):
    n = F.col("doc_id")
    one = lambda i, a, b, name: F.struct(F.lit(i).alias("ordinal"), (n % 5 + a).alias("start_line"), (n % 5 + b).alias("end_line"), F.lit(name).alias("symbol"))
    symbols = table(spark, sf_dir, "documents").select(n.cast("string").alias("relative_path"), F.explode(F.array(one(0, 1, 6, "outer"), one(1, 3, 4, "inner"), one(2, 3, 4, "late"))).alias("s")).select("relative_path", "s.*")
    return structural.runs(structural.owners(symbols))
