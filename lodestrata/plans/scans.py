"""What a scan takes, what a tree looks like, and whether a symbol export can be used."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, structural
from ..sources import scan
from .registry import corpus, query, table

#: The probe's end cuts a character if the byte after it continues one.
_CUT = "(strlen(text) > 8192 AND hex(encode(text))[16385:16386] BETWEEN '80' AND 'BF')"


@query(rf"""WITH d AS (SELECT doc_id, doc_id % 5 AS k, NOT {_CUT} AS whole, regexp_matches(text, '\S') AS said FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN whole WHEN 1 THEN false WHEN 4 THEN false ELSE true END AS is_text, CASE k WHEN 0 THEN whole AND said WHEN 3 THEN true ELSE false END AS is_indexable FROM d""")
def scan_eligibility(spark, sf_dir):
    """Texts as they are, led by a NUL, replaced by blanks, led by more than the probe sees and a NUL, led by no UTF-8."""
    text, k = F.col("text").cast("binary"), F.col("doc_id") % 5
    nul, broken = F.unhex(F.lit("00")), F.unhex(F.lit("FF"))
    content = (F.when(k == 1, F.concat(nul, text)).when(k == 2, F.lit(" \n\t").cast("binary"))
               .when(k == 3, F.concat(F.repeat(F.lit("x"), 9000).cast("binary"), nul, text)).when(k == 4, F.concat(broken, text)).otherwise(text))
    rows = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return rows.select("doc_id", scan.is_text(F.col("content")).alias("is_text"), scan.is_indexable(F.col("content")).alias("is_indexable"))


RULES = ["# sources that are left out", "src1/", "*_5*.txt", "!doc_15.txt", "/src2/doc_1*", "**/doc_?0.txt", "doc_[13].txt", "!/src3/**", "doc_7"]


@query(r"""WITH p AS (SELECT doc_id, source || '/doc_' || doc_id || '.txt' AS path, source, CAST(doc_id AS VARCHAR) AS n FROM documents)
SELECT doc_id, CASE WHEN source = 'src3' THEN false WHEN n IN ('1', '3') THEN true WHEN length(n) = 2 AND ends_with(n, '0') THEN true WHEN source = 'src2' AND starts_with(n, '1') THEN true
WHEN n = '15' THEN false WHEN starts_with(n, '5') THEN true ELSE source = 'src1' END AS ignored FROM p""")
def ignore_rules(spark, sf_dir):
    path = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", scan.ignored(path, RULES).alias("ignored"))


@query("""WITH e AS (SELECT DISTINCT '' AS parent, source AS name, true AS is_dir, 1 AS level FROM documents UNION ALL SELECT source, 'doc_' || doc_id || '.txt', false, 2 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, name) AS n FROM e) SELECT parent, name, is_dir, level FROM r WHERE n <= 15""")
def directory_tree(spark, sf_dir):
    return graph.directory_tree(corpus(spark, sf_dir, False).select("relative_path"))


# ---- symbol exports

#: Pages of up to 20 documents, exports of ten pages; some pages are spoilt.
_PAGES = """WITH p AS (SELECT doc_id // 200 AS x, doc_id // 20 AS page, count(*) AS n FROM documents GROUP BY ALL),
o AS (SELECT *, sum(n) OVER (PARTITION BY x ORDER BY page) - n AS zero, sum(n) OVER (PARTITION BY x) AS total, page = max(page) OVER (PARTITION BY x) AS last FROM p),
s AS (SELECT *, CASE WHEN page % 13 = 2 THEN n + 1 ELSE n END AS said, page % 17 = 3 AS torn, page % 19 = 4 AS moved, page % 23 = 5 AS old, page % 29 = 6 AS nameless FROM o),
f AS (SELECT *, CASE WHEN moved THEN zero + 1 ELSE zero END AS pos, CASE WHEN torn THEN NOT last ELSE last END AS complete FROM s),
w AS (SELECT *, lead(pos) OVER (PARTITION BY x ORDER BY pos) AS next, row_number() OVER (PARTITION BY x ORDER BY pos) AS k FROM f)"""


@query(f"""{_PAGES}, v AS (SELECT x, pos, CASE WHEN old THEN 'unknown version' WHEN nameless THEN 'missing fields' WHEN said <> n THEN 'wrong count' WHEN k = 1 AND pos <> 0 THEN 'does not begin at zero'
WHEN next <> pos + said THEN 'gap or overlap' WHEN next IS NOT NULL AND complete THEN 'complete before the end' WHEN next IS NULL AND (NOT complete OR pos + said <> total) THEN 'incomplete'
WHEN next_offset <> CASE WHEN complete THEN 0 ELSE pos + said END THEN 'bad next offset' END AS problem FROM (SELECT *, CASE WHEN last THEN 0 ELSE zero + n END AS next_offset FROM w))
SELECT substr(md5(CAST(x AS VARCHAR)), 1, 12) AS project_key, CAST(pos AS BIGINT) AS "offset", problem FROM v WHERE problem IS NOT NULL""")
def export_pages(spark, sf_dir):
    n = F.col("doc_id")
    grouped = table(spark, sf_dir, "documents").groupBy(F.floor(n / 200).alias("x"), F.floor(n / 20).alias("page")).agg(F.collect_list("doc_id").alias("records"))
    own = Window.partitionBy("x")
    size = F.size("records").cast("long")
    rows = grouped.withColumn("n", size).withColumn("at", F.sum("n").over(own.orderBy("page")) - F.col("n")).withColumn("total", F.sum("n").over(own)).withColumn("last", F.col("page") == F.max("page").over(own))
    hit = lambda m, r: F.col("page") % m == r
    key = F.md5(F.col("x").cast("string"))
    pages = rows.select(
        F.when(hit(23, 5), 2).otherwise(1).alias("schema_version"), F.when(~hit(29, 6), F.lit("p")).alias("project"), F.substring(key, 1, 12).alias("project_key"),
        F.concat(key, key).alias("index_fingerprint"), (F.col("at") + hit(19, 4).cast("int")).alias("offset"), F.lit(1000).alias("limit"), F.col("total").alias("total_records"),
        (F.col("n") + hit(13, 2).cast("int")).alias("returned_records"), F.when(hit(17, 3), ~F.col("last")).otherwise(F.col("last")).alias("complete"),
        F.when(F.col("last"), 0).otherwise(F.col("at") + F.col("n")).alias("next_offset"), "records")
    return structural.page_problems(pages)


def _records(spark, sf_dir):
    """Two records of each document; some are spoilt, and the second is the first again in some."""
    n, ordinal = F.col("doc_id"), F.col("ordinal")
    k = F.when(ordinal == 1, n % 11)
    rows = table(spark, sf_dir, "documents").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"))
    line = F.when((ordinal == 2) & (n % 11 != 7), 5).otherwise(1)
    return rows.select(
        F.concat("source", F.lit("/doc_"), n.cast("string"), F.lit(".txt")).alias("file"), "ordinal", line.alias("start_line"), F.when(k == 1, 0).otherwise(line + 2).alias("end_line"),
        F.concat(F.lit("s"), line.cast("string")).alias("symbol"), F.lit("q").alias("fqn"), F.lit("function").alias("kind"), F.col("lang").alias("language"), F.lit("").alias("signature"), F.lit("").alias("docstring"),
        F.when(k == 2, "x").when(k == 3, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("text", 256)).alias("source_hash"), F.when(k.isin(4, 5), F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"),
        F.sha2("text", 256).alias("content_hash"), F.coalesce(k == 5, F.lit(False)).alias("content_truncated"), F.coalesce(k == 6, F.lit(False)).alias("content_omitted"), F.coalesce(k == 8, F.lit(False)).alias("file_stale"))


@query("""SELECT source || '/doc_' || doc_id || '.txt' AS relative_path, unnest(CASE doc_id % 11 WHEN 1 THEN ['bad lines'] WHEN 2 THEN ['bad source hash', 'exported in two states'] WHEN 3 THEN ['exported in two states']
WHEN 4 THEN ['content hash differs'] WHEN 6 THEN ['content left out'] WHEN 7 THEN ['one symbol twice'] WHEN 8 THEN ['stale file'] ELSE CAST([] AS VARCHAR[]) END) AS issue FROM documents""")
def export_file_issues(spark, sf_dir):
    return structural.file_issues(_records(spark, sf_dir))


@query("""WITH r AS (SELECT source || '/doc_' || doc_id || '.txt' AS relative_path, sha256(text) AS h, lang, doc_id, o, CASE WHEN o = 2 THEN 5 ELSE 1 END AS a FROM documents, (SELECT unnest([1, 2]) AS o) WHERE doc_id % 11 IN (0, 5, 9, 10)),
l AS (SELECT *, sha256(concat_ws(chr(0), a, a + 2, 's' || a, 'q', 'function', coalesce(lang, ''), '', '', h, h)) AS line FROM r)
SELECT relative_path, h AS source_hash, CAST(count(*) AS INT) AS n_chunks, sha256('structural-v1' || chr(0) || h || chr(0) || sha256('structural-profile-v1' || chr(0) || string_agg(line, chr(0) ORDER BY o))) AS index_hash FROM l GROUP BY relative_path, h""")
def export_profiles(spark, sf_dir):
    from ..sources import exports

    return exports.of_records(_records(spark, sf_dir)).profiles
