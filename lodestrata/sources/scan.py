"""Reading a tree of files: what is ignored, what is text, what language it is in."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE_BYTES = 1 << 20
#: A file is text if so many bytes at its beginning are.
PROBE_BYTES = 8192
#: A level of the tree with more folders than this is listed by tasks; files that a task reads, about.
WIDE_LEVEL = 64
FILES_A_TASK = 500
LISTED = "path string, folder boolean, length long, modified long"

# ---- fixed values: languages by extension, compound suffix and name

EXTENSIONS = {
    "go": ".go", "python": ".py .pyw .pyi", "javascript": ".js .mjs .cjs .jsx", "typescript": ".ts .tsx .mts .cts", "vue": ".vue", "rust": ".rs",
    "java": ".java", "kotlin": ".kt .kts", "scala": ".scala", "c": ".c .h", "cpp": ".cpp .cc .cxx .c++ .hh .hpp .hxx .ipp .tpp", "cuda": ".cu .cuh",
    "csharp": ".cs .csx", "visualbasic": ".vb", "ruby": ".rb", "php": ".php .phtml", "dart": ".dart", "swift": ".swift", "lua": ".lua",
    "elixir": ".ex .exs", "svelte": ".svelte", "astro": ".astro", "razor": ".razor .cshtml .vbhtml", "shell": ".sh .bash .zsh .ksh .fish",
    "hcl": ".hcl", "terraform": ".tf .tfvars", "sql": ".sql", "markdown": ".md", "json": ".json", "yaml": ".yaml .yml", "toml": ".toml",
    "html": ".html .htm", "css": ".css .scss .sass .less",
}
COMPOUND = {".tfvars.json": "terraform", ".tf.json": "terraform"}
SHELL_NAMES = ("makefile", "gnumakefile", "dockerfile", "jenkinsfile")


def language(path: Column) -> Column:
    """The language of a path: compound suffix, then extension, then name, then ``unknown``."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    base = F.element_at(F.split(low, "/"), -1)
    extension = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    pairs = [x for lang, exts in EXTENSIONS.items() for e in exts.split() for x in (F.lit(e), F.lit(lang))]
    by_extension = F.element_at(F.create_map(*pairs), extension)
    out = F.when(base.isin(*SHELL_NAMES) | base.startswith("dockerfile.") | (base.endswith("rc") & ~F.contains(base, F.lit("."))), "shell").otherwise("unknown")
    out = F.coalesce(by_extension, out)
    for suffix, lang in COMPOUND.items():
        out = F.when(low.endswith(suffix), lang).otherwise(out)
    return out


def is_text(content: Column) -> Column:
    """No NUL and valid UTF-8 in the first bytes; an empty file is text. A character that the probe's
    end cuts makes a file binary."""
    head = F.substring(content, 1, PROBE_BYTES)
    return (F.length(content) == 0) | (F.is_valid_utf8(head.cast("string")) & (F.locate("\0", head.cast("string")) == 0))


def is_indexable(content: Column) -> Column:
    return is_text(content) & content.cast("string").rlike(r"[^\s\x0B\x{85}\x{A0}]")


# ---- ignore rules


def ignore_regex(rule: str) -> tuple[str, bool] | None:
    """A gitignore line as (regular expression for a relative path, whether it ignores), or None for
    blanks and comments. A match covers everything below a matched directory."""
    rule = rule.rstrip("\r\n")
    rule = rule.strip()
    if not rule or rule.startswith("#"):
        return None
    ignores = not rule.startswith("!")
    rule = rule.lstrip("!") if not ignores else rule
    rule = rule[1:] if rule.startswith("\\") else rule
    only_dirs = rule.endswith("/")
    body = rule.strip("/")
    anchored = "/" in body or rule.startswith("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2:]:
            end = body.index("]", i + 2)
            out, i = out + "[" + body[i + 1:end].replace("!", "^", 1 if body[i + 1] == "!" else 0) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if only_dirs else "(?:/.*)?$"), ignores


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches ignores."""
    out = F.lit(False)
    for made in filter(None, map(ignore_regex, rules)):
        out = F.when(path.rlike(made[0]), F.lit(made[1])).otherwise(out)
    return out


def watch_ignored(path: Column, patterns: list[str]) -> Column:
    """Patterns of the watcher: ``dir/**`` a directory and what is in it; else a glob for the name or
    for the whole path."""
    from ..functions.text import glob_regex

    base = F.element_at(F.split(path, "/"), -1)
    tests = []
    for p in patterns:
        if p.endswith("/**"):
            tests += [path.startswith(p[:-2]), path == p[:-3]]
        tests += [base.rlike(glob_regex(p)), path.rlike(glob_regex(p))]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


# ---- scans


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, without a slash at its end."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def _may_reopen(rules: list[str]) -> bool:
    """Whether a later rule takes files back in, so that no folder may be passed over unseen."""
    return any(made and not made[1] for made in map(ignore_regex, rules))


def listing(spark: SparkSession, root: str, rules: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES, wide: int = WIDE_LEVEL) -> DataFrame:
    """(path, relative_path, length, modified) of the regular files below a folder that are small enough and not
    ignored. Folders are listed level by level, and one that is ignored is never entered. A level of up
    to ``wide`` folders is listed on the driver, a wider one by tasks; of that the driver sees only the names
    of the folders that the next level has."""
    rules = list(rules or [])
    base = qualified(spark, root)
    prune = not _may_reopen(rules)
    found: list[DataFrame] = []
    level = [base]
    while level:
        if len(level) <= wide:
            rows = [row for folder in level for row in _driver_list(spark, folder)]
            listed = spark.createDataFrame(rows, LISTED)
        else:
            listed = spark.createDataFrame([(f,) for f in level], "folder string").repartition(min(len(level), 256)).mapInArrow(_list_folders, LISTED)
        relative = F.substring("path", len(base) + 2, 1 << 20)
        named = listed.withColumn("relative_path", relative)
        files = named.where("not folder").where(F.col("length") <= max_bytes).where(~ignored(F.col("relative_path"), rules))
        found.append(files.select("path", "relative_path", "length", "modified"))
        folders = named.where("folder").where(~F.col("relative_path").rlike(r"^(?:.*/)?\.git$"))
        if prune:  # what is below a folder is ignored if a file in it is that no rule names
            folders = folders.where(~ignored(F.concat("relative_path", F.lit("/\x00")), rules))
        level = [r[0] for r in folders.select("path").orderBy("path").collect()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _driver_list(spark: SparkSession, folder: str) -> list[tuple[str, bool, int, int]]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return [(s.getPath().toString(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in listed if s.isDirectory() or s.isFile()]


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for folder in batch.column(0).to_pylist():
            system, local = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
            infos = [i for i in system.get_file_info(fs.FileSelector(local)) if i.type in (fs.FileType.File, fs.FileType.Directory)]
            is_dir = [i.type == fs.FileType.Directory for i in infos]
            yield pa.record_batch({
                "path": pa.array([f"{folder}/{i.base_name}" for i in infos], pa.string()), "folder": pa.array(is_dir, pa.bool_()),
                "length": pa.array([i.size or 0 for i in infos], pa.int64()), "modified": pa.array([int(i.mtime_ns or 0) // 1_000_000 for i in infos], pa.int64())})


def contents(listed: DataFrame) -> DataFrame:
    """Listed files with their ``content``, read in tasks. A file that cannot be read fails the job, so what
    comes back is whole; one that has gone since it was listed is left out."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                system, local = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                try:
                    with system.open_input_stream(local) as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                yield pa.record_batch({"path": [path], "relative_path": batch.column(1).slice(i, 1), "length": pa.array([len(content)], pa.int64()), "content": pa.array([content], pa.binary())})

    parts = max(1, min(256, listed.count() // FILES_A_TASK + 1))
    return listed.select("path", "relative_path").repartition(parts, "path").mapInArrow(read, "path string, relative_path string, length long, content binary")


def tree(spark: SparkSession, root: str, rules: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES, project_root: str | None = None) -> DataFrame:
    """The regular files below a folder that are small enough and not ignored: project_root, path,
    relative_path, file_size, content, source_hash, file_hash, language. Large files are not read, ignored
    folders not even listed; hashing is where content is first looked at."""
    return _described(contents(listing(spark, root, rules, max_bytes)), project_root or root)


def some(spark: SparkSession, root: str, paths: list[str], rules: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES, project_root: str | None = None) -> DataFrame:
    """As ``tree``, of some files by their relative path, without looking at any other; files that are
    not there, too large, ignored or no regular files are left out."""
    base = qualified(spark, root)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = fs_path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for relative in paths:
        at = fs_path(f"{base}/{relative}")
        if system.exists(at) and (status := system.getFileStatus(at)).isFile() and status.getLen() <= max_bytes:
            found.append((f"{base}/{relative}", relative))
    named = spark.createDataFrame(found, "path string, relative_path string").where(~ignored(F.col("relative_path"), rules or []))
    return _described(contents(named), project_root or root)


def _described(files: DataFrame, project_root: str) -> DataFrame:
    digest = F.sha2("content", 256)
    named = files.select(F.lit(project_root).alias("project_root"), "path", "relative_path", F.col("length").alias("file_size"), "content")
    return named.withColumn("source_hash", digest).withColumn("file_hash", digest).withColumn("language", language(F.col("relative_path")))


def indexable(files: DataFrame) -> DataFrame:
    """Text files with something in them, content as text."""
    return files.where(is_indexable(F.col("content"))).withColumn("content", F.col("content").cast("string"))


def raw_hashes(files: DataFrame) -> DataFrame:
    """(relative_path, source_hash) of the files that would be indexed."""
    return files.where(is_indexable(F.col("content"))).select("relative_path", "source_hash")


# ---- documents that describe: evaluation sets, symbol exports

EXPORT_SCHEMA = (
    "schema_version int, project string, project_key string, index_fingerprint string, offset int, limit int, max_content_bytes int, total_records int, "
    "returned_records int, complete boolean, next_offset int, records array<struct<schema_version:int,ordinal:int,project:string,project_key:string,"
    "index_fingerprint:string,file:string,start_line:int,end_line:int,symbol:string,fqn:string,kind:string,language:string,signature:string,docstring:string,"
    "source_hash:string,content:string,content_hash:string,signature_truncated:boolean,docstring_truncated:boolean,content_truncated:boolean,"
    "content_omitted:boolean,omission_reason:string,file_stale:boolean>>")

EVALUATION_SCHEMA = (
    "version int, documents array<struct<id:string,language:string,text:string,source:struct<path:string,anchor:string,lines_before:int,lines_after:int>>>, "
    "queries array<struct<id:string,text:string,relevant:array<string>>>")


def symbol_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, records) of a paged symbol export in JSON."""
    pages = spark.read.schema(EXPORT_SCHEMA).json(path, multiLine=True)
    return pages, pages.select(F.explode("records").alias("r")).select("r.*")


def evaluation_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, relevant) of an evaluation set in JSON; unknown fields are an error."""
    whole = spark.read.schema(EVALUATION_SCHEMA).json(path, multiLine=True, mode="FAILFAST")
    documents = whole.select(F.explode("documents").alias("d")).select("d.*")
    asked = whole.select(F.explode("queries").alias("q")).select("q.*")
    relevant = asked.select(F.col("id").alias("query_id"), F.explode("relevant").alias("doc_id"))
    return documents, asked.select("id", "text"), relevant


def source_span(text: Column, anchor: Column, before: Column, after: Column, most: int = 120) -> Column:
    """The lines around an anchor that occurs exactly once, CRLF as LF; null otherwise or if they
    are more than ``most``."""
    clean = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    once = (F.char_length(clean) - F.char_length(F.replace(clean, anchor, F.lit("")))) == F.char_length(anchor)
    line = F.size(F.split(F.split_part(clean, anchor, F.lit(1)), "\n", -1))
    lines = F.split(clean, "\n", -1)
    last_line = line + F.size(F.split(anchor, "\n", -1)) - 1
    first, last = F.greatest(line - before, F.lit(1)), F.least(last_line + after, F.size(lines))
    return F.when(once & (last - first + 1 <= most), F.array_join(F.slice(lines, first, last - first + 1), "\n"))
