"""Chunks along symbols that another tool exported: validation, line ownership, bounded pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_hex, structural_hash, symbol_type, utf8_prefix
from .chunking import CHUNKS, SPACE, Chunk

PREVIEW_BYTES, TEXT_BYTES, DOC_BYTES, SIGNATURE_BYTES = 4096, 4096, 1024, 512
TAG = "structural-v1"

FUNCTION_KINDS = {"function", "method", "test", "constructor"}
CLASS_KINDS = {"class", "type", "struct", "interface", "enum"}


#: How exported symbols are used: where there are any, never, or not at all without them.
MODES = ("auto", "off", "required")
SCHEMA_VERSION = 1
PROFILE = "structural-profile-v1"
_RECORD = ("start_line", "end_line", "symbol", "fqn", "kind", "language", "signature", "docstring", "source_hash", "content_hash")


def parse_mode(text: str) -> str:
    """A mode by name; nothing is ``auto``."""
    mode = text.strip().lower() or "auto"
    if mode not in MODES:
        raise ValueError(f"unknown structure mode {text!r}: auto, off or required")
    return mode


def record_issue(record_hash: Column | None = None) -> Column:
    """What is wrong with an exported record (null: nothing): place, staleness, omitted or altered
    content. Truncated content cannot be checked; lines are cut from the file itself."""
    content = F.coalesce(F.col("content"), F.lit(""))
    return (F.when(F.coalesce(F.col("file"), F.lit("")) == "", "no file")
            .when(outside(F.col("file")), "file outside the project")
            .when(F.coalesce((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), F.lit(True)), "bad lines")
            .when(F.col("file_stale"), "stale file").when(F.col("content_omitted"), "content left out")
            .when(~F.coalesce(is_hex(F.col("source_hash"), 64), F.lit(False)), "bad source hash")
            .when(~F.coalesce(F.col("content_truncated"), F.lit(False)) & ~F.sha2(content, 256).eqNullSafe(F.col("content_hash")), "content hash differs"))


def outside(path: Column) -> Column:
    """Absolute, not in its shortest form, or leading out of the project."""
    return path.startswith("/") | path.rlike(r"(^|/)\.{1,2}(/|$)|//|/$")


def page_problems(pages: DataFrame, project_key: str | None = None) -> DataFrame:
    """(project_key, offset, problem) of export pages: versions, identity, counts, continuity from zero, one project,
    fingerprint and total. ``project_key``: that of the project they must be of."""
    order = Window.partitionBy("project_key").orderBy("offset")  # an export has a few thousand pages at most
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    next_, number = F.lead("offset").over(order), F.row_number().over(order)
    changes = lambda c: F.col(c) != F.first(c, ignorenulls=True).over(whole)  # noqa: E731 - a page without one says nothing of the others
    end = F.col("offset") + F.col("returned_records")
    missing = F.lit(False)
    for c in ("project", "project_key", "index_fingerprint", "offset", "limit", "total_records", "returned_records", "complete", "records"):
        missing = missing | F.col(c).isNull()
    other = F.lit(False) if project_key is None else F.col("project_key") != project_key
    problem = (F.when(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), "unknown version").when(missing, "missing fields")
               .when((F.col("project") == "") | ~is_hex(F.col("project_key"), 12) | other, "wrong project").when(~is_hex(F.col("index_fingerprint"), 64), "bad fingerprint")
               .when((F.col("returned_records") != F.size("records")) | (F.col("returned_records") > F.col("limit")) | (F.col("total_records") < 0), "wrong count")
               .when((number == 1) & (F.col("offset") != 0), "does not begin at zero")
               .when(changes("project") | changes("index_fingerprint") | changes("total_records"), "changes between pages")
               .when(next_.isNotNull() & (next_ != end), "gap or overlap").when(next_.isNotNull() & F.col("complete"), "complete before the end")
               .when(next_.isNull() & (~F.col("complete") | (end != F.col("total_records"))), "incomplete")
               .when(F.coalesce("next_offset", F.lit(0)) != F.when(F.col("complete"), 0).otherwise(end), "bad next offset"))
    return pages.withColumn("problem", problem).where("problem is not null").select("project_key", "offset", "problem")


def envelope_problems(records: DataFrame, project: str, project_key: str, fingerprint: str) -> DataFrame:
    """(file, problem) of records that belong to another export than their pages, or lie outside the project."""
    same = F.struct("schema_version", "project", "project_key", "index_fingerprint").eqNullSafe(F.struct(F.lit(SCHEMA_VERSION), F.lit(project), F.lit(project_key), F.lit(fingerprint)))
    problem = F.when(~same, "envelope differs").when(F.coalesce(F.col("file"), F.lit("")) == "", "no file").when(outside(F.col("file")), "file outside the project")
    return records.select("file", problem.alias("problem")).where("problem is not null")


def order_problem(records: DataFrame) -> DataFrame:
    """One row (problem): whether ordinals are one to the number of records, each once; null if so, or if no record has
    one. No record is compared with another: that all are different and the bounds are right is enough."""
    row = records.agg(F.count(F.lit(1)).alias("n"), F.count("ordinal").alias("given"), F.count_distinct("ordinal").alias("different"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))
    problem = (F.when((F.col("given") > 0) & (F.col("given") < F.col("n")), "some records have no ordinal")
               .when((F.col("given") > 0) & ((F.col("different") < F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n"))), "ordinals are not one to the number of records"))
    return row.select(problem.alias("problem"))


def file_issues(records: DataFrame) -> DataFrame:
    """(relative_path, issue): files with a bad record, with one symbol twice, or exported in two states."""
    bad = records.select(F.col("file").alias("relative_path"), record_issue().alias("issue")).where("issue is not null")
    selector = F.struct("start_line", "end_line", "symbol", "fqn", "kind")
    seen = records.groupBy(F.col("file").alias("relative_path")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(selector).alias("d"), F.min("source_hash").alias("lo"), F.max("source_hash").alias("hi"))
    twice = seen.select("relative_path", F.when(F.col("lo") != F.col("hi"), "exported in two states").when(F.col("d") < F.col("n"), "one symbol twice").alias("issue")).where("issue is not null")
    return bad.unionByName(twice).distinct()


def profiles(symbols: DataFrame) -> DataFrame:
    """(relative_path, source_hash, n_chunks, index_hash) of a file each: how many records it has, and the hash that
    its index has, which changes with the source and with any record. A file's records meet in its group."""
    line = F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _RECORD])
    record = F.struct("ordinal", "start_line", "end_line", F.sha2(line, 256).alias("h"))
    grouped = symbols.groupBy("relative_path", "source_hash").agg(F.array_sort(F.collect_list(record)).alias("r"))
    profile = F.sha2(F.concat_ws("\x00", F.lit(PROFILE), F.array_join("r.h", "\x00")), 256)
    return grouped.select("relative_path", "source_hash", F.size("r").alias("n_chunks"), structural_hash(TAG, F.col("source_hash"), profile).alias("index_hash"))


def owners(symbols: DataFrame) -> DataFrame:
    """(relative_path, line, symbol): each line belongs to the narrowest symbol around it, the first
    among equals. ``symbols``: relative_path, ordinal, start_line, end_line, symbol."""
    lines = symbols.withColumn("line", F.explode(F.sequence("start_line", "end_line")))
    best = F.min_by("symbol", F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "ordinal"))
    return lines.groupBy("relative_path", "line").agg(best.alias("symbol"))


def runs(owned: DataFrame) -> DataFrame:
    """(relative_path, start_line, end_line, symbol): consecutive lines of one owner."""
    order = Window.partitionBy("relative_path").orderBy("line")
    begins = (F.lag("symbol").over(order).isNull() | (F.lag("symbol").over(order) != F.col("symbol")) | (F.lag("line").over(order) != F.col("line") - 1)).cast("int")
    island = owned.withColumn("run", F.sum(begins).over(order))
    return island.groupBy("relative_path", "run").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.first("symbol").alias("symbol")).drop("run")


def kind_type(kind: Column) -> Column:
    return symbol_type(F.lower(kind))


def name_of(record: dict) -> str:
    return record.get("fqn") or record.get("symbol") or ""


def _parts(record: dict) -> list[str]:
    texts = [utf8_prefix(record.get(k) or "", n) for k, n in (("docstring", DOC_BYTES), ("signature", SIGNATURE_BYTES))]
    return [t for t in texts if t.strip(SPACE)]


def source_budget(record: dict) -> int:
    """Bytes of source that fit beside a record's docstring and signature."""
    return max(1, TEXT_BYTES - sum(len(t.encode()) + 2 for t in _parts(record)))


def embedding_text(record: dict, source: str) -> str:
    return utf8_prefix("\n\n".join([*_parts(record), source]), TEXT_BYTES)


def index_hash(source_hash: str, profile_hash: str) -> str:
    return hashlib.sha256("\0".join([TAG, source_hash, profile_hash]).encode()).hexdigest()


def _bounded(text: str, line: int, limit: int) -> Iterator[tuple[str, int, int]]:
    """(piece, first line, last line): at most ``limit`` bytes each, cut after a line end where there
    is one in the back half."""
    while text:
        piece = utf8_prefix(text, limit) or text[0]
        if len(piece) < len(text):
            cut = piece.rfind("\n") + 1
            if cut and len(piece[:cut].encode()) > len(piece.encode()) // 2:
                piece = piece[:cut]
        more = piece.count("\n")
        yield piece, line, line + more - (piece.endswith("\n") and more > 0)
        line, text = line + more, text[len(piece):]


def partition(text: str, records: list[dict]) -> list[tuple[Chunk, str | None]]:
    """Chunks of a file along its symbols, with the text to embed (none for gaps). Together they are
    the file."""
    lines = text.splitlines(keepends=True) if "\r" not in text else [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] else [])
    span = lambda r: r["end_line"] - r["start_line"]
    owner: list[int | None] = [None] * len(lines)
    for i in sorted(range(len(records)), key=lambda i: (-span(records[i]), -i)):  # narrow ones last, so that they stay
        for line in range(max(records[i]["start_line"], 1), min(records[i]["end_line"], len(lines)) + 1):
            owner[line - 1] = i
    out, first = [], 0
    while first < len(lines):
        end = first
        while end < len(lines) and owner[end] == owner[first]:
            end += 1
        source, own = "".join(lines[first:end]), None if owner[first] is None else records[owner[first]]
        limit = PREVIEW_BYTES if own is None else min(PREVIEW_BYTES, source_budget(own))
        for piece, a, b in _bounded(source, first + 1, limit):
            if own is None:
                out.append((Chunk(piece, a, b, origin="gap"), None))
            else:
                kind = (own.get("kind") or "").lower()
                type_ = "function" if kind in FUNCTION_KINDS else "class" if kind in CLASS_KINDS else "block"
                out.append((Chunk(piece, a, b, chunk_type=type_, symbol_name=name_of(own), origin="structural"), embedding_text(own, piece)))
        first = end
    return out


def chunk_structurally(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks (with ``embedding_content``) of the files that have symbols (relative_path, ordinal,
    start_line, end_line, symbol, fqn, kind, signature, docstring). A file meets its own symbols."""
    record = F.struct("ordinal", "start_line", "end_line", "symbol", "fqn", "kind", "signature", "docstring")
    grouped = symbols.groupBy("relative_path").agg(F.array_sort(F.collect_list(record)).alias("symbols"))
    keys = ["project_root", "relative_path", "language", "file_hash", "source_hash", "file_size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(n)[i].as_py() for n, k in enumerate([*keys, "content", "symbols"])}
                text, records = row.pop("content") or "", row.pop("symbols")
                out = [row | {"chunk_index": n} | c._asdict() | {"embedding_content": e} for n, (c, e) in enumerate(partition(text, records)) if c.content.strip(SPACE)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, _shape())

    return files.join(grouped, "relative_path").select(*keys, "content", "symbols").mapInArrow(run, CHUNKS + ", embedding_content string")


def _shape() -> pa.Schema:
    names = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(c.split()[0], names[c.split()[1]]) for c in (CHUNKS + ", embedding_content string").split(", ")])
