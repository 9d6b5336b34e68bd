"""A symbol export of another tool, checked whole before anything is cut along it.

An export is a folder of pages in JSON. What is wrong with a page, with the envelope of a record or with the
order of records spoils the export (``ExportError``); what is wrong with one record spoils its file, which is
then cut as if it had no symbols. All checks are aggregates over records; only the first problem comes back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import structural
from .scan import symbol_export
from .store import Files

#: Fixed values of the contract: bytes of a page and of an export.
PAGE_BYTES, TOTAL_BYTES = 64 << 20, 128 << 20


class ExportError(ValueError):
    """The export cannot be used at all."""


@dataclass(frozen=True)
class Export:
    """``symbols``: usable records (relative_path, ordinal, lines, names, source_hash). ``profiles``:
    (relative_path, source_hash, n_chunks, index_hash), a file each. ``issues``: (relative_path, issue)."""

    symbols: DataFrame
    profiles: DataFrame
    issues: DataFrame
    project_key: str = ""
    fingerprint: str = ""


def load(spark: SparkSession, path: str, project_key: str | None = None, page_bytes: int = PAGE_BYTES, total_bytes: int = TOTAL_BYTES) -> Export:
    """The export in a folder. ``project_key``: that of the project it must be of."""
    _within(Files(spark), path, page_bytes, total_bytes)
    pages, records = symbol_export(spark, path)
    bad = structural.page_problems(pages, project_key).orderBy("offset").first()
    if bad:
        raise ExportError(f"page at {bad['offset']}: {bad['problem']}")
    head = pages.where("offset = 0").select("project", "project_key", "index_fingerprint", "total_records").first()
    if head is None:
        raise ExportError("no pages")
    bad = structural.envelope_problems(records, head["project"], head["project_key"], head["index_fingerprint"]).first()
    if bad:
        raise ExportError(f"record of {bad['file']!r}: {bad['problem']}")
    problem = structural.order_problem(records).first()["problem"]
    if problem:
        raise ExportError(problem)
    return of_records(records, head["project_key"], head["index_fingerprint"])


def of_records(records: DataFrame, project_key: str = "", fingerprint: str = "") -> Export:
    """An export of records whose envelopes have been checked."""
    issues = structural.file_issues(records)
    usable = records.join(issues.select(F.col("relative_path").alias("file")).distinct(), "file", "left_anti").withColumnRenamed("file", "relative_path")
    return Export(usable, structural.profiles(usable), issues, project_key, fingerprint)


def project_key(spark: SparkSession, root: str) -> str:
    return spark.range(1).select(fn.project_key(F.lit(root))).first()[0]


def _within(files: Files, path: str, page_bytes: int, total_bytes: int) -> None:
    """Raise if a page, or all of them together, has too many bytes."""
    if not files.exists(path):
        raise ExportError(f"no export at {path}")
    total, pages = 0, files.system(path).listFiles(files.path(path), True)
    while pages.hasNext():
        page = pages.next()
        total += page.getLen()
        if page.getLen() > page_bytes:
            raise ExportError(f"{page.getPath().getName()} has over {page_bytes} bytes")
        if total > total_bytes:
            raise ExportError(f"the export has over {total_bytes} bytes")
