"""Filter options as one predicate that reaches the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex
from ..options import FilterOptions

#: Allow-lists longer than this become a semi join.
LONG_LIST = 1000


def predicate(o: FilterOptions) -> Column:
    """All conditions but a long allow-list. Wanted languages and types are lower-cased, stored ones
    are not."""
    parts = [F.lit(True)]
    if o.project_root:
        parts.append(F.col("project_root") == o.project_root)
    for column, one, many in (("language", o.language, o.languages), ("chunk_type", o.chunk_type, o.chunk_types)):
        if one or many:
            parts.append(F.col(column) == one.lower() if one else F.col(column).isin([x.lower() for x in many]))
    if o.file_glob:
        parts.append(F.col("relative_path").rlike(glob_regex(o.file_glob)))
    if o.directory:
        parts.append(F.col("relative_path").startswith(o.directory.rstrip("/") + "/"))
    if o.files and len(o.files) <= LONG_LIST:
        parts.append(F.col("relative_path").isin(list(o.files)))
    if o.min_line > 0 and o.max_line > 0:
        parts.append(F.col("start_line").between(o.min_line, o.max_line))
    elif o.min_line > 0:
        parts.append(F.col("start_line") >= o.min_line)
    elif o.max_line > 0:
        parts.append(F.col("start_line") <= o.max_line)
    return reduce(lambda a, b: a & b, parts)


def filtered(chunks: DataFrame, o: FilterOptions) -> DataFrame:
    out = chunks.where(predicate(o))
    if len(o.files) > LONG_LIST:
        wanted = chunks.sparkSession.createDataFrame([(x,) for x in sorted(set(o.files))], "relative_path string")
        out = out.join(wanted, "relative_path", "left_semi")
    return out


def marked(chunks: DataFrame, o: FilterOptions, name: str) -> DataFrame:
    """All chunks, with whether they pass as a column."""
    if len(o.files) <= LONG_LIST:
        return chunks.withColumn(name, predicate(o))
    wanted = chunks.sparkSession.createDataFrame([(x, True) for x in sorted(set(o.files))], f"relative_path string, `{name}` boolean")
    return chunks.join(wanted, "relative_path", "left").withColumn(name, predicate(o) & F.coalesce(F.col(name), F.lit(False)))
