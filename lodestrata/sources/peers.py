"""Answers of a symbol graph, read from its JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOTSPOTS = "project string, hotspots array<struct<symbol:string,in_degree:int,shared_name:int>>"
_NODE = "struct<symbol:string,fqn:string,kind:string,file:string,start_line:int,end_line:int,depth:int,signature:string>"
IMPACT = f"found boolean, symbol string, project string, locations array<{_NODE}>, direct_callers array<{_NODE}>, blast_radius array<{_NODE}>, tests array<{_NODE}>, untested boolean"
RELATED = "project string, file string, indexed boolean, related array<struct<relative_path:string,reason:string,confidence:float>>"
STATUS = "project string, root string, registered boolean, path string, nodes int, edges int, files int, vectors int, precise_edges int, stale struct<changed:int,new:int,deleted:int>"
SYMBOL_AT = "file string, line int, symbol string, fqn string, kind string, start_line int, end_line int, resolution string"


def hotspots(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, in_degree, shared_name)."""
    return spark.read.schema(HOTSPOTS).json(path, multiLine=True).select(F.explode("hotspots").alias("h")).select("h.*")


def impact(spark: SparkSession, path: str) -> DataFrame:
    """(file, role, ord): the definition, then callers, then the rest, then tests; nothing for a
    symbol that the graph does not know."""
    whole = spark.read.schema(IMPACT).json(path, multiLine=True).where("found")
    out = None
    for i, (column, role) in enumerate((("locations", "definition"), ("direct_callers", "caller"), ("blast_radius", "affected"), ("tests", "test"))):
        rows = whole.select(F.posexplode(column).alias("n", "node")).select(F.col("node.file").alias("file"), F.lit(role).alias("role"), (F.lit(i * 1_000_000) + F.col("n")).alias("ord"))
        out = rows if out is None else out.unionByName(rows)
    return out


def related(spark: SparkSession, path: str) -> DataFrame | None:
    """(relative_path, reason, confidence), or None if the graph has not indexed the file: an empty
    answer about an indexed file is an answer."""
    whole = spark.read.schema(RELATED).json(path, multiLine=True)
    if whole.where("indexed").isEmpty():
        return None
    return whole.select(F.explode("related").alias("r")).select("r.*")


def graph_state(spark: SparkSession, path: str) -> str:
    """``fresh``, ``stale`` or ``not_indexed``."""
    row = spark.read.schema(STATUS).json(path, multiLine=True).first()
    if row is None or not row["registered"] or not row["nodes"]:
        return "not_indexed"
    return "stale" if row["stale"] is not None and any(row["stale"]) else "fresh"


def symbol_at(spark: SparkSession, path: str) -> dict | None:
    row = spark.read.schema(SYMBOL_AT).json(path, multiLine=True).first()
    return None if row is None or row["resolution"] in (None, "none") else row.asDict()
