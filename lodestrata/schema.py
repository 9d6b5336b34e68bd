"""Table schemas and closed value sets."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.LongType()), T.StructField("file_path", T.StringType()), T.StructField("relative_path", T.StringType()),
    T.StructField("file_hash", T.StringType()), T.StructField("source_hash", T.StringType()), T.StructField("file_size", T.LongType()),
    T.StructField("language", T.StringType()), T.StructField("content", T.StringType()), T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()), T.StructField("start_byte", T.IntegerType()), T.StructField("end_byte", T.IntegerType()),
    T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_type", T.StringType()), T.StructField("symbol_name", T.StringType()),
    T.StructField("project_root", T.StringType()), T.StructField("indexed_at", T.TimestampType()), T.StructField("chunk_key", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

RESULT_COLUMNS = ["chunk_id", "file_path", "relative_path", "content", "start_line", "end_line", "chunk_type", "symbol_name", "language", "distance", "score"]

MEMORY_SCHEMA = "id long, content string, importance double, tags array<string>, created_at timestamp, expires_at timestamp, embedding array<float>"

MODES = ("semantic", "keyword", "hybrid")
CHUNK_TYPES = ("function", "class", "block", "comment", "generic")
WATCH_OPS = ("create", "write", "remove", "rename")
READINESS = ("empty", "profile_mismatch", "unknown", "stale", "ready")

#: Fields that keyword search looks at, in order.
TEXT_FIELDS = ("content", "symbol_name", "relative_path", "language", "chunk_type")
