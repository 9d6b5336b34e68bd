"""What the corpus operators share: durable intermediate tables and small column helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and one machine does all the work, as in tests.
FALLBACK_DIR = "file:///tmp/checkpoints/lodestrata"

#: The byte classes of a "word": everything but blanks and the five ASCII line/tab controls.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every machine of the cluster can read, from ``spark.checkpoint.dir``. Only a local
    session may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return (named or FALLBACK_DIR).rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, and a
    lost executor costs no more than re-reading files."""
    path = f"{shared_dir(df.sparkSession)}/lodestrata/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def materialize_split(df: DataFrame, tag: str, first: Column) -> tuple[DataFrame, DataFrame]:
    """As ``materialize``, in one pass but as two tables, either of which can be discarded: the rows of
    which ``first`` is true, and the others."""
    path = f"{shared_dir(df.sparkSession)}/lodestrata/{tag}-{uuid.uuid4().hex}"
    df.withColumn("__first", F.when(first, 1).otherwise(0)).write.partitionBy("__first").parquet(path)
    out = []
    for side in (1, 0):
        own = f"{path}/__first={side}"
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(own)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)  # there may be no such row
        back = df.sparkSession.read.schema(df.schema).parquet(own)
        back._scratch_path = own
        out.append(back)
    return out[0], out[1]


def discard(df: DataFrame | None) -> None:
    """Delete the files of a ``materialize`` result that nothing will read again."""
    path = getattr(df, "_scratch_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Python workers go through texts in groups of about this many bytes.
GROUP_BYTES = 4 << 20


def text_groups(batches: Iterator[pa.RecordBatch], text_at: int, most: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches whose texts have about ``most`` bytes (one text may have more), and
    these texts as bytes."""
    for batch in batches:
        texts = batch.column(text_at).cast(pa.binary())
        group, first, held = [], 0, 0
        for i in range(batch.num_rows):
            group.append(texts[i].as_py())
            held += len(group[-1] or b"")
            if held >= most or i == batch.num_rows - 1:
                yield batch.slice(first, i + 1 - first), group
                group, first, held = [], i + 1, 0


def key_runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Batches sorted by their column ``key`` as tables of about ``least`` rows, none of which ends
    within the rows of a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def whole_rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """One struct column ``__row`` holding every input column, beside the given key columns, so
    that joins cannot clash with whatever names the input has."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), *[v.alias(k) for k, v in keys.items()])
