"""The chunks of all projects as immutable segments behind a pointer, with the indexes that go with them.

A change writes one generation: a segment of new rows and a list of the rows that are dead from now on.
Then it replaces a small JSON file, the pointer, so readers see the old state or the new one and a failed
writer leaves the old one in force. What is written follows the change, not the table:

    chunks/gen=G/bucket=B     rows by a hash of their file
    postings/gen=G/part=P     blocks of a term's postings, by a hash of the term; each file is sorted by it
    vectors/gen=G/cell=C      (chunk_id, embedding), if cells have been trained
    dead/gen=G                (chunk_id, at): of older generations than ``at`` these rows are gone

A row is live unless a later generation has it among the dead, so an id can come back with new content.
Segments of like size are merged four at a time (and all of them once a third of the rows is dead), so a row
is rewritten a logarithmic number of times. Counts that BM25 needs stand in the pointer. So does the rest of
the state: marks, receipts, the embedding profile, branches (lists of segments, nothing is copied) and the
ledger of batches that streams have applied. Two generations back stay readable.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import chunk_key
from ..operators import bm25, cells
from ..schema import CHUNK_SCHEMA
from . import receipts

#: Hash buckets of files and of terms.
BUCKETS = 32
PARTS = 32
#: Stored bytes of chunks that a task turns into postings, and tokens for which a part gets one more file, about.
SPLIT, SPREAD = "32m", 10_000_000
#: Segments of one size class that are merged, the factor between classes, and the share of dead rows that
#: has everything merged.
MERGE, FACTOR, DEAD_SHARE = 4, 4, 1 / 3
#: Dead rows up to so many (16 bytes each; the pointer has their number) go to a scan by broadcast.
BROADCAST_DEAD = 1_000_000
#: Generations that stay readable after they are no longer current.
KEEP = 2

STORED = T.StructType([*CHUNK_SCHEMA.fields, T.StructField("n_tokens", T.IntegerType()), T.StructField("gen", T.LongType()), T.StructField("bucket", T.IntegerType())])
POSTINGS = "term string, base long, ids array<int>, tfs array<int>, lengths array<int>, gen long, part int"
VECTORS = "chunk_id long, embedding array<float>, gen long, cell int"
DEAD = "chunk_id long, n_tokens int, at long, gen long"
EMPTY = {
    "generation": -1, "last_id": 0, "segments": [], "dead": [], "live": {"chunks": 0, "tokens": 0}, "cells": None, "dirty": [], "profile": None, "receipts": {}, "manifests": {}, "ledger": {}, "branches": {}, "retired": []}


class Files:
    """Small files in any file system that Spark reads."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def system(self, path: str):
        return self.path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self.system(path).exists(self.path(path))

    def read(self, path: str) -> str:
        stream = self.system(path).open(self.path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replace a file: write beside it, then rename over it."""
        beside = f"{path}.{uuid.uuid4().hex}"
        stream = self.system(path).create(self.path(beside))
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(path).toUri() if "://" in path else self._jvm.java.net.URI("file:///"), self._conf)
        mode = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        array = self._jvm.java.lang.reflect.Array.newInstance(mode.getClass(), 1)
        array[0] = mode
        context.rename(self.path(beside), self.path(path), array)

    def delete(self, path: str) -> None:
        self.system(path).delete(self.path(path), True)


class DirtyError(RuntimeError):
    """An earlier change broke off; only a full reindex clears it."""


class SupersededError(RuntimeError):
    """A later attempt has begun."""


class ChunkStore:
    """The chunks of all projects."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    # ---- pointer

    @property
    def state(self) -> dict:
        name = f"{self.path}/pointer.json"
        return EMPTY | json.loads(self.files.read(name)) if self.files.exists(name) else dict(EMPTY)

    def _save(self, state: dict) -> None:
        self.files.write(f"{self.path}/pointer.json", json.dumps(state, sort_keys=True))

    # ---- reading

    def _table(self, folder: str, schema, gens: Sequence[int]) -> DataFrame:
        if not gens:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/{folder}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/gen={g}" for g in gens])

    def _live(self, rows: DataFrame, state: dict) -> DataFrame:
        """Rows (chunk_id, gen, ..) that no later generation has among its dead."""
        gens = [s["gen"] for s in state["segments"]]
        lists = [d for d in state["dead"] if gens and d["gen"] > min(gens)]
        if not lists:
            return rows
        dead = self._table("dead", DEAD, [d["gen"] for d in lists]).select(F.col("chunk_id").alias("__c"), F.col("at").alias("__at"))
        if sum(d["rows"] for d in lists) <= BROADCAST_DEAD:
            dead = F.broadcast(dead)
        return rows.join(dead, (F.col("chunk_id") == F.col("__c")) & (F.col("gen") < F.col("__at")), "left_anti")

    def _stored(self, state: dict | None = None, only: Sequence[dict] | None = None) -> DataFrame:
        state = state or self.state
        return self._live(self._table("chunks", STORED, [s["gen"] for s in (state["segments"] if only is None else only)]), state)

    def read(self) -> DataFrame:
        return self._stored().select(*CHUNK_SCHEMA.names)

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """(term, chunk_id, tf, length) of live chunks: of every segment only the terms' parts are read."""
        state = self.state
        parts = {part_of(t) for t in terms}
        rows = self._table("postings", POSTINGS, [s["gen"] for s in state["segments"]]).where(F.col("part").isin(sorted(parts)) & F.col("term").isin(list(terms)))
        return self._live(bm25.unpacked(rows, "gen"), state).select("term", "chunk_id", "tf", "length")

    def length_stats(self) -> tuple[int, float]:
        """How many chunks there are, and how many tokens they have on average."""
        live = self.state["live"]
        return live["chunks"], live["tokens"] / live["chunks"] if live["chunks"] else 0.0

    def near(self, query: Sequence[float], probes: int | None = None) -> DataFrame | None:
        """(chunk_id, embedding) of the live chunks in the cells nearest to a query; None if no cells
        have been trained for vectors of its length."""
        state = self.state
        found = self._centroids(state)
        if found is None or found.shape[1] != len(query) or not np.any(query):
            return None
        wanted = cells.nearest_cells(found, np.asarray(query, np.float64), probes or state["cells"]["probes"])
        rows = self._table("vectors", VECTORS, [s["gen"] for s in state["segments"]]).where(F.col("cell").isin(wanted))
        return self._live(rows, state).select("chunk_id", "embedding")

    # ---- writing

    def _write(self, rows: DataFrame, state: dict, ordered: bool = False) -> dict:
        """A segment with its postings and vectors, as the generation after ``state``. ``ordered``: the rows of a task
        have their bucket and are sorted by it and by id."""
        gen = state["generation"] + 1
        for folder in ("chunks", "postings", "vectors", "dead"):
            if self.files.exists(old := f"{self.path}/{folder}/gen={gen}"):
                self.files.delete(old)  # of a writer that broke off
        full = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNK_SCHEMA], *["bucket"] * ordered)
        full = full.withColumn("n_tokens", bm25.length(full))
        if not ordered:
            full = full.withColumn("bucket", _bucket(F.col("project_root"), F.col("relative_path")))
        # rows come by ranges of (bucket, key), in which ids go up, so the files of a bucket are few and sorted
        (full if ordered else full.sortWithinPartitions("bucket", "chunk_id")).write.partitionBy("bucket").parquet(f"{self.path}/chunks/gen={gen}")
        back = self._table("chunks", STORED, [gen])
        n, tokens, last = back.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.max("chunk_id"), F.lit(0))).first()
        if n:
            # a task has files of its own in every part: postings are more than the texts, and are not exchanged
            with self._splits(SPLIT):
                own = bm25.blocks(back.coalesce(min(1 + tokens // bm25.GROUP, PARTS + tokens // SPREAD))).withColumn("part", _part(F.col("term")))
                own.sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{self.path}/postings/gen={gen}")
            if state["cells"]:
                dealt = cells.assigned(back.select("chunk_id", "embedding"), self._centroids(state))
                dealt.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id").write.partitionBy("cell").parquet(f"{self.path}/vectors/gen={gen}")
        return {"gen": gen, "rows": n, "tokens": tokens, "last": last}

    @contextmanager
    def _splits(self, size: str) -> Iterator[None]:
        """What is run meanwhile reads files in pieces of a size."""
        name = "spark.sql.files.maxPartitionBytes"
        old = self.spark.conf.get(name)
        self.spark.conf.set(name, size)
        try:
            yield
        finally:
            self.spark.conf.set(name, old)

    def _commit(self, state: dict, new: dict | None, dead: DataFrame | None, **changes) -> None:
        """One generation after ``state``: a segment that was written for it, and (chunk_id, n_tokens) of the rows that go."""
        gen = state["generation"] + 1
        new = dict(new or {"gen": gen, "rows": 0, "tokens": 0, "last": 0})
        last = new.pop("last")
        gone = {"gen": gen, "rows": 0, "tokens": 0}
        if dead is not None:
            dead.select("chunk_id", "n_tokens", F.lit(gen).cast("long").alias("at")).write.mode("overwrite").parquet(f"{self.path}/dead/gen={gen}")
            n, tokens = self._table("dead", DEAD, [gen]).agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
            gone |= {"rows": n, "tokens": tokens or 0}
        if (state := self.state)["generation"] != gen - 1:
            raise SupersededError("another change was made meanwhile")
        live = {"chunks": state["live"]["chunks"] + new["rows"] - gone["rows"], "tokens": state["live"]["tokens"] + new["tokens"] - gone["tokens"]}
        segments = state["segments"] + [new] * bool(new["rows"])
        lists = state["dead"] + [{"gen": gen, "rows": gone["rows"]}] * bool(gone["rows"])
        self._save(state | {"generation": gen, "segments": segments, "dead": lists, "live": live, "last_id": max(state["last_id"], last)} | changes)
        self._merge(self._due())

    def _due(self) -> list[dict]:
        """The segments that it is time to merge."""
        state = self.state
        segments = state["segments"]
        if sum(d["rows"] for d in state["dead"]) > DEAD_SHARE * sum(s["rows"] for s in segments):
            return segments
        size = lambda s: int(math.log(max(s["rows"], 1), FACTOR))
        for level in sorted({size(s) for s in segments}):
            if sum(size(s) == level for s in segments) >= MERGE:
                return [s for s in segments if size(s) <= level]
        return []

    def _merge(self, old: list[dict]) -> None:
        """Rewrite the live rows of some segments as one, in a generation of its own."""
        if not old:
            return
        state = self.state
        gen = state["generation"] + 1
        rows = self._stored(state, old)
        new = self._write(rows.repartitionByRange("bucket", "chunk_id"), state)
        del new["last"]
        gens = {s["gen"] for s in old}
        left = [s for s in state["segments"] if s["gen"] not in gens]
        lists = []
        if left and state["dead"]:  # what is dead among the segments that stay
            kept = self._table("dead", DEAD, [d["gen"] for d in state["dead"]]).where(F.col("at") > min(s["gen"] for s in left)).select("chunk_id", "n_tokens", "at")
            kept.coalesce(max(1, sum(d["rows"] for d in state["dead"]) // BROADCAST_DEAD)).write.mode("overwrite").parquet(f"{self.path}/dead/gen={gen}")
            lists = [{"gen": gen, "rows": n}] * bool(n := self._table("dead", DEAD, [gen]).count())
        self._save(state | {"generation": gen, "segments": left + [new] * bool(new["rows"]), "dead": lists, "retired": state["retired"] + [[g, gen] for g in sorted(gens | {d["gen"] for d in state["dead"]})]})
        self._collect_garbage()

    def _collect_garbage(self) -> None:
        """Delete generations that neither a reader of late, nor a branch, nor the pointer needs."""
        state = self.state
        used = lambda s: {x["gen"] for x in [*s["segments"], *s["dead"]]}
        held = used(state).union(*map(used, state["branches"].values()))
        due = [g for g, since in state["retired"] if since + KEEP <= state["generation"] and g not in held]
        for g in due:
            for folder in ("chunks", "postings", "vectors", "dead"):
                if self.files.exists(path := f"{self.path}/{folder}/gen={g}"):
                    self.files.delete(path)
        if due:
            self._save(state | {"retired": [x for x in state["retired"] if x[0] not in due]})

    def compact(self) -> None:
        """Merge everything now."""
        self._merge(self.state["segments"])

    # ---- cells

    def _centroids(self, state: dict) -> np.ndarray | None:
        if not state["cells"]:
            return None
        if getattr(self, "_known", (None,))[0] != state["cells"]["name"]:
            rows = self.spark.read.schema("cell int, centroid array<double>").parquet(f"{self.path}/cells/{state['cells']['name']}").orderBy("cell").collect()  # cells.MOST at most
            self._known = (state["cells"]["name"], np.array([r["centroid"] for r in rows]))
        return self._known[1]

    def train_cells(self, n_cells: int | None = None, **options) -> dict:
        """Learn cells from a bounded sample of the vectors and store every vector by its cell; a later
        call learns them anew. Returns what was learnt: cells, probes, recall on the sample."""
        state = self.state
        centroids, facts = cells.train(self._stored(state).select("chunk_id", "embedding"), state["live"]["chunks"], n_cells, **options)
        if centroids is None:
            self._save(state | {"cells": None})
            return facts
        name = uuid.uuid4().hex
        self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/cells/{name}")
        self._save(state | {"cells": facts | {"name": name}})
        self._merge(state["segments"])
        return facts

    # ---- changes

    def _with_keys(self, rows: DataFrame) -> DataFrame:
        have = set(rows.columns)
        for f in CHUNK_SCHEMA:
            if f.name not in have:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        key = chunk_key(*[F.col(c) for c in ("project_root", "relative_path", "start_byte", "end_byte", "start_line", "chunk_index")])
        return rows.withColumn("chunk_key", key).withColumn("file_path", F.coalesce("file_path", F.concat_ws("/", "project_root", "relative_path")))

    @contextmanager
    def staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """The rows as a table that is read as often as needed: chunking and embedding run once, and
        what depends on how rows are dealt out is settled once."""
        path = f"{self.path}/staging/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        try:
            yield self.spark.read.schema(rows.schema).parquet(path)
        finally:
            self.files.delete(path)

    def _ranged(self, rows: DataFrame, base: int) -> DataFrame:
        """Rows by ranges of buckets and keys, with ids after ``base`` in that order. Each range has its own ids, 2**33 apart,
        so that rows are numbered where they are, and ids have gaps."""
        by = ["bucket", "chunk_key"]
        ranged = rows.withColumn("bucket", _bucket(F.col("project_root"), F.col("relative_path"))).repartitionByRange(*by).sortWithinPartitions(*by)
        return ranged.withColumn("chunk_id", F.lit(base) + 1 + F.monotonically_increasing_id())

    def _of_files(self, files: DataFrame) -> DataFrame:
        """The stored chunks of some files (project_root, relative_path), with few columns; only the files'
        buckets are read."""
        files = files.select("project_root", "relative_path").distinct()
        buckets = [r[0] for r in files.select(_bucket(F.col("project_root"), F.col("relative_path"))).distinct().collect()]  # BUCKETS at most
        rows = self._stored().where(F.col("bucket").isin(buckets)).select("project_root", "relative_path", "chunk_key", "chunk_id", "n_tokens")
        return rows.join(files, ["project_root", "relative_path"], "left_semi")

    def upsert(self, rows: DataFrame, dim: int | None = None) -> None:
        """Add rows; of a key that is there already the new row counts and keeps the id. ``dim``: all
        vectors must have this length, or nothing is written."""
        with self.staged(self._with_keys(rows)) as staged:
            if dim is not None and not staged.where(F.col("embedding").isNotNull() & (F.size("embedding") != dim)).isEmpty():
                raise ValueError(f"vectors of other than {dim} dimensions")
            known = self._of_files(staged).select("chunk_key", F.col("chunk_id").alias("__id"), "n_tokens")
            met = staged.dropDuplicates(["chunk_key"]).join(known.drop("n_tokens"), "chunk_key", "left")
            again = met.where("__id is not null").withColumn("chunk_id", F.col("__id")).drop("__id")
            dead = known.join(staged.select("chunk_key"), "chunk_key", "left_semi").select(F.col("__id").alias("chunk_id"), "n_tokens")
            state = self.state
            fresh = self._ranged(met.where("__id is null").drop("__id"), state["last_id"]).drop("bucket")
            self._commit(state, self._write(again.unionByName(fresh, allowMissingColumns=True), state), dead)

    def replace_files(self, rows: DataFrame, project_root: str, gone: DataFrame | None = None, batch: tuple[str, int] | None = None) -> bool:
        """New chunks of some files instead of their old ones, and files (relative_path) that go, in one
        generation. ``batch``: a stream's name and the number of its batch; one that was applied
        before changes nothing (False)."""
        state = self.state
        if batch and batch[1] <= state["ledger"].get(batch[0], -1):
            return False
        new = self._write(self._ranged(self._with_keys(rows), state["last_id"]), state, ordered=True)
        dead = None
        if state["segments"]:
            touched = self._table("chunks", STORED, [new["gen"]]).select("relative_path").distinct()
            if gone is not None:
                touched = touched.unionByName(gone.select("relative_path")).distinct()
            dead = self._of_files(touched.withColumn("project_root", F.lit(project_root)))
        ledger = {"ledger": state["ledger"] | dict([batch])} if batch else {}
        self._commit(state, new, dead, **ledger)
        return True

    def delete_where(self, condition: Column) -> None:
        state = self.state
        self._commit(state, None, self._stored(state).where(condition).select("chunk_id", "n_tokens"))

    def delete_file(self, project_root: str, path: str) -> int:
        """A file of one project: by relative path, or else by absolute path. Other projects' files of
        the same name stay."""
        own = F.col("project_root") == project_root
        for column in ("relative_path", "file_path"):
            hit = own & (F.col(column) == path)
            n = self.read().where(hit).count()
            if n:
                self.delete_where(hit)
                return n
        return 0

    def delete_project(self, project_root: str) -> None:
        self.delete_where(F.col("project_root") == project_root)

    def delete_all(self) -> None:
        state = self.state
        gen = state["generation"] + 1
        retired = [[x["gen"], gen] for x in [*state["segments"], *state["dead"]]]
        self._save(state | {"generation": gen, "segments": [], "dead": [], "live": EMPTY["live"], "cells": None, "retired": state["retired"] + retired})
        self._collect_garbage()

    def reset(self, project_root: str | None = None, confirm: str = "") -> None:
        """Delete a project or everything, with the profile and the proof of what was ingested."""
        if confirm != "yes":
            raise ValueError('a reset needs confirm="yes"')
        self.delete_project(project_root) if project_root else self.delete_all()
        state = self.state
        kept = {name: {k: v for k, v in state[name].items() if project_root and k != project_root} for name in ("receipts", "manifests")}
        self._save(state | {"profile": state["profile"] if project_root else None} | kept)

    def clean(self) -> dict:
        """Counts, as of now."""
        row = self.read().agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("project_root", "relative_path").alias("files")).first()
        return {"chunks": row["chunks"], "files": row["files"], "orphans": 0, "vacuumed": 0}

    # ---- marks, receipts, profile

    def guarded(self, project_root: str, change: Callable[[], None], full: bool = False) -> None:
        """Run a change under a dirty mark: it stays if the change fails, and then only a full one may
        follow."""
        state = self.state
        if project_root in state["dirty"] and not full:
            raise DirtyError(project_root)
        self._save(state | {"dirty": sorted({*state["dirty"], project_root})})
        change()
        state = self.state
        self._save(state | {"dirty": [p for p in state["dirty"] if p != project_root]})

    def begin_receipt(self, project_root: str, mode: str = "auto") -> str:
        """A new attempt; it takes back the proof of the last one."""
        attempt, state = uuid.uuid4().hex, self.state
        self._put(state, receipts.begun(project_root, attempt, mode, state["receipts"].get(project_root, {})))
        return attempt

    def _current(self, project_root: str, attempt: str) -> tuple[dict, dict]:
        """The state and the attempt's receipt; only the attempt that began last may go on."""
        state = self.state
        receipt = state["receipts"].get(project_root, {})
        if receipt.get("attempt") != attempt:
            raise SupersededError(project_root)
        return state, receipt

    def _put(self, state: dict, receipt: dict) -> None:
        receipts.check_receipt(receipt, receipt["project"])
        self._save(state | {"receipts": state["receipts"] | {receipt["project"]: receipt}})

    def record_receipt(self, project_root: str, attempt: str, **facts) -> None:
        """What was ingested; success is not said before the receipt is finished."""
        state, receipt = self._current(project_root, attempt)
        self._put(state, receipt | facts)

    def finish_receipt(self, project_root: str, attempt: str, *, complete: bool, **facts) -> None:
        """Only the attempt that began last may finish. A run over some paths is never complete."""
        state, receipt = self._current(project_root, attempt)
        whole = {"scope_complete": True, "ingestion_complete": True} if complete else {}
        done = whole | {"success": True, "complete": complete, "last_success": attempt, "last_success_at": receipts.now()}
        self._put(state, receipt | facts | done)

    def fail_receipt(self, project_root: str, attempt: str, code: str) -> None:
        """An attempt that broke off: why, in a word; what succeeded last is kept."""
        state, receipt = self._current(project_root, attempt)
        notes = [*receipt["fallbacks"], receipts.fallback(code)][:receipts.MOST_FALLBACKS]
        self._put(state, receipt | {"fallbacks": notes, "error_count": max(1, receipt["error_count"]), "ingestion_complete": False, "success": False, "complete": False})

    def receipt(self, project_root: str) -> dict | None:
        """The project's receipt; ``InvalidProof`` if it is not one that can be."""
        found = self.state["receipts"].get(project_root)
        if found is not None:
            receipts.check_receipt(found, project_root)
        return found

    def proven(self, project_root: str) -> bool:
        return receipts.succeeded(self.state["receipts"].get(project_root))

    def invalidate(self, project_root: str) -> None:
        """The receipt is no longer whole, and the manifest that goes with it is gone."""
        state = self.state
        if project_root in state["receipts"]:
            rest = {k: v for k, v in state["manifests"].items() if k != project_root}
            self._save(state | {"manifests": rest, "receipts": state["receipts"] | {project_root: state["receipts"][project_root] | {"complete": False}}})

    def write_manifest(self, project_root: str, attempt: str, **facts) -> None:
        """What a whole run has read, bound to the attempt that goes on."""
        state, _ = self._current(project_root, attempt)
        made = receipts.manifest(project_root, attempt, state["generation"], **facts)
        receipts.check_manifest(made, project_root)
        self._save(state | {"manifests": state["manifests"] | {project_root: made}})

    def manifest(self, project_root: str) -> dict | None:
        found = self.state["manifests"].get(project_root)
        if found is not None:
            receipts.check_manifest(found, project_root)
        return found

    def check_profile(self, active: dict) -> None:
        """Vectors of another profile must not be mixed or searched."""
        stored = self.state["profile"]
        if stored is None and self.state["live"]["chunks"]:
            raise ValueError("the index has no embedding profile; rebuild it")
        if stored is not None and stored != active:
            raise ValueError("the index has another embedding profile; rebuild it")

    def save_profile(self, active: dict) -> None:
        self._save(self.state | {"profile": active})

    # ---- branches

    def snapshot(self, branch: str) -> None:
        """Keep the current chunks and profile under a branch's name: its segments are not deleted."""
        state = self.state
        kept = {k: state[k] for k in ("segments", "dead", "live", "cells", "profile", "receipts", "manifests")}
        self._save(state | {"branches": state["branches"] | {branch_directory(branch): kept}})

    def switch(self, branch: str, active: dict | None = None) -> bool:
        """Make a branch's chunks current, if it has any of the active profile."""
        state = self.state
        kept = state["branches"].get(branch_directory(branch))
        if kept is None or active is not None and kept["profile"] != active:
            return False
        gen = state["generation"] + 1
        now = {x["gen"] for x in [*kept["segments"], *kept["dead"]]}
        retired = [[x["gen"], gen] for x in [*state["segments"], *state["dead"]] if x["gen"] not in now]
        self._save(state | kept | {"generation": gen, "retired": state["retired"] + retired})
        return True


def _bucket(root: Column, path: Column) -> Column:
    """The first five bits of an MD5 of project and path."""
    return F.floor(F.conv(F.substring(F.md5(F.concat_ws("\x00", root, path).cast("binary")), 1, 2), 16, 10).cast("int") * BUCKETS / 256).cast("int").alias("bucket")


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int").alias("part")


def part_of(term: str) -> int:
    """What ``_part`` says of a term, on the driver."""
    return (xxhash.xxh64_intdigest(term.encode(), 42) + (1 << 63)) % (1 << 64) % PARTS  # the sign bit: 2**63 is a multiple of PARTS


def branch_directory(branch: str) -> str:
    flat = branch.translate(str.maketrans("/\\: ~", "-----")).replace("..", "--").strip("-")
    return flat or "unnamed"
