"""One project's index: what the command line and library users call."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .operators import chunking, embedding, evaluate, freshness, graph, search, stats, structural
from .options import BATCH_LIMIT, DEFAULT_LIMIT, SearchOptions, parse_target
from .sources import exports, receipts, scan
from .sources.cache import EmbeddingCache
from .sources.memories import MemoryStore
from .sources.store import ChunkStore, SupersededError
from .streaming import watch as watching

IGNORED = [".git/", "node_modules/", "vendor/", "__pycache__/", "*.min.js", "*.lock"]
IGNORE_FILES = (".gitignore", ".lodestrataignore")


class PreflightError(RuntimeError):
    """What indexing requires is not there; nothing has been changed."""


class Engine:
    """``root`` is the file tree, ``data`` the folder of the store."""

    def __init__(self, spark: SparkSession, root: str, data: str, embedder: embedding.Embedder | None = None, project: str | None = None, ignore: Sequence[str] = (), chunks: chunking.ChunkOptions | None = None, cache: EmbeddingCache | None = None):
        self.spark, self.root, self.project = spark, root.rstrip("/"), project or root.rstrip("/")
        self.embedder = embedder or embedding.HashingEmbedder()
        self.store, self.ignore, self.options = ChunkStore(spark, data), list(ignore), chunks or chunking.ChunkOptions()
        self.cache, self.memories = cache, MemoryStore(spark, f"{data.rstrip('/')}/memories", self.embedder)

    @property
    def profile(self) -> dict:
        return {"schema_version": 1, "provider": "local", "model": self.embedder.model, "dimensions": self.embedder.dimensions, "distance": "cosine", "modality": "text", "preprocessor": "code-chunker-v2-lossless"}

    # ---- files

    def rules(self) -> list[str]:
        out = IGNORED + self.ignore
        for name in IGNORE_FILES:
            path = f"{self.root}/{name}"
            if self.store.files.exists(path):
                out = out + self.store.files.read(path).splitlines()
        return out

    def scan(self) -> DataFrame:
        return scan.tree(self.spark, self.root, self.rules(), project_root=self.project)

    def chunks(self) -> DataFrame:
        return self.store.read().where(F.col("project_root") == self.project)

    # ---- indexing

    def dry_run(self, export: exports.Export | None = None) -> dict:
        files = self._structured(scan.indexable(self.scan()), export)
        return stats.dry_run(files.select("relative_path", "file_hash", "file_size"), stats.file_hashes(self.chunks())).first().asDict()

    def index(self, paths: Sequence[str] = (), full: bool = False, symbols: DataFrame | None = None, structure: str = "auto", export: str | None = None) -> dict:
        """Bring the index up to date: chunk and embed what changed, drop what is gone (only if no
        paths are named, as a scan of some paths says nothing about the others).

        ``export``: a folder with another tool's symbols (see ``sources.exports``) to cut files along, or ``symbols``,
        its records. With ``structure="auto"`` files whose text they no longer fit, or all if the export is unfit, are
        cut as if there were none; with ``"required"`` that is an error before anything changes; ``"off"`` leaves
        symbols aside. A file whose symbols change is cut again, be its text the same.

        Vectors of texts that the index has are used again, unless ``full``. Files whose texts could not
        all be embedded are left out, counted as ``failed_files``, and keep the receipt incomplete. The tree is
        read once and chunked once; the receipt holds the digest of what was read. An attempt that breaks off
        leaves a receipt that says so, and what succeeded last."""
        mode = structural.parse_mode(structure)
        if not full:
            self.store.check_profile(self.profile)
        attempt = self.store.begin_receipt(self.project, mode)
        code = "run"
        try:
            try:
                source, notes = self._symbols(mode, symbols, export)
            except exports.ExportError:
                code = "producer_error"
                raise
            try:
                return self._indexed(attempt, mode, list(paths), full, source, notes)
            except PreflightError:
                code = "preflight"
                raise
        except SupersededError:
            raise
        except Exception:
            self.store.fail_receipt(self.project, attempt, code)
            raise

    def _symbols(self, mode: str, symbols: DataFrame | None, export: str | None) -> tuple[exports.Export | None, list[dict]]:
        """The symbols to cut along, and what is wrong with them."""
        if mode == "off":
            return None, []
        if symbols is not None:
            known = symbols if "source_hash" in symbols.columns else symbols.withColumn("source_hash", F.lit(None).cast("string"))
            return exports.Export(known, structural.profiles(known.where("source_hash is not null")), self.spark.createDataFrame([], "relative_path string, issue string")), []
        try:
            if export is None:
                if mode == "required":
                    raise exports.ExportError("structure is required, and there is no export")
                return None, []
            source = exports.load(self.spark, export, exports.project_key(self.spark, self.project))
        except exports.ExportError:
            if mode == "required":
                raise
            return None, [receipts.fallback("producer_error")]
        bad = source.issues.select("relative_path").distinct().count()
        if bad and mode == "required":
            raise exports.ExportError(f"{bad} files have records that cannot be used: {source.issues.orderBy('relative_path').first().asDict()}")
        return source, [receipts.fallback("partial_export", bad)] if bad else []

    def _structured(self, files: DataFrame, source: exports.Export | None) -> DataFrame:
        return files if source is None else freshness.structural_hashes(files, source.profiles)

    def _indexed(self, attempt: str, mode: str, paths: list[str], full: bool, source: exports.Export | None, notes: list[dict]) -> dict:
        whole, counts = not paths, {}
        known = stats.file_hashes(self.chunks())
        with self.store.staged(freshness.feed(self._structured(scan.indexable(self.scan()), source), known, paths, full)) as files:
            if mode == "required":
                self._preflight(files, paths, source)

            def change() -> None:
                todo = files.where("wanted").drop("wanted")
                counts.update(freshness.feed_digest(files).select("digest").first().asDict())
                gone = freshness.to_prune(known, files, scan_complete=whole)
                with self.store.staged(self._cut(todo, None if source is None else source.symbols)) as made, self.store.staged(gone) as pruned:
                    before = self.store.state["generation"]
                    with self._embedded(made, full) as rows:
                        self.store.replace_files(rows, self.project, pruned)
                    asked = made.select("relative_path", "file_hash").distinct()
                    failed = asked.join(self.chunks().select("relative_path", "file_hash"), ["relative_path", "file_hash"], "left_anti").count()
                    origins = {r["origin"]: r for r in stats.origin_counts(made).collect()}
                    counts.update(generation=self.store.state["generation"], previous=before, failed_files=failed, deleted_files=pruned.count(), origins=origins)

            self.store.guarded(self.project, change, full=full)
        self.store.save_profile(self.profile)
        origins = counts.pop("origins")
        made = {"chunks": {k: r["chunks"] for k, r in origins.items()}, "files": {k: r["files"] for k, r in origins.items()}}
        fits = 0 if source is None else source.profiles.count()
        if source is not None and made["files"].get("local"):
            notes = [*notes, receipts.fallback("local_chunks", made["files"]["local"])]
        notes = [*notes, *([] if whole else [receipts.fallback("partial_scope")]), *([receipts.fallback("failed_files", counts["failed_files"])] if counts["failed_files"] else [])]
        row = stats.index_stats(self.chunks()).first().asDict()
        complete = whole and not counts["failed_files"]
        effective = receipts.effective_mode(mode, source is not None, any(n["code"] == "producer_error" for n in notes), made["chunks"], fits)
        producer = {"producer_project_key": source.project_key, "fingerprint": source.fingerprint} if whole and source is not None and source.fingerprint else {}
        self.store.record_receipt(
            self.project, attempt, scope_complete=whole, effective_mode=effective, counts=made, fallbacks=notes, error_count=counts["failed_files"],
            ingestion_complete=complete, failed_files=counts["failed_files"], digest=counts["digest"], chunks=row["chunks"], files=row["files"], **producer)
        if complete:
            facts = stats.health(self.chunks().groupBy("relative_path").agg(F.max("file_size").alias("file_size"), F.max("indexed_at").alias("indexed_at"))).first()
            self.store.write_manifest(self.project, attempt, files=row["files"], chunks=row["chunks"], indexed_bytes=facts["total_size"] or 0, digest=counts["digest"])
        self.store.finish_receipt(self.project, attempt, complete=complete)
        return row | counts | {"effective_mode": effective}

    def _preflight(self, files: DataFrame, paths: list[str], source: exports.Export) -> None:
        """Files that the export speaks of (among ``paths``, not ignored) must be there as it has them."""
        wanted = source.profiles.where(freshness.under(F.col("relative_path"), paths) & ~scan.ignored(F.col("relative_path"), self.rules()))
        missing = freshness.missing_structural(files, wanted).orderBy("relative_path").first()
        if missing:
            raise PreflightError(f"{missing['relative_path']} is gone or has changed since it was exported")

    @contextmanager
    def _embedded(self, made: DataFrame, full: bool = False) -> Iterator[DataFrame]:
        """Chunks with vectors: of texts that the store has or the cache holds, unless ``full``, and new ones,
        which are embedded once and go to the cache."""
        known = None
        if not full:
            known = embedding.stored_vectors(self.chunks(), self.embedder.model)
            if self.cache is not None:
                known = known.unionByName(self.cache.entries().select("cache_key", "embedding")).dropDuplicates(["cache_key"])
        with ExitStack() as stack:
            rows, new = embedding.embedded_chunks(made, self.embedder, known, lambda df: stack.enter_context(self.store.staged(df)))
            if self.cache is not None:
                self.cache.add(new.where("error is null"))
            yield rows.withColumn("indexed_at", F.current_timestamp())

    def _cut(self, files: DataFrame, symbols: DataFrame | None) -> DataFrame:
        """Chunks of files, along exported symbols where there are some that fit the file as it is."""
        if symbols is None:
            return chunking.chunk_files(files, self.options)
        fits = symbols.select("relative_path", F.col("source_hash").alias("__h")).distinct()
        meets = (files["relative_path"] == fits["relative_path"]) & (F.col("__h").isNull() | (F.col("__h") == files["source_hash"]))
        apart = files.join(fits, meets, "left_anti")
        along = structural.chunk_structurally(files.join(fits, meets, "left_semi"), symbols)
        return chunking.chunk_files(apart, self.options).unionByName(along, allowMissingColumns=True)

    def ensure(self, mode: str = "check") -> freshness.Readiness:
        """The state of the index; ``index_if_empty`` indexes an empty one, ``force_rebuild`` any."""
        if mode not in ("check", "index_if_empty", "force_rebuild"):
            raise ValueError(f"unknown mode {mode!r}")
        ready = self.readiness()
        if mode == "force_rebuild" or mode == "index_if_empty" and ready.state == "empty":
            self.index(full=mode == "force_rebuild")
            ready = self.readiness()
        return ready

    def delete(self, path: str) -> int:
        n = self.store.delete_file(self.project, path)
        self.store.invalidate(self.project)
        return n

    def watch(self, events: DataFrame, checkpoint: str, tick: str | None = watching.TICK) -> StreamingQuery:
        """Follow a stream of events (path, op, ts); paths are relative to the root. A batch reads its own
        files only. The store's ledger knows the last batch that a stream (named by its checkpoint) has
        applied, so one that comes again changes nothing. Changed files that can no longer be indexed go;
        files that cannot be embedded keep their old chunks and leave the index stale."""
        def apply(changed: DataFrame, removed: DataFrame, batch_id: int) -> None:
            paths = [r[0] for r in changed.limit(watching.LISTED + 1).collect()]
            if len(paths) <= watching.LISTED:
                found = scan.some(self.spark, self.root, paths, self.rules(), project_root=self.project)
            else:
                found = self.scan().join(changed.withColumnRenamed("path", "relative_path"), "relative_path", "left_semi")
            with self.store.staged(scan.indexable(found)) as files, self.store.staged(chunking.chunk_files(files, self.options)) as made:
                unfit = changed.withColumnRenamed("path", "relative_path").join(files.select("relative_path"), "relative_path", "left_anti")
                gone = removed.withColumnRenamed("path", "relative_path").unionByName(unfit)
                with self._embedded(made) as rows:
                    if self.store.replace_files(rows, self.project, gone, batch=(checkpoint, batch_id)):
                        self.store.invalidate(self.project)

        return watching.watch(events, apply, checkpoint, self.ignore, tick)

    # ---- state

    def pending(self) -> dict:
        hashes = stats.source_hashes(self.chunks())
        row = freshness.pending(scan.raw_hashes(self.scan()), hashes.select("relative_path", F.coalesce("source_hash", F.lit("")).alias("source_hash"))).first().asDict()
        return row | {"complete": hashes.where("not complete").isEmpty()}

    def readiness(self) -> freshness.Readiness:
        indexed = not self.chunks().isEmpty()
        stored = self.store.state["profile"]
        pending = self.pending() if indexed else {"total_pending": 0, "complete": True}
        state = "unknown" if not pending["complete"] or not self.store.proven(self.project) else None
        return freshness.readiness_of(indexed, pending["total_pending"] == 0, stored == self.profile, state)

    def quick_status(self, producer: dict | None = None) -> dict:
        """The state from the manifest, the receipt and one look at the files: ``fresh``, ``stale`` or ``unknown``,
        and why. Chunks are read (their hashes only) only to count what has changed. ``producer``: the
        exporting tool's own manifest, which an index along its symbols needs to be called fresh."""
        stored = self.store.state["profile"]
        out = {"state": "unknown", "reason": "", "files": 0, "chunks": 0, "indexed_bytes": 0, "profile_matches": stored == self.profile, "pending": None}
        try:
            manifest = self.store.manifest(self.project)
        except receipts.InvalidProof:
            return out | {"reason": "manifest_invalid"}
        if manifest is None:
            return out | {"reason": "manifest_missing"}
        out |= manifest["stats"] | {"indexed_bytes": manifest["indexed_bytes"]}
        try:
            receipt = self.store.receipt(self.project)
        except receipts.InvalidProof:
            return out | {"reason": "receipt_invalid"}
        if not receipts.succeeded(receipt):
            return out | {"reason": "receipt_incomplete"}
        if manifest["attempt"] != receipt["attempt"]:
            return out | {"reason": "manifest_of_another_attempt"}
        now = freshness.feed_digest(scan.raw_hashes(self.scan())).first()["digest"]
        if now != manifest["digest"]:
            return out | {"state": "stale", "reason": "files_changed", "pending": self.pending()}
        return out | dict(zip(("state", "reason"), self._producer_state(receipt, producer), strict=True))

    def _producer_state(self, receipt: dict, producer: dict | None) -> tuple[str, str]:
        if not receipts.uses_structure(receipt):
            return "fresh", "fresh"
        if producer is None:
            return "unknown", "producer_unavailable"
        try:
            fresh = receipts.check_producer(producer, receipt.get("producer_project_key", ""), receipt.get("fingerprint", ""))
        except receipts.Mismatch:
            return "unknown", "producer_mismatch"
        except receipts.InvalidProof:
            return "unknown", "producer_invalid"
        return ("fresh", "fresh") if fresh else ("stale", "producer_stale")

    def stats(self) -> dict:
        return stats.index_stats(self.chunks()).first().asDict() | {k: {r[0]: r["n"] for r in stats.histogram(self.chunks(), k).collect()} for k in ("language", "chunk_type")}

    def status(self) -> dict:
        ready = self.readiness()
        return self.stats() | self.pending() | {"state": ready.state, "action": ready.action, "profile": self.store.state["profile"]}

    def overview(self) -> dict:
        files = self.chunks().select("relative_path").distinct()
        return self.stats() | {
            "entry_points": [r[0] for r in graph.entry_points(files).collect()], "key_files": [r[0] for r in graph.key_files(files).collect()],
            "tree": [r.asDict() for r in graph.directory_tree(files).collect()]}

    # ---- questions

    def _own(self, o: SearchOptions) -> SearchOptions:
        """The options, bound to this project; statistics are those of the whole store."""
        return replace(o, filters=replace(o.filters, project_root=o.filters.project_root or self.project))

    def train_cells(self, n_cells: int | None = None) -> dict:
        """Have searches by vector read the nearest cells only (see ``operators.cells``); exact until then."""
        return self.store.train_cells(n_cells)

    def _ready(self, mode: str) -> None:
        if mode != "keyword":
            self.store.check_profile(self.profile)

    def search(self, query: str, o: SearchOptions | None = None) -> tuple[DataFrame, list[str]]:
        o = self._own(o or SearchOptions())
        self._ready(o.mode)
        return search.search(self.store.read(), query, o, self.embedder.embed_query, self.store)

    def explain(self, query: str, o: SearchOptions | None = None) -> dict:
        return search.explain(self.store.read(), query, self._own(o or SearchOptions()), self.embedder.embed_query, self.store)

    def similar(self, target: str = "", text: str = "", limit: int = DEFAULT_LIMIT, **options) -> DataFrame:
        self._ready("semantic")
        at = parse_target(target, text)
        rows = self.chunks()
        if "text" in at:
            hits = search.similar_by_vector(rows, self.embedder.embed_query(text), limit)
        elif "chunk_id" in at:
            hits = search.similar_by_id(rows, at["chunk_id"], limit, **options)
        else:
            hits = search.similar_by_location(rows, at["path"], at["line"], limit, **options)
        return search.results(hits, rows)

    def batch_search(self, queries: Sequence[str], o: SearchOptions | None = None, dedup: bool = True) -> DataFrame:
        self._ready("hybrid")
        o = o or SearchOptions(limit=BATCH_LIMIT)
        return search.batch(self.store.read(), [(q, self.embedder.embed_query(q)) for q in queries], self._own(o), dedup, self.store)

    def investigate(self, query: str, affected: DataFrame, o: SearchOptions | None = None) -> DataFrame:
        """Search among the files that a symbol's change affects."""
        o = o or SearchOptions()
        rows = graph.in_scope(self.chunks(), affected)
        return search.search(rows, query, o, self.embedder.embed_query)[0]

    def related_files(self, path: str, graph_answer: DataFrame | None = None) -> DataFrame:
        files = scan.indexable(self.scan()).select("relative_path", "content")
        return graph.related_files(files, path, graph_answer)

    def context(self, hits: DataFrame, lines: int) -> DataFrame:
        """Hits with so many lines around them from the files as they are; the hit's own content where
        a file cannot be read."""
        from .functions.text import lines_between

        files = scan.indexable(self.scan()).select("relative_path", F.col("content").alias("__text"))
        wide = F.coalesce(lines_between(F.col("__text"), F.col("start_line") - lines, F.col("end_line") + lines), F.col("content"))
        return hits.join(files, "relative_path", "left").withColumn("content", wide).drop("__text")

    def evaluate(self, documents: DataFrame, queries: DataFrame, relevant: DataFrame) -> dict:
        """Metrics of the embedder on an evaluation set (ids and texts; query_id, doc_id)."""
        if not (bad := evaluate.problems(documents, queries, relevant)).isEmpty():
            raise ValueError(f"unfit evaluation set: {bad.first().asDict()}")
        vectors = {}
        for name, df in (("doc_id", documents), ("query_id", queries)):
            made = embedding.embed(df.select("text"), self.embedder).select("cache_key", "embedding")
            vectors[name] = embedding.keyed(df, self.embedder.model).join(made, "cache_key")
        number = {n: df.select(F.xxhash64("id").alias(n), F.col("id").alias(f"{n}_text"), "embedding") for n, df in vectors.items()}
        pairs = relevant.select(F.xxhash64("query_id").alias("query_id"), F.xxhash64("doc_id").alias("doc_id"))
        ranked = evaluate.ranked(number["query_id"], number["doc_id"], evaluate.DEPTH)
        return evaluate.summary(evaluate.per_query(ranked, pairs)).first().asDict()


def rendered(hits: list[dict], form: str = "default") -> str:
    """Results for people, as JSON, or one line each."""
    if form == "json":
        return json.dumps(hits, ensure_ascii=False, default=str)
    place = lambda h: f"{h['relative_path']}:{h['start_line']}-{h['end_line']}"
    if form == "compact":
        return "\n".join(f"{place(h)}\t{h['score']:.4f}\t{h.get('symbol_name') or ''}" for h in hits)
    return "\n\n".join(f"{i}. {place(h)} ({h['language']}, {h['chunk_type']}) {h['score']:.4f}\n{h['content']}" for i, h in enumerate(hits, 1)) or "no results"


def with_limit(o: SearchOptions, limit: int) -> SearchOptions:
    return replace(o, limit=limit)
