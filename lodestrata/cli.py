"""Command line: ``python -m lodestrata.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import functions as F

from .engine import Engine, rendered
from .options import RECALL_LIMIT, FilterOptions, SearchOptions, parse_line_range, resolve_mode
from .sources.projects import Registry


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrata")
    p.add_argument("--root", default=".", help="file tree")
    p.add_argument("--data", required=True, help="folder of the store")
    p.add_argument("--home", help="folder of the registry of projects")
    p.add_argument("--format", choices=["default", "json", "compact"], default="default")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index")
    c.add_argument("paths", nargs="*")
    c.add_argument("--full", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--structure", default="auto", help="auto, off or required")
    c.add_argument("--export", help="folder with another tool's symbols")
    c = sub.add_parser("projects")
    c.add_argument("action", choices=["list", "add", "find", "prune"])
    c.add_argument("--name", default="")
    c.add_argument("--store", default="", help="folder of the project's data")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--purge", action="store_true", help="delete managed data of projects that are gone")
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("--mode", default="hybrid")
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--min-score", type=float, default=0.0)
    c.add_argument("--lang", action="append", default=[])
    c.add_argument("--type", action="append", default=[])
    c.add_argument("--file", default="")
    c.add_argument("--dir", default="")
    c.add_argument("--lines", default="")
    c.add_argument("--explain", action="store_true")
    c = sub.add_parser("similar")
    c.add_argument("target", nargs="?", default="")
    c.add_argument("--text", default="")
    c.add_argument("--limit", type=int, default=10)
    c = sub.add_parser("batch-search")
    c.add_argument("queries", nargs="+")
    c = sub.add_parser("related-files")
    c.add_argument("path")
    c = sub.add_parser("delete")
    c.add_argument("path")
    c = sub.add_parser("reset")
    c.add_argument("--confirm", default="")
    c = sub.add_parser("memory").add_subparsers(dest="action", required=True)
    m = c.add_parser("remember")
    m.add_argument("content")
    m.add_argument("--importance", type=float, default=0.0)
    m.add_argument("--tags", default="", help="comma-separated")
    m.add_argument("--ttl-hours", type=float, default=0.0)
    m = c.add_parser("recall")
    m.add_argument("query")
    m.add_argument("--limit", type=int, default=RECALL_LIMIT)
    m.add_argument("--tags", default="")
    m.add_argument("--min-importance", type=float, default=0.0)
    m = c.add_parser("forget")
    m.add_argument("--id", type=int)
    m.add_argument("--tags", default="")
    m.add_argument("--older-than-hours", type=float)
    m.add_argument("--expired", action="store_true")
    m.add_argument("--confirm", default="")
    c.add_parser("stats")
    for name in ("clean", "overview"):
        sub.add_parser(name)
    c = sub.add_parser("status")
    c.add_argument("--quick", action="store_true", help="from the manifest and one look at the files")
    c = sub.add_parser("branch")
    c.add_argument("action", choices=["snapshot", "switch"])
    c.add_argument("name")
    return p


def remembered(e: Engine, a: argparse.Namespace) -> dict | list:
    """What a memory command answers."""
    tags = [t.strip() for t in getattr(a, "tags", "").split(",") if t.strip()]
    if a.action == "remember":
        return {"id": e.memories.remember(a.content, importance=a.importance, tags=tags, ttl_hours=a.ttl_hours)}
    if a.action == "recall":
        return [r.asDict() for r in e.memories.recall(a.query, limit=a.limit, tags=tags, min_importance=a.min_importance).collect()]
    if a.action == "stats":
        return e.memories.stats()
    if a.expired:
        return {"forgotten": e.memories.forget_expired()}
    if a.id is None and not tags and a.older_than_hours is None:
        raise ValueError("forget needs --id, --tags, --older-than-hours or --expired")
    before = F.current_timestamp() - F.make_dt_interval(hours=F.lit(int(a.older_than_hours))) if a.older_than_hours is not None else None
    return {"forgotten": e.memories.forget(id=a.id, tags=tags, older_than=before, confirm=a.confirm)}


def registered(r: Registry, a: argparse.Namespace) -> dict | list:
    """What a command on the registry answers."""
    if a.action == "add":
        return asdict(r.add(a.root, a.store, a.name))
    if a.action == "find":
        return {"root": r.find(a.root)}
    return [asdict(p) for p in (r.projects() if a.action == "list" else r.prune(a.dry_run, a.purge))]


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    say = lambda x: print(json.dumps(x, default=str, sort_keys=True))
    if a.command == "projects":  # needs no Spark
        say(registered(Registry(a.home), a))
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lodestrata").getOrCreate()
    e = Engine(spark, a.root, a.data)
    if a.command == "index":
        say(e.dry_run() if a.dry_run else e.index(a.paths, a.full, structure=a.structure, export=a.export))
    elif a.command == "search":
        low, high = parse_line_range(a.lines)
        f = FilterOptions(languages=tuple(a.lang), chunk_types=tuple(a.type), file_glob=a.file, directory=a.dir, min_line=low, max_line=high)
        o = SearchOptions(resolve_mode(a.mode), a.limit, a.min_score, filters=f)
        if a.explain:
            say(e.explain(a.query, o))
        else:
            hits, warnings = e.search(a.query, o)
            print(rendered([r.asDict() for r in hits.collect()], a.format))
            for w in warnings:
                print(w, file=sys.stderr)
    elif a.command == "similar":
        print(rendered([r.asDict() for r in e.similar(a.target, a.text, a.limit).collect()], a.format))
    elif a.command in ("batch-search", "related-files"):
        found = e.batch_search(a.queries) if a.command == "batch-search" else e.related_files(a.path)
        say([r.asDict() for r in found.collect()])
    elif a.command == "memory":
        say(remembered(e, a))
    elif a.command == "delete":
        say({"deleted": e.delete(a.path)})
    elif a.command == "reset":
        e.store.reset(e.project, a.confirm)
    elif a.command == "branch":
        say({"ok": e.store.snapshot(a.name) or True if a.action == "snapshot" else e.store.switch(a.name, e.profile)})
    else:
        say({"status": e.quick_status if getattr(a, "quick", False) else e.status, "clean": e.store.clean, "overview": e.overview}[a.command]())
    return 0


if __name__ == "__main__":
    sys.exit(main())
