"""What an attempt to index proves: receipts in two phases, and the manifest that goes with a whole one.

A receipt begins by taking back the proof of the attempt before it, records what was ingested, and is finished
(or failed) when the store and the profile are written. A manifest holds the sizes and the digest of what a
whole run has read, so that a status needs neither chunks nor vectors; it counts only with the finished
receipt of the same attempt. Both are plain dictionaries in the store's pointer.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import UTC, datetime

from ..operators.structural import parse_mode

RECEIPT_VERSION = MANIFEST_VERSION = 1
MOST_FALLBACKS, CODE_CHARACTERS, REASON_CHARACTERS = 16, 64, 256
EFFECTIVE = ("off", "local", "local_fallback", "structural", "mixed", "unavailable")

#: Why an attempt is less than was asked for.
REASONS = {
    "producer_error": "the export could not be used and files were cut without it",
    "partial_export": "some files were cut without the export's records",
    "local_chunks": "files without usable records were cut without them",
    "partial_scope": "an attempt over some paths cannot certify the project",
    "failed_files": "texts of some files could not be embedded",
    "preflight": "files that the export requires are gone or have changed",
    "run": "the attempt broke off",
}


class InvalidProof(ValueError):
    """A receipt or a manifest that says what cannot be."""


def now() -> str:
    return datetime.now(UTC).isoformat()


def begun(project: str, attempt: str, mode: str, before: Mapping) -> dict:
    return {
        "schema_version": RECEIPT_VERSION, "project": project, "attempt": attempt, "requested_mode": mode, "effective_mode": "unavailable", "scope_complete": False,
        "counts": {}, "fallbacks": [], "error_count": 0, "last_attempt_at": now(), "ingestion_complete": False, "success": False, "complete": False,
        **{k: before[k] for k in ("last_success", "last_success_at") if before.get(k)}}


def effective_mode(requested: str, loaded: bool, warned: bool, chunks: Mapping[str, int], structural_files: int) -> str:
    """How files were cut, whatever was asked for. A run that wrote nothing leaves an index that is
    structural as it is."""
    if requested == "off":
        return "off"
    if not loaded:
        return "local_fallback" if warned else "local"
    along, apart = chunks.get("structural", 0) + chunks.get("gap", 0), chunks.get("local", 0)
    if along:
        return "mixed" if apart else "structural"
    return "structural" if structural_files and not apart else "local"


def fallback(code: str, count: int = 0) -> dict:
    return {"code": code, "reason": REASONS[code], "count": count}


def check_receipt(receipt: Mapping, project: str) -> None:
    """Raise ``InvalidProof`` unless a receipt is one of this project that can be."""
    def need(holds: bool, what: str) -> None:
        if not holds:
            raise InvalidProof(f"receipt: {what}")

    need(receipt.get("schema_version") == RECEIPT_VERSION, "unknown version")
    need(receipt.get("project") == project, "of another project")
    need(_attempt(receipt.get("attempt")), "bad attempt")
    try:
        parse_mode(receipt.get("requested_mode") or "")
    except ValueError as e:
        raise InvalidProof(f"receipt: {e}") from e
    need(receipt.get("effective_mode") in EFFECTIVE, "unknown effective mode")
    need(bool(receipt.get("last_attempt_at")), "no time")
    need(receipt.get("error_count", 0) >= 0 and all(n >= 0 for group in receipt.get("counts", {}).values() for n in group.values()), "negative counts")
    notes = receipt.get("fallbacks", [])
    need(len(notes) <= MOST_FALLBACKS, "too many fallbacks")
    for f in notes:
        need(0 < len(f.get("code", "")) <= CODE_CHARACTERS and 0 < len(f.get("reason", "")) <= REASON_CHARACTERS and f.get("count", 0) >= 0, "bad fallback")
    need(receipt.get("scope_complete") or not (receipt.get("ingestion_complete") or receipt.get("complete") or receipt.get("success") and receipt.get("complete")), "part of a project cannot be complete")


def succeeded(receipt: Mapping | None) -> bool:
    """Whole, ingested, finished, and nothing attempted since."""
    r = receipt or {}
    return bool(r.get("success") and r.get("complete") and r.get("ingestion_complete") and r.get("attempt") == r.get("last_success"))


def uses_structure(receipt: Mapping) -> bool:
    return receipt.get("effective_mode") in ("structural", "mixed") or bool(receipt.get("fingerprint") or receipt.get("producer_project_key"))


def manifest(project: str, attempt: str, generation: int, files: int, chunks: int, indexed_bytes: int, digest: str) -> dict:
    return {
        "schema_version": MANIFEST_VERSION, "project": project, "attempt": attempt, "generation": generation, "stats": {"files": files, "chunks": chunks},
        "indexed_bytes": indexed_bytes, "digest": digest, "updated_at": now()}


def check_manifest(m: Mapping, project: str) -> None:
    def need(holds: bool, what: str) -> None:
        if not holds:
            raise InvalidProof(f"manifest: {what}")

    need(m.get("schema_version") == MANIFEST_VERSION, "unknown version")
    need(m.get("project") == project, "of another project")
    need(_attempt(m.get("attempt")), "bad attempt")
    need(bool(m.get("updated_at")), "no time")
    need(isinstance(m.get("indexed_bytes"), int) and m["indexed_bytes"] >= 0, "bad bytes")
    need(all(name and n >= 0 for name, n in m.get("stats", {}).items()), "bad counts")
    need(str(m.get("digest", "")).isdigit(), "no digest")


def _attempt(text: object) -> bool:
    return isinstance(text, str) and len(text) == 32 and set(text) <= set("0123456789abcdef")


# ---- the producer's own manifest

_NEEDED = ("schema_version", "export_schema_version", "project", "project_key", "index_fingerprint", "total_records", "complete", "freshness")
_FRESHNESS = ("checked", "fresh", "changed", "new", "deleted")


class Mismatch(InvalidProof):
    """A producer's manifest of another project or of another state of it."""


def check_producer(document: Mapping, project_key: str, fingerprint: str) -> bool:
    """Whether the producer says that its index is fresh. ``Mismatch``: it speaks of something else;
    ``InvalidProof``: fields are missing, or contradict each other."""
    missing = [k for k in _NEEDED if document.get(k) is None] or [f"freshness.{k}" for k in _FRESHNESS if document["freshness"].get(k) is None]
    if missing:
        raise InvalidProof(f"producer: no {missing[0]}")
    if (document["schema_version"], document["export_schema_version"]) != (1, 1) or not document["project"]:
        raise InvalidProof("producer: unknown version or project")
    if document["project_key"] != project_key or document["index_fingerprint"] != fingerprint:
        raise Mismatch("producer: of another index")
    state = document["freshness"]
    drift = [state[k] for k in ("changed", "new", "deleted")]
    if document["total_records"] < 0 or not document["complete"] or not state["checked"] or min(drift) < 0 or bool(state["fresh"]) == any(drift):
        raise InvalidProof("producer: incomplete or contradictory")
    return bool(state["fresh"])
