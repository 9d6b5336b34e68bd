"""Options of searches, with their defaults and the parsing of what users type."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

DEFAULT_LIMIT, BATCH_LIMIT, RELATED_LIMIT, RECALL_LIMIT = 10, 3, 10, 10
DEFAULT_VECTOR_WEIGHT = 0.7


@dataclass(frozen=True)
class FilterOptions:
    """Conditions on chunks, all of which must hold. Empty or zero means no condition."""

    project_root: str = ""
    language: str = ""
    languages: tuple[str, ...] = ()
    chunk_type: str = ""
    chunk_types: tuple[str, ...] = ()
    file_glob: str = ""
    directory: str = ""
    files: tuple[str, ...] = ()
    min_line: int = 0
    max_line: int = 0


@dataclass(frozen=True)
class SearchOptions:
    """One search. ``vector_weight`` None is the default of 0.7; zero is pure text."""

    mode: str = "hybrid"
    limit: int = DEFAULT_LIMIT
    min_score: float = 0.0
    vector_weight: float | None = None
    text_weight: float = 0.0
    filters: FilterOptions = field(default_factory=FilterOptions)

    @property
    def top(self) -> int:
        return self.limit if self.limit > 0 else DEFAULT_LIMIT

    @property
    def weights(self) -> tuple[float, float]:
        return fusion_weights(DEFAULT_VECTOR_WEIGHT if self.vector_weight is None else self.vector_weight, self.text_weight)


def resolve_mode(text: str) -> str:
    """A mode by name; anything unknown is hybrid."""
    return text.lower() if text.lower() in ("semantic", "keyword") else "hybrid"


def fusion_weights(vector: float, text: float = 0.0) -> tuple[float, float]:
    """Weights that add up to one: the vector's is clamped, a missing text weight is the rest."""
    vector = min(max(vector, 0.0), 1.0)
    text = text if text > 0 else 1 - vector
    total = vector + text
    return (vector / total, text / total) if abs(total - 1) > 1e-3 else (vector, text)


def fetch_size(limit: int) -> int:
    """How many hits each ranker of a hybrid search contributes."""
    return max(3 * limit, 30)


def parse_line_range(text: str) -> tuple[int, int]:
    """``a-b``; anything else is no range, a part that is not a number is 0."""
    parts = text.split("-")
    if len(parts) != 2:
        return 0, 0
    return tuple(int(p) if re.fullmatch(r"\s*\d+\s*", p) else 0 for p in parts)  # type: ignore[return-value]


def parse_target(target: str, text: str = "") -> dict:
    """What *similar* starts from: a chunk id, ``file:line``, or a text, exactly one of them."""
    if bool(target) == bool(text):
        raise ValueError("give either a target or a text")
    if text:
        return {"text": text}
    if target.isdigit():
        return {"chunk_id": int(target)}
    path, colon, line = target.rpartition(":")
    if colon and path and line.isdigit():
        return {"path": path, "line": int(line)}
    raise ValueError(f"neither a chunk id nor file:line: {target!r}")
