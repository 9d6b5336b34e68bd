"""Small functions for the driver: hashes, human-readable sizes, notes, configuration values."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any


def fnv1a32(text: str) -> str:
    """32-bit FNV-1a of a text's bytes, in hex."""
    h = 0x811C9DC5
    for b in text.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return f"{h:x}"


def human_bytes(n: int) -> str:
    size, units = float(n), ["B", "KB", "MB", "GB", "TB", "PB"]
    while size >= 1024 and len(units) > 1:
        size, units = size / 1024, units[1:]
    return f"{int(size)} B" if units[0] == "B" else f"{size:.1f} {units[0]}"


def human_duration(seconds: float) -> str:
    s = max(0, int(seconds))
    if s < 60:
        return f"{s}s"
    return f"{s // 60}m{s % 60:02d}s" if s < 3600 else f"{s // 3600}h{s % 3600 // 60:02d}m"


def short_note(text: str, limit: int = 120) -> str:
    """A text of at most ``limit`` bytes, with dots where it was cut."""
    raw = text.encode()
    return text if len(raw) <= limit else raw[:limit - 3].decode("utf-8", "ignore") + "..."


# ---- configuration


@dataclass(frozen=True)
class Setting:
    kind: type
    default: Any
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


SETTINGS: dict[str, Setting] = {
    "embedding.model": Setting(str, "hashing-768"), "embedding.dimensions": Setting(int, 768, 1, 65_536), "embedding.cache_ttl_seconds": Setting(int, 0, 0),
    "indexing.chunk_size": Setting(int, 2048, 1), "indexing.chunk_overlap": Setting(int, 256, 0), "indexing.max_file_bytes": Setting(int, 1 << 20, 1),
    "search.mode": Setting(str, "hybrid", choices=("semantic", "keyword", "hybrid")), "search.vector_weight": Setting(float, 0.7, 0, 1), "search.limit": Setting(int, 10, 1),
    "search.min_score": Setting(float, 0.0, 0, 1), "memory.half_life_hours": Setting(float, 720.0, 0), "memory.importance_boost": Setting(float, 0.25, 0), "watch.enabled": Setting(bool, False),
}


def config_value(key: str, text: str) -> Any:
    """A typed text as the value of a setting; unknown keys and values out of range are errors."""
    if key not in SETTINGS:
        raise KeyError(key)
    s = SETTINGS[key]
    if s.kind is bool:
        if text.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"{key}: not a truth value: {text!r}")
        return text.lower() in ("true", "1", "yes")
    value = s.kind(text)
    if s.low is not None and value < s.low or s.high is not None and value > s.high:
        raise ValueError(f"{key}: out of range: {value}")
    if s.choices and value not in s.choices:
        raise ValueError(f"{key}: not one of {', '.join(s.choices)}")
    return value


def resolved_config(files: list[str], env: Mapping[str, str] | None = None, prefix: str = "LODESTRATA_") -> dict[str, Any]:
    """All settings: the environment before files (JSON, the first before the later ones), before
    defaults."""
    env = os.environ if env is None else env
    out = {k: s.default for k, s in SETTINGS.items()}
    for path in reversed(files):
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                out.update({k: config_value(k, str(v)) for k, v in json.load(f).items()})
    for k in SETTINGS:
        name = prefix + k.upper().replace(".", "_")
        if name in env:
            out[k] = config_value(k, env[name])
    return out


def project_names(paths: list[str]) -> dict[str, str]:
    """A name for each project: its folder's, led by as many parents as it takes to be the only one."""
    parts = {p: p.strip("/").split("/") for p in paths}
    out = {}
    for p, own in parts.items():
        n = 1
        while n < len(own) and sum(other[-n:] == own[-n:] for other in parts.values()) > 1:
            n += 1
        out[p] = "/".join(own[-n:])
    return out
