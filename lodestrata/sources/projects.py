"""Which project a folder belongs to, and the registry of all of them: small files of the driver's own machine."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from dataclasses import asdict, dataclass

from ..functions.driver import project_names

DATA_DIR = ".lodestrata"
CONFIG_FILES = ("lodestrata.json", os.path.join(".config", "lodestrata.json"))


@dataclass(frozen=True)
class Project:
    name: str
    path: str
    data: str = ""


@dataclass(frozen=True)
class Pruned:
    name: str
    path: str
    data: str
    bytes: int
    purged: bool


class Registry:
    """Projects by name, in ``home/projects.json``. Data below ``home/projects`` is managed here."""

    def __init__(self, home: str | None = None):
        self.home = os.path.abspath(os.path.expanduser(home or os.path.join("~", DATA_DIR)))
        self.file, self.managed = os.path.join(self.home, "projects.json"), os.path.join(self.home, "projects")

    def projects(self) -> list[Project]:
        """By name."""
        if not os.path.exists(self.file):
            return []
        with open(self.file, encoding="utf-8") as f:
            return sorted((Project(**p) for p in json.load(f)), key=lambda p: p.name)

    def _save(self, projects: list[Project]) -> None:
        os.makedirs(self.home, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=self.home, delete=False, encoding="utf-8") as f:
            json.dump([asdict(p) for p in projects], f, indent=1)
        os.replace(f.name, self.file)

    def add(self, path: str, data: str = "", name: str = "") -> Project:
        """Register a folder, under its own name or one that sets it apart from the others. Again: its data folder is replaced."""
        path = os.path.realpath(os.path.expanduser(path))
        rest = [p for p in self.projects() if p.path != path]
        if name and any(p.name == name for p in rest):
            raise ValueError(f"there is another project {name!r}")
        taken = {p.name for p in rest}
        own = project_names([path, *[p.path for p in rest]])[path]
        project = Project(name or (own if own not in taken else path), path, data and os.path.abspath(os.path.expanduser(data)))
        self._save(sorted([*rest, project], key=lambda p: p.name))
        return project

    def by_path(self, path: str) -> Project | None:
        path = os.path.realpath(path)
        return next((p for p in self.projects() if p.path == path), None)

    def find(self, start: str) -> str | None:
        """The nearest folder from ``start`` upwards that has a configuration file or a data folder, or is
        registered. The registry's own folder marks no project."""
        folder = os.path.abspath(os.path.expanduser(start))
        while True:
            data = os.path.join(folder, DATA_DIR)
            if any(os.path.isfile(os.path.join(folder, c)) for c in CONFIG_FILES) or os.path.isdir(data) and os.path.realpath(data) != os.path.realpath(self.home) or self.by_path(folder):
                return folder
            up = os.path.dirname(folder)
            if up == folder:
                return None
            folder = up

    def prune(self, dry_run: bool = False, purge: bool = False) -> list[Pruned]:
        """Take out projects whose folder does not exist; one that cannot be looked at stays. ``purge`` deletes
        their data as well, if it is strictly inside the managed folder, wherever links lead."""
        gone, kept = [], []
        for p in self.projects():
            try:
                os.stat(p.path)
                kept.append(p)
                continue
            except FileNotFoundError:
                pass
            except OSError:
                kept.append(p)
                continue
            own = self._is_managed(p.data)
            size = _size(p.data) if own else 0
            purged = own and purge and not dry_run and os.path.isdir(p.data)
            if purged:
                shutil.rmtree(p.data)
            gone.append(Pruned(p.name, p.path, p.data, size, purged))
        if gone and not dry_run:
            self._save(kept)
        return gone

    def _is_managed(self, data: str) -> bool:
        if not data:
            return False
        base, real = os.path.realpath(self.managed), os.path.realpath(data)
        return real != base and os.path.commonpath([base, real]) == base and not os.path.islink(data)


def _size(folder: str) -> int:
    return sum(os.lstat(os.path.join(at, f)).st_size for at, _, files in os.walk(folder) for f in files)
