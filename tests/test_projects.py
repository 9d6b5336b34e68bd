"""Finding the project of a folder, and the registry."""

import json
import os

import pytest

from lodestrata import cli
from lodestrata.sources.projects import Registry


def test_nearest_project(tmp_path):
    home = tmp_path / "home"
    r = Registry(str(home / ".lodestrata"))
    deep = home / "a" / "b" / "c"
    deep.mkdir(parents=True)
    os.makedirs(r.home)
    assert r.find(str(deep)) is None  # the registry's own folder marks no project
    r.add(str(home / "a"))
    assert r.find(str(deep)) == str(home / "a") and r.find(str(home)) is None
    (home / "a" / "b" / ".config").mkdir()
    (home / "a" / "b" / ".config" / "lodestrata.json").write_text("{}")
    assert r.find(str(deep)) == str(home / "a" / "b")
    (deep / ".lodestrata").write_text("a file is no data folder")
    assert r.find(str(deep)) == str(home / "a" / "b")
    (deep / "lodestrata.json").mkdir()
    assert r.find(str(deep)) == str(home / "a" / "b")
    (deep / "x" / ".lodestrata").mkdir(parents=True)
    assert r.find(str(deep / "x")) == str(deep / "x")


def test_names_and_prune(tmp_path):
    r = Registry(str(tmp_path / "home"))
    for name in ("one/app", "two/app", "three"):
        (tmp_path / name).mkdir(parents=True)
    mine, other = os.path.join(r.managed, "x"), tmp_path / "elsewhere"
    for folder in (mine, other):
        os.makedirs(folder)
        with open(os.path.join(folder, "f"), "w") as f:
            f.write("12345")
    r.add(str(tmp_path / "one/app"), mine)
    r.add(str(tmp_path / "two/app"), str(other))
    r.add(str(tmp_path / "three"), r.managed)
    assert [p.name for p in r.projects()] == ["app", "three", "two/app"]
    with pytest.raises(ValueError):
        r.add(str(tmp_path / "elsewhere"), name="app")
    assert r.prune() == []
    for name in ("one/app", "two/app", "three"):
        (tmp_path / name).rmdir()
    dry = r.prune(dry_run=True, purge=True)
    assert [(p.name, p.bytes, p.purged) for p in dry] == [("app", 5, False), ("three", 0, False), ("two/app", 0, False)] and len(r.projects()) == 3
    done = r.prune(purge=True)
    assert [p.purged for p in done] == [True, False, False] and r.projects() == []
    assert not os.path.exists(mine) and (other / "f").exists() and os.path.isdir(r.managed)


def test_data_that_a_link_leads_out_of_stays(tmp_path):
    r = Registry(str(tmp_path / "home"))
    target = tmp_path / "target"
    target.mkdir()
    os.makedirs(r.managed)
    link = os.path.join(r.managed, "link")
    os.symlink(target, link)
    (tmp_path / "gone").mkdir()
    r.add(str(tmp_path / "gone"), link)
    (tmp_path / "gone").rmdir()
    assert not r.prune(purge=True)[0].purged and target.exists()


def test_projects_command(tmp_path, capsys):
    (tmp_path / "p").mkdir()
    at = ["--data", "unused", "--home", str(tmp_path / "home"), "--root", str(tmp_path / "p"), "projects"]
    assert cli.main([*at, "add"]) == 0 and json.loads(capsys.readouterr().out)["name"] == "p"
    cli.main([*at, "find"])
    assert json.loads(capsys.readouterr().out) == {"root": str(tmp_path / "p")}
    (tmp_path / "p").rmdir()
    cli.main([*at, "prune"])
    assert json.loads(capsys.readouterr().out)[0]["name"] == "p"
    cli.main([*at, "list"])
    assert json.loads(capsys.readouterr().out) == []
