"""Symbol exports, structure modes, receipts, manifests and the status that follows from them."""

import copy
import hashlib
import json

import pytest

from lodestrata.engine import Engine, PreflightError
from lodestrata.operators import embedding, structural
from lodestrata.sources import exports, receipts

CODE = "package p\n\nfunc A() {\n}\n\nfunc B() {\n}\n"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exported(files, project_key, fingerprint="f" * 64, per_page=2):
    """Pages of an export: two functions of each file."""
    records = []
    for path, text in files.items():
        lines = text.splitlines(keepends=True)
        for name, a, b in (("A", 3, 4), ("B", 6, 7)):
            content = "".join(lines[a - 1:b])
            records.append(dict(
                schema_version=1, ordinal=len(records) + 1, project="p", project_key=project_key, index_fingerprint=fingerprint, file=path, start_line=a, end_line=b, symbol=name,
                fqn=f"p.{name}", kind="function", language="go", signature=f"func {name}()", docstring="", source_hash=sha(text), content=content, content_hash=sha(content),
                signature_truncated=False, docstring_truncated=False, content_truncated=False, content_omitted=False, omission_reason="", file_stale=False))
    pages = []
    for at in range(0, len(records), per_page):
        part = records[at:at + per_page]
        done = at + len(part) == len(records)
        pages.append(dict(schema_version=1, project="p", project_key=project_key, index_fingerprint=fingerprint, offset=at, limit=per_page, max_content_bytes=16384,
                          total_records=len(records), returned_records=len(part), complete=done, next_offset=0 if done else at + len(part), records=part))
    return pages


def written(folder, pages):
    folder.mkdir(parents=True)
    for i, page in enumerate(pages):
        (folder / f"page{i:03}.json").write_text(json.dumps(page))
    return str(folder)


@pytest.fixture
def project(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    files = {"a.go": CODE, "b.go": CODE.replace("package p", "package q")}
    for name, text in files.items():
        (root / name).write_text(text)
    e = Engine(spark, str(root), str(tmp_path / "store"), embedding.HashingEmbedder(16))
    return e, root, files, exports.project_key(spark, e.project)


FAULTS = {
    "unknown version": lambda p: p[0].update(schema_version=2),
    "wrong project": lambda p: [x.update(project_key="0" * 12) for x in p],
    "bad fingerprint": lambda p: [x.update(index_fingerprint="x") for x in p],
    "changes between pages": lambda p: p[1].update(total_records=9),
    "wrong count": lambda p: p[0].update(returned_records=1),
    "incomplete": lambda p: p.pop(),
    "does not begin at zero": lambda p: p.pop(0),
    "bad next offset": lambda p: p[0].update(next_offset=1),
    "missing fields": lambda p: p[0].update(project=None),
    "envelope differs": lambda p: p[1]["records"][0].update(index_fingerprint="0" * 64),
    "file outside the project": lambda p: p[1]["records"][0].update(file="../x.go"),
    "some records have no ordinal": lambda p: p[0]["records"][0].update(ordinal=None),
    "ordinals are not": lambda p: p[0]["records"][0].update(ordinal=2),
}


def test_export_faults(spark, tmp_path, project):
    _, _, files, key = project
    good = exported(files, key)
    whole = exports.load(spark, written(tmp_path / "good", good), key)
    assert whole.symbols.count() == 4 and whole.issues.count() == 0 and whole.profiles.count() == 2 and whole.fingerprint == "f" * 64
    for i, (what, spoil) in enumerate(FAULTS.items()):
        pages = copy.deepcopy(good)
        spoil(pages)
        with pytest.raises(exports.ExportError, match=what):
            exports.load(spark, written(tmp_path / f"bad{i}", pages), key)
    with pytest.raises(exports.ExportError, match="has over"):
        exports.load(spark, str(tmp_path / "good"), key, page_bytes=100)
    with pytest.raises(exports.ExportError, match="the export has over"):
        exports.load(spark, str(tmp_path / "good"), key, total_bytes=2000)
    with pytest.raises(exports.ExportError, match="no export"):
        exports.load(spark, str(tmp_path / "none"), key)


def test_bad_records_spoil_their_file_only(spark, tmp_path, project):
    _, _, files, key = project
    files = files | {"c.go": CODE + "//c\n", "d.go": CODE + "//d\n", "e.go": CODE + "//e\n"}
    pages = exported(files, key, per_page=10)
    r = pages[0]["records"]
    r[0]["content"] = "other"                                  # a.go
    r[3].update(start_line=3, end_line=4, symbol="A", fqn="p.A", content=r[2]["content"], content_hash=r[2]["content_hash"])  # b.go: twice
    r[5]["source_hash"] = "0" * 64                             # c.go: two states
    r[7].update(content="", content_truncated=True)            # d.go: cannot be checked, is used
    got = exports.load(spark, written(tmp_path / "x", pages), key)
    assert {x.relative_path: x.issue for x in got.issues.collect()} == {"a.go": "content hash differs", "b.go": "one symbol twice", "c.go": "exported in two states"}
    assert {x.relative_path: x.n_chunks for x in got.profiles.collect()} == {"d.go": 2, "e.go": 2}


def test_profile_follows_records(spark, tmp_path, project):
    _, _, files, key = project
    hashes = []
    for i, name in enumerate(("A", "A", "Z")):
        pages = exported(files, key)
        pages[0]["records"][0]["symbol"] = name
        got = exports.load(spark, written(tmp_path / f"p{i}", pages), key)
        hashes.append({r.relative_path: r.index_hash for r in got.profiles.collect()})
    assert hashes[0] == hashes[1] and hashes[0]["a.go"] != hashes[2]["a.go"] and hashes[0]["b.go"] == hashes[2]["b.go"]


def test_modes_preflight_and_status(spark, tmp_path, project):
    e, root, files, key = project
    path = written(tmp_path / "export", exported(files, key))
    assert e.quick_status()["reason"] == "manifest_missing"
    got = e.index(structure="required", export=path)
    assert got["effective_mode"] == "structural" and {r.symbol_name for r in e.chunks().where("symbol_name <> ''").collect()} == {"p.A", "p.B"}
    receipt = e.store.receipt(e.project)
    assert receipts.succeeded(receipt) and receipt["fingerprint"] == "f" * 64 and receipt["producer_project_key"] == key and receipt["counts"]["files"]["structural"] == 2
    # an index along symbols is fresh only if the producer says so
    says = dict(schema_version=1, export_schema_version=1, project="p", project_key=key, index_fingerprint="f" * 64, total_records=4, complete=True,
                freshness=dict(checked=True, fresh=True, changed=0, new=0, deleted=0))
    drift = says | {"freshness": dict(checked=True, fresh=False, changed=1, new=0, deleted=0)}
    for document, want in ((None, "producer_unavailable"), (says, "fresh"), (drift, "producer_stale"), (says | {"index_fingerprint": "0" * 64}, "producer_mismatch"), (says | {"complete": None}, "producer_invalid")):
        assert e.quick_status(document)["reason"] == want
    # a run that writes nothing leaves it structural, and a change of symbols alone has the file cut again
    before = e.store.state["live"]
    again = e.index(export=path)
    assert again["effective_mode"] == "structural" and e.store.state["live"] == before and e.dry_run(exports.load(spark, path, key))["modified_files"] == 0
    renamed = exported(files, key, "e" * 64)
    renamed[0]["records"][0].update(fqn="p.Renamed")
    e.index(export=written(tmp_path / "renamed", renamed))
    assert e.chunks().where("symbol_name = 'p.Renamed'").count() == 1
    # a file that changed since: an error before anything changes, or a local cut
    (root / "a.go").write_text(CODE + "\nfunc C() {\n}\n")
    state = e.store.state
    with pytest.raises(PreflightError, match="a.go"):
        e.index(structure="required", export=path)
    now = e.store.state
    assert now["segments"] == state["segments"] and not now["dirty"] and not e.store.proven(e.project) and e.quick_status()["reason"] == "receipt_incomplete"
    assert now["receipts"][e.project]["fallbacks"][-1]["code"] == "preflight" and now["receipts"][e.project]["last_success"] == state["receipts"][e.project]["last_success"]
    got = e.index(export=path)
    # b.go is as it was, so that run wrote none but local chunks; what it rests on is still an export
    assert got["effective_mode"] == "local" and receipts.uses_structure(e.store.receipt(e.project)) and [f["code"] for f in e.store.receipt(e.project)["fallbacks"]] == ["local_chunks"]


def test_fallbacks_and_scope(spark, tmp_path, project):
    e, root, files, key = project
    bad = exported(files, key)
    bad[0]["total_records"] = 99
    path = written(tmp_path / "bad", bad)
    with pytest.raises(exports.ExportError):
        e.index(structure="required", export=path)
    assert e.store.state["receipts"][e.project]["effective_mode"] == "unavailable" and e.chunks().isEmpty()
    with pytest.raises(exports.ExportError):
        e.index(structure="required")
    got = e.index(export=path)
    assert got["effective_mode"] == "local_fallback" and e.store.receipt(e.project)["fallbacks"][0]["code"] == "producer_error"
    status = e.quick_status()
    assert (status["state"], status["files"]) == ("fresh", 2) and status["indexed_bytes"] == sum(map(len, files.values()))
    (root / "c.go").write_text("package c\n")
    status = e.quick_status()
    assert (status["state"], status["reason"], status["pending"]["new_files"]) == ("stale", "files_changed", 1)
    e.index(["c.go"], structure="off")
    receipt = e.store.receipt(e.project)
    assert receipt["effective_mode"] == "off" and not receipt["complete"] and receipt["fallbacks"][-1]["code"] == "partial_scope" and e.quick_status()["state"] == "unknown"
    with pytest.raises(ValueError, match="unknown structure mode"):
        e.index(structure="sometimes")


def test_what_a_receipt_cannot_say():
    good = receipts.begun("p", "0" * 32, "auto", {})
    receipts.check_receipt(good, "p")
    for bad in (
            {"schema_version": 2}, {"project": "q"}, {"attempt": "x"}, {"requested_mode": "?"}, {"effective_mode": "?"}, {"last_attempt_at": ""}, {"error_count": -1},
            {"counts": {"files": {"local": -1}}}, {"fallbacks": [receipts.fallback("run")] * 17}, {"fallbacks": [{"code": "", "reason": "x"}]}, {"complete": True}, {"ingestion_complete": True}):
        with pytest.raises(receipts.InvalidProof):
            receipts.check_receipt(good | bad, "p")
    m = receipts.manifest("p", "0" * 32, 1, 2, 3, 4, "5")
    receipts.check_manifest(m, "p")
    for bad in ({"schema_version": 0}, {"project": "q"}, {"attempt": None}, {"updated_at": ""}, {"indexed_bytes": -1}, {"stats": {"files": -1}}, {"digest": "x"}):
        with pytest.raises(receipts.InvalidProof):
            receipts.check_manifest(m | bad, "p")


@pytest.mark.parametrize(("facts", "want"), [
    (("off", True, False, {}, 1), "off"), (("auto", False, False, {"local": 1}, 0), "local"), (("auto", False, True, {"local": 1}, 0), "local_fallback"), (("auto", True, False, {"gap": 1}, 1), "structural"),
    (("auto", True, True, {"structural": 1, "local": 1}, 1), "mixed"), (("required", True, False, {}, 3), "structural"), (("auto", True, False, {"local": 2}, 0), "local"), (("auto", True, False, {}, 0), "local")])
def test_effective_mode(facts, want):
    assert receipts.effective_mode(*facts) == want


def test_mode_names():
    assert [structural.parse_mode(x) for x in ("", " Auto", "OFF", "required ")] == ["auto", "auto", "off", "required"]


def test_a_nameless_first_page_spoils_only_itself(spark):
    page = lambda offset, project, last: (1, project, "0" * 12, "0" * 64, offset, 9, 4, 2, last, 0 if last else offset + 2, ["a", "b"])
    shape = "schema_version int, project string, project_key string, index_fingerprint string, offset long, limit int, total_records long, returned_records long, complete boolean, next_offset long, records array<string>"
    found = lambda *pages: sorted((r.offset, r.problem) for r in structural.page_problems(spark.createDataFrame(pages, shape)).collect())
    assert found(page(0, None, False), page(2, "p", True)) == [(0, "missing fields")]
    assert found(page(0, "p", False), page(2, "q", True)) == [(2, "changes between pages")]
