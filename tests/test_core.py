"""Core operators against pinned numbers and small tables."""

import json
import re
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import text as fn
from lodestrata.functions.vector import checked, cosine, usable
from lodestrata.operators import bm25, chunking, embedding, evaluate, freshness, graph, memory, search, stats, structural, vector_search
from lodestrata.options import FilterOptions, SearchOptions, fusion_weights, parse_line_range, parse_target, resolve_mode
from lodestrata.sources import scan


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


# ---- fusion, keyword scores, weights


def test_fusion_numbers(spark):
    vectors = spark.createDataFrame([(1, 0.95), (2, 0.10), (3, 0.80)], "chunk_id long, cosine double")
    texts = spark.createDataFrame([(1, 6.0, "x" * 400), (2, 8.0, "import zod"), (4, 4.0, "x" * 400)], "chunk_id long, bm25 double, content string")
    texts = texts.select("chunk_id", "bm25", fn.substance(F.col("content")).alias("substance"))
    got = {r.chunk_id: r.score for r in search.fuse(vectors, texts, (0.7, 0.3), 10).collect()}
    assert got == pytest.approx({1: 0.89, 2: 0.1705, 3: 0.56, 4: 0.15}, abs=1e-6)


@pytest.mark.parametrize("content,low,high", [("", 0.3, 0.3), (" \t\n ", 0.3, 0.3), ("import zod", 0.3, 0.5), ("y" * 500, 1.0, 1.0), (" " * 300 + "z", 0.3, 0.31)])
def test_substance(spark, content, low, high):
    assert low <= one(spark, fn.substance(F.lit(content))) <= high


def test_weights():
    assert fusion_weights(0.5) == fusion_weights(0.5, 0.5) == (0.5, 0.5)
    assert fusion_weights(0.7, 0.9)[1] == pytest.approx(0.5625)
    assert fusion_weights(3) == (1, 0) and SearchOptions(vector_weight=0).weights == (0, 1) and SearchOptions().weights[0] == 0.7


def test_keyword_normalisation(spark):
    hits = spark.createDataFrame([(1, 8.0), (2, 4.0), (3, 1.0)], "chunk_id long, bm25 double")
    got = [tuple(r) for r in search.with_min_score(search.normalised(hits).select("chunk_id", "score", "distance"), 0.4).orderBy("chunk_id").collect()]
    assert got == [(1, 1.0, 8.0), (2, 0.5, 4.0)]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "/a", "storage.ts", "typescript", "persist storage schema " * 20, 1, 20, "function", "save", [0.99, 0.1, 0, 0, 0, 0, 0, 0]),
        (2, "/a", "schemas.ts", "typescript", "import storage schema", 1, 1, "generic", "", [0.0, 1, 0, 0, 0, 0, 0, 0]),
        (3, "/a", "lib/math.ts", "typescript", "add numbers " * 30, 5, 9, "function", "add", [0.0, 0, 1, 0, 0, 0, 0, 0]),
        (4, "/b", "lib/x_test.go", "go", "storage elsewhere", 3, 8, "class", "X", None),
        (5, "/a", "lib/math.ts", "typescript", "", 1, 40, "block", "", [0.0] * 8),
    ]
    return spark.createDataFrame([(*r[:9], r[9] and [float(x) for x in r[9]]) for r in rows], "chunk_id long, project_root string, relative_path string, language string, content string, start_line int, end_line int, chunk_type string, symbol_name string, embedding array<float>")


def test_hybrid_prefers_substance(chunks):
    query = [1.0, 0, 0, 0, 0, 0, 0, 0]
    got = search.hybrid(chunks, query, "storage schema", SearchOptions(filters=FilterOptions(project_root="/a"))).collect()
    assert got[0].chunk_id == 1 and got[0].score >= 0.5 and all(0 <= r.score <= 1 for r in got)
    assert got[0].score - got[1].score >= 0.1


def test_vectors_of_no_use_are_left_out(chunks):
    got = [r.chunk_id for r in vector_search.top(chunks, [1.0] * 8, 10).collect()]
    assert sorted(got) == [1, 2, 3]


def test_search_modes(chunks):
    embed = lambda text: [1.0, 0, 0, 0, 0, 0, 0, 0]

    def broken(text):
        raise RuntimeError("down")
    found, warnings = search.search(chunks, "storage", SearchOptions("semantic", limit=1), embed)
    assert [r.chunk_id for r in found.collect()] == [1] and not warnings
    found, warnings = search.search(chunks, "storage", SearchOptions(), broken)
    assert warnings and {r.chunk_id for r in found.collect()} == {1, 2, 4}
    with pytest.raises(RuntimeError):
        search.search(chunks, "storage", SearchOptions("semantic"), broken)
    with pytest.raises(ValueError):
        search.search(chunks, "  ", SearchOptions(), embed)
    assert search.search(chunks, "?!", SearchOptions("keyword"), None)[0].count() == 0
    report = search.explain(chunks, "storage", SearchOptions("keyword"), None)
    assert report["mode"] == "keyword" and report["candidates"] == 5 and "Scan" in report["plan"]


def test_filter_options(chunks):
    from lodestrata.operators.filters import filtered

    ids = lambda **o: [r.chunk_id for r in filtered(chunks, FilterOptions(**o)).orderBy("chunk_id").collect()]
    assert ids(project_root="/b") == [4] and ids(language="GO") == [4] and ids(languages=("Go", "typescript"), chunk_type="FUNCTION") == [1, 3]
    assert ids(file_glob="**/*_test.go") == [4] and ids(file_glob="*.ts") == [1, 2] and ids(directory="lib") == ids(directory="lib/") == [3, 4, 5]
    assert ids(files=("storage.ts",)) == [1] and ids(files=tuple(f"f{i}" for i in range(2000)) + ("storage.ts",)) == [1]
    assert ids(min_line=3, max_line=5) == [3, 4] and ids(min_line=5) == [3] and ids(max_line=1) == [1, 2, 5]


def test_similar_and_locations(spark, chunks):
    assert [r.chunk_id for r in search.similar_by_id(chunks, 1, 10).collect()] == [2, 3]
    assert [r.chunk_id for r in search.similar_by_id(chunks, 1, 10, exclude_source=False, min_score=0.5).collect()] == [1]
    spots = spark.createDataFrame([("lib/math.ts", 6), ("lib/math.ts", 30), ("lib/math.ts", 99)], "relative_path string, line int")
    assert {r.line: r.chunk_id for r in search.chunk_at(chunks, spots).collect()} == {6: 3, 30: 5}
    assert search.similar_by_location(chunks, "lib/math.ts", 6, 5).count() == 2
    with pytest.raises(LookupError):
        search.similar_by_location(chunks, "lib/math.ts", 99, 5)
    assert search.by_file(chunks, "lib/math.ts").first().score == 1.0


def test_batches_keep_the_first_query(chunks):
    v = [1.0, 0, 0, 0, 0, 0, 0, 0]
    rows = search.batch(chunks, [("storage", v), ("storage", v)], SearchOptions(limit=2)).collect()
    assert {r.query_no for r in rows} == {0} and len(rows) == 2
    assert search.batch(chunks, [("storage", v), ("storage", v)], SearchOptions(limit=2), dedup=False).count() == 4


@pytest.mark.parametrize("together", [16, 2])
@pytest.mark.parametrize("filters", [{}, {"project_root": "/a"}, {"files": (*(f"f{i}" for i in range(2000)), "storage.ts", "lib/x_test.go")}, {"project_root": "/none"}])
def test_batches_equal_single_searches(chunks, monkeypatch, together, filters):
    monkeypatch.setattr(search, "TOGETHER", together)
    o = SearchOptions(limit=3, text_weight=0.4, filters=FilterOptions(**filters))
    asked = [("storage schema", [1.0, 0, 0, 0, 0, 0, 0, 0]), ("?!", [0.0, 0, 1, 0, 0, 0, 0, 0.5]), ("add elsewhere", [0.0, 1, 1, 0, 0, 0, 0, 0])]
    got = [tuple(r) for r in search.batch(chunks, asked, o, dedup=False).orderBy("query_no", "rank").select("query_no", "chunk_id", "score").collect()]
    assert got == [(no, r.chunk_id, r.score) for no, (text, v) in enumerate(asked) for r in search.hybrid(chunks, v, text, o).collect()]


def test_long_lists_of_files_bind_keywords_too(chunks):
    o = FilterOptions(files=(*(f"f{i}" for i in range(2000)), "schemas.ts"))
    assert [r.chunk_id for r in bm25.top(chunks, "storage", 5, o).collect()] == [2]


def test_bm25_index_agrees_with_scan(chunks):
    direct = [tuple(r) for r in bm25.top(chunks, "storage schema", 5).select("chunk_id", "bm25").collect()]
    stored = [tuple(r) for r in bm25.top_indexed(bm25.postings(chunks), bm25.length_stats(chunks), "storage schema", 5).collect()]
    assert direct == stored and len(direct) == 3


def test_cosine_and_checks(spark):
    pair = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 1.0, 2.0])], "a array<float>, b array<float>")
    assert pair.select(cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(8 / 9)
    assert pair.select(usable(F.col("a"), 3), usable(F.col("a"), 4)).first()[:] == (True, False)
    with pytest.raises(Exception, match="expected 4 dimensions"):
        pair.select(checked(F.col("a"), 4)).collect()


def test_option_parsing():
    assert parse_line_range("3-9") == (3, 9) and parse_line_range("3") == (0, 0) and parse_line_range("x-4") == (0, 4)
    assert parse_target("12") == {"chunk_id": 12} and parse_target("a/b.go:7") == {"path": "a/b.go", "line": 7} and parse_target("", "t") == {"text": "t"}
    assert resolve_mode("SEMANTIC") == "semantic" and resolve_mode("x") == "hybrid"
    for bad in (("", ""), ("1", "t"), ("abc", "")):
        with pytest.raises(ValueError):
            parse_target(*bad)


# ---- chunking


@pytest.mark.parametrize("n,want", [
    (3, [(1, 3)]), (4, [(1, 4), (2, 4)]), (10, [(1, 10), (8, 10)]), (25, [(1, 25), (23, 25)]), (26, [(1, 25), (23, 26), (24, 26)]),
    (60, [(1, 25), (23, 47), (45, 60), (58, 60)]),
])
def test_line_windows(n, want):
    got = [(a + 1, b) for a, b in chunking.windows(n, [False] * n, 25, 3)]
    assert got == want
    text = "\n".join(f"line {i}" for i in range(n)) + "\n"
    assert [(c.start_line, c.end_line) for c in chunking.chunk_text(text, "unknown")] == want


GO = 'package p\n\nimport "fmt"\n\nfunc A(x int) {\n\tfmt.Println("}{")\n}\n\ntype T struct {\n\ta int\n}\n\nvar z = 1\n'
PY = "import os\n\n\nclass A:\n    def m(self):\n        return 1\n\n# note\ndef f(x):\n    pass\n\nprint(1)\n"


def test_semantic_blocks():
    go = chunking.chunk_text(GO, "go")
    assert [(c.chunk_type, c.symbol_name, c.start_line, c.end_line) for c in go if c.symbol_name] == [("function", "A", 5, 9), ("class", "T", 9, 11)]
    assert "".join(c.content for c in go) == GO
    py = chunking.chunk_text(PY, "python")
    assert [(c.chunk_type, c.symbol_name, c.start_line, c.end_line) for c in py if c.symbol_name] == [("class", "A", 4, 8), ("function", "f", 9, 11)]
    assert "".join(c.content for c in py).replace("\n", "") == PY.replace("\n", "")
    js = chunking.chunk_text("export function foo() {\n  return 1\n}\n", "javascript")
    assert len([c for c in js if c.chunk_type != "generic"]) == 1
    twice = chunking.chunk_text("function foo() {\n  return 1\n}\n", "javascript", chunking.ChunkOptions(unique_spans=False))
    assert sorted((c.chunk_type, c.symbol_name) for c in twice if c.content.strip()) [:2] == [("block", "function"), ("function", "foo")]
    big = "func Big() {\n" + "\tx := 1 // padding padding padding\n" * 300 + "}\n"
    parts = chunking.chunk_text(big, "go")
    assert len(parts) > 3 and all(len(c.content.encode()) <= 4096 for c in parts)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab{}\n\t 'é\U0001F600\""), max_size=600), st.sampled_from(["go", "python", "rust", "unknown"]))
def test_chunks_are_bounded_and_lose_nothing(text, language):
    o = chunking.ChunkOptions(size=160, overlap=80, max_bytes=60)
    made = chunking.chunk_text(text, language, o)
    assert all(len(c.content.encode()) <= 60 and c.start_line <= c.end_line for c in made)
    words = lambda s: set("".join(ch if ch not in " \n\t" else " " for ch in s).replace(" ", ""))
    assert words("".join(c.content for c in made)) == words(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["func A() {", "\tx()", "}", "", "type T struct {", "var a", "  ", "// é"]), max_size=40))
def test_blocks_and_gaps_are_the_file(lines):
    text = "\n".join(lines)
    made = chunking.chunk_text(text, "go", chunking.ChunkOptions(size=10**6, max_bytes=10**6))
    spans = [(c.start_byte, c.end_byte) for c in made]
    nested = any(a[1] > b[0] + 1 for a, b in zip(spans, spans[1:]))
    if any(c.symbol_name or c.chunk_type != "generic" for c in made) and not nested:
        assert "".join(c.content for c in made).replace("\n", "") == text.replace("\n", "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["func ", "func A() {", "\xa0func B(", "type T {", "}", "{", '"', "'", "`", "\\", "\n", "\n", " ", "\t", "\v", "# c", "def ", "def f(x):", "class A:", "async def g(", "é", "x"]), max_size=60))
def test_blocks_as_found_line_by_line(parts):
    text = "".join(parts)
    lines = text.split("\n")

    def closing(first):
        depth, rest = 0, "\n".join(lines[first:])
        for m in re.finditer(r"""(["'`])(?:\\.|(?!\1).)*(?:\1|\Z)|[{}]""", rest, re.S):
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            if m[0] in "{}" and not depth:
                return first + rest.count("\n", 0, m.start())
        return len(lines) - 1

    want = [(kind, chunking.symbol_of(x.strip(chunking.SPACE), prefix), no + 1, closing(no) + 1)
            for prefix, kind in chunking.BLOCKS["go"] for no, x in enumerate(lines) if x.strip(chunking.SPACE).startswith(prefix)]
    place = lambda blocks: [(b.chunk_type, b.symbol_name, b.start_line, b.end_line) for b in blocks]
    assert place(chunking._braced(chunking.Source(text), chunking.BLOCKS["go"])) == want
    want, no = [], 0
    while no < len(lines):
        m = re.match(r"([ \t]*)(async def |def |class )([^(: ]*)", lines[no])
        last = no
        if m:
            inside = lambda x: not x.strip(chunking.SPACE) or x.strip(chunking.SPACE)[0] == "#" or len(x) - len(x.lstrip(" \t")) > len(m[1])  # noqa: E731, B023
            last = next((k - 1 for k in range(no + 1, len(lines)) if not inside(lines[k])), len(lines) - 1)
            want.append(("class" if m[2] == "class " else "function", m[3], no + 1, last + 1))
        no = last + 1
    assert place(chunking._indented(chunking.Source(text))) == want


def test_only_wanted_columns_leave_the_tasks(spark):
    rows = [("/p", f"{i}.go", "go", "h", "h", 12, GO if i % 3 else None) for i in range(7)]
    files = spark.createDataFrame(rows, "project_root string, relative_path string, language string, file_hash string, source_hash string, file_size long, content string")
    wanted = ["symbol_name", "relative_path", "chunk_index", "end_line"]
    few, every = chunking.chunk_files(files, columns=wanted), chunking.chunk_files(files)
    assert few.columns == wanted and every.columns == [c.split()[0] for c in chunking.CHUNKS.split(", ")]
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, every.select(*wanted).collect())) and few.count() > 7


def test_structural_partition_is_the_file(spark):
    text = "a\nb\nc\nd\ne\nf\n"
    records = [{"start_line": 2, "end_line": 5, "symbol": "outer", "fqn": "p.outer", "kind": "class", "docstring": "doc", "signature": "sig"}, {"start_line": 3, "end_line": 4, "symbol": "inner", "fqn": "", "kind": "method"}]
    parts = structural.partition(text, records)
    assert "".join(c.content for c, _ in parts) == text
    assert [(c.start_line, c.end_line, c.symbol_name, c.chunk_type) for c, _ in parts] == [(1, 1, "", "generic"), (2, 2, "p.outer", "class"), (3, 4, "inner", "function"), (5, 5, "p.outer", "class"), (6, 6, "", "generic")]
    assert parts[1][1] == "doc\n\nsig\n\nb\n" and parts[0][1] is None
    long = [c for c, _ in structural.partition("é" * 9000, [])]
    assert all(len(c.content.encode()) <= 4096 for c in long) and "".join(c.content for c in long) == "é" * 9000
    files = spark.createDataFrame([("/p", "x.go", "go", "h", "h", 12, text)], "project_root string, relative_path string, language string, file_hash string, source_hash string, file_size long, content string")
    symbols = spark.createDataFrame([("x.go", 0, 2, 5, "outer", "", "class", "", "")], "relative_path string, ordinal int, start_line int, end_line int, symbol string, fqn string, kind string, signature string, docstring string")
    assert structural.chunk_structurally(files, symbols).count() == 3


def test_structural_validation(spark):
    import hashlib
    h = hashlib.sha256(b"x").hexdigest()
    row = dict(file="a.go", start_line=1, end_line=2, file_stale=False, content_omitted=False, content_truncated=False, source_hash=h, content="x", content_hash=h)
    rows = [row, row | {"file": "../a"}, row | {"end_line": 0}, row | {"file_stale": True}, row | {"content": "y"}, row | {"source_hash": "Z"}]
    got = [r[0] for r in spark.createDataFrame(rows).select(structural.record_issue()).collect()]
    assert got == [None, "file outside the project", "bad lines", "stale file", "content hash differs", "bad source hash"]


# ---- files, hashes, states


def test_pending_changes(spark):
    now = spark.createDataFrame([("same", "1"), ("changed", "2"), ("new", "3"), ("unknown", "4")], "relative_path string, source_hash string")
    then = spark.createDataFrame([("same", "1"), ("changed", "x"), ("gone", "3"), ("unknown", "")], "relative_path string, source_hash string")
    assert freshness.pending(now, then).first().asDict() == {"new_files": 1, "modified_files": 2, "deleted_files": 1, "total_pending": 4}
    assert [r.relative_path for r in freshness.to_prune(then, now).collect()] == ["gone"] and freshness.to_prune(then, now, False).isEmpty()
    parts = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"), ("c", "")], "relative_path string, source_hash string")
    assert {r.relative_path: r.complete for r in stats.source_hashes(parts).collect()} == {"a": True, "b": False, "c": False}


def test_readiness_column_and_function_agree(spark):
    facts = [(i, f, m, s) for i in (True, False) for f in (True, False) for m in (True, False) for s in (None, "fresh", "stale", "unknown")]
    df = spark.createDataFrame(facts, "indexed boolean, fresh boolean, profile_matches boolean, freshness_state string")
    for r in freshness.readiness(df).collect():
        assert freshness.readiness_of(*r[:4]) == freshness.Readiness(r.state, r.action, r.blocks_search)


def test_languages_globs_and_ignore_rules(spark):
    paths = {"a/b.go": "go", "x.TFVARS.json": "terraform", "Makefile": "shell", "dockerfile.prod": "shell", ".bashrc": "unknown", "zshrc": "shell", "m.tsx": "typescript", "n.xyz": "unknown", "c.c++": "cpp"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.l for r in df.select("p", scan.language(F.col("p")).alias("l")).collect()} == paths
    rules = ["# c", "", "*.log", "!keep.log", "build/", "/top.txt", "docs/**/x?.md"]
    cases = {"a/b.log": True, "a/keep.log": False, "build/x": True, "a/build/y/z": True, "build": False, "top.txt": True, "a/top.txt": False, "docs/x1.md": True, "docs/a/b/x2.md": True, "docs/x.md": False}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.i for r in df.select("p", scan.ignored(F.col("p"), rules).alias("i")).collect()} == cases
    df = spark.createDataFrame([("v/a",), ("v",), ("x/y.tmp",), ("x/z.go",)], "p string")
    assert [r[0] for r in df.select(scan.watch_ignored(F.col("p"), ["v/**", "*.tmp"])).collect()] == [True, True, True, False]


def test_text_eligibility(spark):
    data = [(b"", True, False), (b"a\x00b", False, False), (b"\xff\xfe", False, False), ("é x".encode(), True, True), (b" \n\t", True, False), (b"x" * 8191 + "é".encode(), False, False)]
    df = spark.createDataFrame([(bytearray(b), t, i) for b, t, i in data], "b binary, t boolean, i boolean")
    for r in df.select("t", "i", scan.is_text(F.col("b")).alias("gt"), scan.is_indexable(F.col("b")).alias("gi")).collect():
        assert (r.gt, r.gi) == (r.t, r.i)


def test_scalar_functions(spark):
    assert one(spark, fn.branch_name(F.lit("-feat/x..y: z~"))) == "feat-x--y--z" and one(spark, fn.branch_name(F.lit("//"))) == "unnamed"
    assert one(spark, fn.cache_text(F.lit("  a \n\n\tb  \n"))) == "a\nb"
    assert one(spark, fn.cache_key(F.lit("a"), F.lit("m"), F.lit("query"))) != one(spark, fn.cache_key(F.lit("a"), F.lit("m"), F.lit("document")))
    assert one(spark, fn.template_applied(F.lit("<{{text}}>"), F.lit("t"))) == "<t>" and one(spark, fn.template_applied(F.lit("q: "), F.lit("t"))) == "q: t"
    assert one(spark, fn.python_import(F.lit("import a as b, c"))) == "a" and one(spark, fn.python_import(F.lit("from x.y import z"))) == "x.y"
    assert one(spark, fn.js_import(F.lit("import {a} from './b';"))) == "./b" and one(spark, fn.required(F.lit("const x = require('y')"))) == "y"
    assert one(spark, fn.selector_key(F.lit(42))) == "000000000042" and fn.utf8_prefix("éé", 3) == "é"
    assert one(spark, scan.source_span(F.lit("a\r\nb\nc\nd"), F.lit("c"), F.lit(1), F.lit(9))) == "b\nc\nd" and one(spark, scan.source_span(F.lit("a a"), F.lit("a"), F.lit(1), F.lit(1))) is None


# ---- memory, evaluation, graph


def test_memory(spark):
    t0 = datetime(2024, 1, 1)
    empty = spark.createDataFrame([], "id long, content string, importance double, tags array<string>, created_at timestamp, expires_at timestamp, embedding array<float>")
    m = memory.remember(empty, "a", [1.0, 0], t0, tags=["heatmap"], ttl_hours=1)
    m = memory.remember(m, "b", [1.0, 0.1], t0, importance=7, tags=["heatmap-extra", "x"])
    m = memory.remember(m, "c", [0.0, 1], t0, tags=["heatmap", "x"]).cache()
    assert [r.importance for r in m.orderBy("id").collect()] == [0.5, 1.0, 0.5]
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    got = memory.recall(m, [1.0, 0.0], now).collect()
    assert [r.id for r in got] == [2, 3] and got[0].score == pytest.approx(got[0].similarity * 0.5 * 1.25, abs=1e-5)
    assert [r.id for r in memory.recall(m, [1.0, 0.0], now, tags=["heatmap"]).collect()] == [3]
    assert memory.forget(m, tags=["map-e"], confirm="yes").count() == 2 and memory.forget(m, id=1).count() == 2
    with pytest.raises(ValueError):
        memory.forget(m, tags=["x"])
    row = memory.statistics(m, now).first()
    assert (row.memories, row.expired, row.live, row.distinct_tags) == (3, 1, 2, 3)


def test_evaluation_numbers(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.98, 0.2]), (3, [0.9, 0.4]), (4, [0.7, 0.7]), (5, [0.4, 0.9]), (6, [0.0, 1.0])], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "query_id long, embedding array<float>")
    relevant = spark.createDataFrame([(1, 1), (1, 6), (2, 2)], "query_id long, doc_id long")
    row = evaluate.summary(evaluate.per_query(evaluate.ranked(queries, docs), relevant)).first()
    assert (row.top1, row.recall_5, row.recall_10, row.mrr) == (0.5, 0.75, 1.0, 0.75)
    equal = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "doc_id long, embedding array<float>")
    assert [r.doc_id for r in evaluate.ranked(queries.limit(1), equal).orderBy("rank").collect()] == [1, 2, 3]


def test_reranking(spark):
    hot = spark.createDataFrame([("Hub", 100, 0), ("Inflated", 100, 10), ("Minor", 5, 0), ("Minor", 2, 1)], "symbol string, in_degree int, shared_name int")
    assert {r.symbol_name: r.hub for r in graph.hub_scores(hot).collect()} == {"Hub": 100, "Inflated": 10, "Minor": 5}
    hits = spark.createDataFrame([(1, "Minor", 0.8), (2, "Hub", 0.75), (3, "None", 0.8)], "chunk_id long, symbol_name string, score double")
    assert [r.chunk_id for r in graph.reranked(hits, hot).collect()] == [2, 1, 3]
    assert [r.chunk_id for r in graph.reranked(hits, hot.where("false")).collect()] == [1, 3, 2]


def test_related_files(spark):
    files = spark.createDataFrame([
        ("internal/db/db.go", 'package db\nimport (\n\t"fmt"\n\tx "m/internal/util"\n)\n'), ("internal/db/db_test.go", 'package db\nimport "m/internal/db"\n'),
        ("cmd/main.go", 'package main\nimport "m/internal/db"\n'), ("other/db.go", 'import "m/notinternal/db"'), ("internal/db/config.yaml", "a: 1"),
        ("app/a.py", "import os, sys\nfrom b import c\n"), ("app/b.py", "x = 1"), ("web/a.js", "import z from './z';\nconst q = require('q')\n"),
    ], "relative_path string, content string")
    got = {(r.relationship, r.relative_path) for r in graph.related_files(files, "internal/db/db.go").collect()}
    assert got == {("imports", "fmt"), ("imports", "m/internal/util"), ("imported_by", "cmd/main.go"), ("test", "internal/db/db_test.go"), ("config", "internal/db/config.yaml")}
    assert {tuple(r) for r in graph.imports(files).where("relative_path like 'web%' or relative_path like 'app%'").collect()} == {("app/a.py", "os"), ("app/a.py", "b"), ("web/a.js", "./z"), ("web/a.js", "q")}
    assert [r[0] for r in graph.imported_by_mention(files, "app/b.py").collect()] == ["app/a.py"]
    assert [r.relative_path for r in graph.entry_points(files.withColumn("relative_path", F.replace("relative_path", F.lit("app/a.py"), F.lit("app.py")))).collect()] == ["app.py"]
    tree = graph.directory_tree(files).collect()
    assert tree[0].is_dir and {r.name for r in tree if r.level == 1} == {"internal", "cmd", "other", "app", "web"}


def test_embedding_is_all_or_nothing(spark):
    class Fails(embedding.HashingEmbedder):
        def embed_documents(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return super().embed_documents(texts)
    rows = [("/p", "a", i, t) for i, t in enumerate(["x", "y"])] + [("/p", "b", 0, "z")] + [("/p", "c", i, f"bad {i}") for i in range(2)]
    chunks = spark.createDataFrame(rows, "project_root string, relative_path string, chunk_index int, content string").repartition(5, "content")
    done, new = embedding.embedded_chunks(chunks, Fails(16))
    assert {r.relative_path for r in done.collect()} <= {"a", "b"} and new.where("error is not null").count() >= 2
    cache = new.where("error is null").select("cache_key", "embedding", F.lit(datetime(2024, 1, 1)).alias("created_at"))
    assert embedding.merged(cache, cache).count() == cache.count()
    assert embedding.fresh(cache, F.lit("2024-01-02").cast("timestamp"), 3600).count() == 0


def test_index_counts_what_could_not_be_embedded(spark, tmp_path):
    from lodestrata.engine import Engine

    calls = tmp_path / "calls"

    class Fails(embedding.HashingEmbedder):
        def embed_documents(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            with open(calls, "a") as f:
                f.write("".join(t.strip() + "\n" for t in texts))
            return super().embed_documents(texts)
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.txt").write_text("fine words\n")
    e = Engine(spark, str(root), str(tmp_path / "store"), Fails(16))
    assert e.index()["failed_files"] == 0 and e.store.proven(e.project)
    (root / "b.txt").write_text("bad words\n")
    (root / "c.txt").write_text("fine words\n")
    got = e.index()
    assert got["failed_files"] == 1 and not e.store.proven(e.project) and e.readiness().state != "ready"
    assert {r.relative_path for r in e.chunks().collect()} == {"a.txt", "c.txt"} and calls.read_text().count("fine words") == 1


def test_best_of_each_row_with_ties():
    scores, ids = np.array([[3, 1, 3, 2, 3], [0, 0, 0, 0, 0]], float), np.array([9, 8, 7, 6, 5])
    row, col = vector_search._best(scores, ids, 2)
    assert row.tolist() == [0, 0, 1, 1] and ids[col].tolist() == [5, 7, 5, 6]


# ---- the whole


def test_index_search_and_maintain(spark, tmp_path):
    from lodestrata.cli import main
    from lodestrata.engine import Engine
    from lodestrata.sources.store import DirtyError, SupersededError

    root, data = tmp_path / "tree", str(tmp_path / "store")
    (root / "cmd").mkdir(parents=True)
    (root / "cmd" / "main.go").write_text(GO)
    (root / "app.py").write_text(PY)
    (root / "__init__.py").write_text("x = 1\n")
    (root / "blob.bin").write_bytes(b"\x00\x01")
    (root / "skip.log").write_text("no")
    (root / ".gitignore").write_text("*.log\n")
    e = Engine(spark, str(root), data, embedding.HashingEmbedder(32))
    assert e.readiness().state == "empty" and e.dry_run()["new_files"] == 4
    first = e.index()
    assert first["files"] == 4 and e.readiness().state == "ready"
    ids = {r.chunk_key: r.chunk_id for r in e.chunks().collect()}
    assert len(set(ids.values())) == len(ids) == first["chunks"]
    hits, _ = e.search("fmt Println", SearchOptions(limit=1))
    assert hits.first().relative_path == "cmd/main.go"
    (root / "app.py").write_text(PY + "\ndef g():\n    return 'needle'\n")
    (root / "cmd" / "main.go").unlink()
    assert e.readiness().state == "stale" and e.pending()["total_pending"] == 2
    second = e.index()
    assert second["files"] == 3 and second["deleted_files"] == 1
    assert e.search("needle", SearchOptions("keyword"))[0].first().symbol_name == "g"
    assert e.similar(text="def g").count() > 0 and e.overview()["entry_points"] == ["app.py"]
    assert e.context(e.search("needle", SearchOptions("keyword"))[0], 1).first().content.count("\n") >= 2
    e.store.snapshot("feature/x")
    assert e.delete("app.py") > 0 and e.readiness().state in ("stale", "unknown")
    assert e.store.switch("feature/x", e.profile) and not e.store.switch("none")
    assert e.search("needle", SearchOptions("keyword"))[0].count() == 1
    other = Engine(spark, str(root), data, embedding.HashingEmbedder(16))
    assert other.readiness().state == "profile_mismatch"
    with pytest.raises(ValueError):
        other.search("x")
    attempt = e.store.begin_receipt(e.project)
    e.store.begin_receipt(e.project)
    with pytest.raises(SupersededError):
        e.store.finish_receipt(e.project, attempt, complete=True)

    def fails():
        raise RuntimeError
    with pytest.raises(RuntimeError):
        e.store.guarded(e.project, fails)
    with pytest.raises(DirtyError):
        e.index()
    assert e.index(full=True)["files"] == 3
    with pytest.raises(ValueError):
        e.store.upsert(spark.createDataFrame([("/z", "q", 0, 0, 1, 0, [1.0])], "project_root string, relative_path string, start_byte int, end_byte int, start_line int, chunk_index int, embedding array<float>"), dim=2)
    assert main(["--root", str(root), "--data", data, "status"], spark) == 0
    with pytest.raises(ValueError):
        e.store.reset(e.project)
    e.store.reset(e.project, "yes")
    assert e.readiness().state == "empty" and e.store.clean()["chunks"] == 0


def test_upsert_keeps_ids(spark, tmp_path):
    from lodestrata.sources.store import ChunkStore
    store = ChunkStore(spark, str(tmp_path / "s"))
    rows = lambda text, n: spark.createDataFrame([("/z", f"f{i}", 0, 9, 1, 0, text) for i in range(n)], "project_root string, relative_path string, start_byte int, end_byte int, start_line int, chunk_index int, content string")
    store.upsert(rows("a", 3))
    before = {r.relative_path: r.chunk_id for r in store.read().collect()}
    store.upsert(rows("b", 5))
    after = {r.relative_path: r.chunk_id for r in store.read().collect()}
    assert sorted(after.values()) == [1, 2, 3, 4, 5] and before.items() <= after.items()
    assert {r.content for r in store.read().collect()} == {"b"}
    assert store.delete_file("/y", "f1") == 0 and store.delete_file("/z", "/z/f1") == 1


def test_watch_applies_the_last_event(spark, tmp_path):
    from lodestrata.streaming import watch
    source = tmp_path / "events"
    source.mkdir()
    rows = [("a", "write", 1), ("a", "remove", 2), ("b", "remove", 1), ("b", "create", 3), ("v/x", "write", 1), ("c", "rename", 5)]
    (source / "1.json").write_text("\n".join(json.dumps({"path": p, "op": o, "ts": f"2024-01-01T00:00:0{t}Z"}) for p, o, t in rows))
    stream = spark.readStream.schema("path string, op string, ts timestamp").json(str(source))
    seen = []
    q = watch.watch(stream, lambda new, gone, n: seen.append(([r.path for r in new.collect()], [r.path for r in gone.collect()], n)), str(tmp_path / "cp"), ["v/**"], tick=None)
    q.awaitTermination(60)
    assert seen == [(["b"], ["a", "c"], 0)]


def test_stream_windows_equal_the_batch(spark, sf_dir, tmp_path):
    from lodestrata.plans import state
    from lodestrata.streaming import watch
    rows = state.events(spark, sf_dir)
    rows.repartition(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    q = watch.tumbling(stream, "1 day", "1 hour").writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("windows").collect()}
    want = {tuple(r) for r in watch.tumbling(rows, "1 day").collect()}
    assert got and got <= want and len(want) - len(got) <= 12


def test_driver_functions(tmp_path):
    from lodestrata.functions import driver
    assert driver.fnv1a32("") == "811c9dc5" and driver.fnv1a32("a") == "e40c292c"
    assert driver.human_bytes(512) == "512 B" and driver.human_bytes(1536) == "1.5 KB" and driver.human_duration(3720) == "1h02m"
    assert driver.short_note("x" * 200).endswith("...") and len(driver.short_note("é" * 200).encode()) <= 120
    assert driver.project_names(["/a/x", "/b/x", "/c/y"]) == {"/a/x": "a/x", "/b/x": "b/x", "/c/y": "y"}
    (tmp_path / "c.json").write_text('{"search.limit": 5, "search.vector_weight": 0.5}')
    got = driver.resolved_config([str(tmp_path / "c.json"), "/none.json"], {"LODESTRATA_SEARCH_LIMIT": "7"})
    assert got["search.limit"] == 7 and got["search.vector_weight"] == 0.5 and got["search.mode"] == "hybrid"
    for key, bad in (("search.mode", "x"), ("search.vector_weight", "2"), ("watch.enabled", "maybe")):
        with pytest.raises(ValueError):
            driver.config_value(key, bad)


def test_peer_answers(spark, tmp_path):
    from lodestrata.sources import peers
    write = lambda name, x: (tmp_path / name).write_text(json.dumps(x)) and str(tmp_path / name)
    hot = write("h.json", {"project": "p", "hotspots": [{"symbol": "Hub", "in_degree": 100, "shared_name": 0}]})
    assert peers.hotspots(spark, hot).first()[:] == ("Hub", 100, 0)
    node = lambda f: {"symbol": "s", "file": f}
    found = write("i.json", {"found": True, "locations": [node("app/auth.go")], "direct_callers": [node("app/login.go")], "blast_radius": [node("app/login.go"), node("api/handler.go")], "tests": [node("app/auth_test.go")]})
    files = graph.impact_files(peers.impact(spark, found)).collect()
    assert [r.file for r in files] == ["app/auth.go", "app/login.go", "api/handler.go", "app/auth_test.go"] and [r.is_test for r in files] == [False, False, False, True]
    assert peers.impact(spark, write("n.json", {"found": False})).isEmpty()
    assert peers.related(spark, write("r.json", {"indexed": False, "related": []})) is None
    assert peers.related(spark, write("e.json", {"indexed": True, "related": []})).count() == 0
    assert peers.graph_state(spark, write("s.json", {"registered": True, "nodes": 3, "stale": None})) == "fresh"
    assert peers.graph_state(spark, write("t.json", {"registered": True, "nodes": 3, "stale": {"changed": 1, "new": 0, "deleted": 0}})) == "stale"
    assert peers.symbol_at(spark, write("a.json", {"file": "x", "resolution": "none"})) is None


def test_approximate_neighbours_recall(spark, sf_dir):
    from lodestrata.operators import lsh
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding").cache()
    buckets = lsh.index(rows, 64, tables=32, bits=4).cache()
    hits = total = 0
    for r in rows.where("chunk_id % 100 = 0").collect():
        exact = {x.chunk_id for x in vector_search.top(rows, r.embedding, 3).collect()}
        hits += len(exact & {x.chunk_id for x in lsh.top(rows, buckets, r.embedding, 3, tables=32, bits=4).collect()})
        total += len(exact)
    assert hits / total >= 0.9


@pytest.mark.parametrize(("lang", "name"), [("go", "chunk_semantic_go"), ("python", "chunk_semantic_python")])
def test_semantic_chunks_are_of_all_words(spark, tmp_path, lang, name):
    from lodestrata import plans

    words = ["w" + "abcdefghij"[i // 1000] + "abcdefghij"[i // 100 % 10] + "abcdefghij"[i // 10 % 10] + "abcdefghij"[i % 10] for i in range(3000)]
    spark.createDataFrame([(1, " ".join(words), "en", "web", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.QUERIES[name](spark, str(tmp_path)).where("chunk_type = 'function'").orderBy("chunk_index").collect()
    assert [r.symbol_name for r in found] == ["f_" * (lang == "python") + w for w in words]
