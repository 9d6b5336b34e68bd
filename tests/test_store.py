"""The store of segments, its indexes, and what keeps it current."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.engine import Engine
from lodestrata.operators import bm25, cells, embedding, search, vector_search
from lodestrata.options import FilterOptions, SearchOptions
from lodestrata.plans import registry
from lodestrata.sources import scan
from lodestrata.sources import store as stores
from lodestrata.sources.store import ChunkStore

SHAPE = "project_root string, relative_path string, start_byte int, end_byte int, start_line int, chunk_index int, content string, embedding array<float>"
WORDS = "alpha beta gamma delta the of storage index query".split()


def rows_of(spark, rng, paths, project="/p"):
    rows = []
    for p in paths:
        for i in range(rng.randint(1, 3)):
            rows.append((project, p, i * 10, i * 10 + 9, i + 1, i, " ".join(rng.choices(WORDS, k=rng.randint(1, 12))), [rng.gauss(0, 1) for _ in range(8)]))
    return spark.createDataFrame(rows, SHAPE), rows


def contents(store):
    return sorted((r.project_root, r.relative_path, r.chunk_index, r.content) for r in store.read().collect())


def size_of(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_any_history_of_edits(spark, tmp_path):
    """A random history against a dictionary; afterwards stored indexes agree with scans."""
    rng = random.Random(3)
    store, want = ChunkStore(spark, str(tmp_path / "s")), {}
    for step in range(14):
        kind = rng.choice(["replace", "replace", "upsert", "delete", "project"]) if step > 2 else "replace"
        if kind == "replace":
            df, rows = rows_of(spark, rng, rng.sample([f"f{i}" for i in range(12)], 4))
            gone = rng.sample([f"f{i}" for i in range(12)], 2)
            gone = [g for g in gone if g not in {r[1] for r in rows}]
            store.replace_files(df, "/p", spark.createDataFrame([(g,) for g in gone], "relative_path string"))
            want = {k: v for k, v in want.items() if k[0] != "/p" or k[1] not in {r[1] for r in rows} | set(gone)} | {(r[0], r[1], r[5]): r[6] for r in rows}
        elif kind == "upsert":
            df, rows = rows_of(spark, rng, ["f1", "f2", "g1"], rng.choice(["/p", "/q"]))
            store.upsert(df)
            want |= {(r[0], r[1], r[5]): r[6] for r in rows}
        elif kind == "delete":
            path = f"f{rng.randrange(12)}"
            n = store.delete_file("/p", path)
            assert n == sum(k[:2] == ("/p", path) for k in want)
            want = {k: v for k, v in want.items() if k[:2] != ("/p", path)}
        else:
            store.delete_project("/q")
            want = {k: v for k, v in want.items() if k[0] != "/q"}
        if step % 4 == 1:
            assert contents(store) == sorted((*k, v) for k, v in want.items())
    assert contents(store) == sorted((*k, v) for k, v in want.items())
    assert len(store.state["segments"]) < 8
    ids = [r.chunk_id for r in store.read().collect()]
    assert len(ids) == len(set(ids)) == store.state["live"]["chunks"]
    for query, o in (("alpha storage", FilterOptions()), ("the query beta", FilterOptions(project_root="/p"))):
        scanned = [tuple(r) for r in bm25.top(store.read(), query, 7, o).select("chunk_id", "bm25").collect()]
        assert [tuple(r) for r in search.top_by_text(store.read(), query, 7, o, store).select("chunk_id", "bm25").collect()] == scanned
    asked = [("alpha of", [1.0] * 8), ("delta", [0.5, -1.0] * 4)]
    both = [sorted(map(tuple, search.batch(store.read(), asked, SearchOptions(limit=3), stored=s).collect())) for s in (None, store)]
    assert both[0] == both[1] and both[0]
    store.compact()
    assert contents(store) == sorted((*k, v) for k, v in want.items()) and len(store.state["segments"]) == 1 and not store.state["dead"]


def test_a_small_change_writes_little(spark, tmp_path):
    rng = random.Random(1)
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.replace_files(rows_of(spark, rng, [f"f{i}" for i in range(400)])[0].withColumn("content", F.repeat("content", 200)), "/p")
    first = size_of(tmp_path / "s")
    store.replace_files(rows_of(spark, rng, ["f7"])[0], "/p")
    gen = store.state["generation"]
    assert sum(size_of(tmp_path / "s" / folder / f"gen={gen}") for folder in ("chunks", "dead")) < first / 10
    assert store.read().where("relative_path = 'f7'").count() <= 3
    plan = store.postings(["alpha"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters" in plan and "EqualTo(term,alpha)" in plan


def test_readers_of_late_and_branches_keep_their_files(spark, tmp_path):
    rng = random.Random(2)
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.upsert(rows_of(spark, rng, ["a", "b"])[0])
    before, old = contents(store), store.read()
    store.snapshot("x/y")
    for _ in range(6):
        store.upsert(rows_of(spark, rng, ["a", "b", "c"])[0])
    store.compact()
    assert sorted((r.project_root, r.relative_path, r.chunk_index, r.content) for r in old.collect()) == before
    assert contents(store) != before and store.switch("x/y") and contents(store) == before
    store.upsert(rows_of(spark, rng, ["z"])[0])
    assert len({r.chunk_id for r in store.read().collect()}) == store.read().count()


def test_a_load_stages_no_texts_and_exchanges_no_postings(spark, tmp_path, monkeypatch):
    """Rows go to their files once and are numbered there, in the order of buckets and keys; so do postings."""
    rng = random.Random(11)
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.replace_files(rows_of(spark, rng, ["f0"])[0], "/p")
    first = store.state["last_id"]
    df, rows = rows_of(spark, rng, [f"f{i}" for i in range(1, 40)])
    refuse = lambda *a, **b: pytest.fail("rows are moved once more")
    monkeypatch.setattr(ChunkStore, "staged", refuse)
    monkeypatch.setattr(type(df), "repartition", refuse)
    store.replace_files(df, "/p")
    monkeypatch.undo()
    own = store._stored().where(F.col("chunk_id") > first).orderBy("chunk_id").select("bucket", "chunk_key").collect()
    assert own == sorted(own) and len(own) == len(rows)
    assert store.state["last_id"] == store.read().agg(F.max("chunk_id")).first()[0]
    met = store.postings(WORDS)
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, bm25.postings(store.read()).select(*met.columns).where(F.col("term").isin(WORDS)).collect()))


def test_a_batch_looks_its_hits_up(spark, tmp_path):
    """Texts of the hits only are read: their ids go to the scan."""
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.replace_files(rows_of(spark, random.Random(12), [f"f{i}" for i in range(30)])[0], "/p")
    found = search.batch(store.read(), [("alpha of", [1.0] * 8), ("delta", [0.5, -1.0] * 4)], SearchOptions(limit=3), stored=store)
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [part for part in plan.split("\n\n") if "Scan parquet" in part and "content" in part.split("ReadSchema")[-1]]
    assert scans and all("chunk_id" in part.split("PushedFilters")[-1].split("ReadSchema")[0] and "In(chunk_id" in part for part in scans)


def test_texts_are_not_sorted_to_meet_their_vectors(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(registry, "HASHED", 0)
    rows = registry.corpus(spark, sf_dir, whole=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, registry.corpus(spark, sf_dir).collect()))


def test_blocks_hold_all_postings(spark, monkeypatch):
    monkeypatch.setattr(bm25, "GROUP", 30)
    monkeypatch.setattr(bm25, "BLOCK", 3)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 9)))) for i in [*range(40), 2**31 - 1, 2**31, 2**40 + 3]] + [(99, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string").repartition(3)
    want = sorted(map(tuple, bm25.postings(chunks).select("term", "chunk_id", "tf", "length").collect()))
    made = bm25.blocks(chunks)
    assert sorted(map(tuple, bm25.unpacked(made).select("term", "chunk_id", "tf", "length").collect())) == want and want
    assert max(len(r.ids) for r in made.collect()) == 3


def test_term_frequencies_are_those_of_postings(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))) for i in range(50)] + [(99, None), (100, " - "), (101, "É é_1 ٣ ")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string").repartition(3)
    want = bm25.document_frequencies(bm25.postings(chunks)).select("term", "df", "tf")
    made = bm25.term_frequencies(chunks)
    assert made.columns == want.columns and sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "transform(" not in plan  # nothing is looked up token by token


def test_terms_parts_agree(spark):
    terms = ["a", "é", "storage", "x" * 40, "9"]
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select("t", stores._part(F.col("t"))).collect()
    assert {r.t: r[1] for r in rows} == {t: stores.part_of(t) for t in terms}


def test_cells(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    named = rows.select(F.lit("/p").alias("project_root"), F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("relative_path"), F.lit(0).alias("start_byte"), F.lit(9).alias("end_byte"), F.lit(1).alias("start_line"), F.lit(0).alias("chunk_index"), F.lit("x").alias("content"), "embedding")
    store = ChunkStore(spark, str(tmp_path / "s"))
    assert store.near([1.0] * 64) is None
    store.upsert(named.where("vec_id % 10 < 8"))
    facts = store.train_cells(12)
    assert facts["n"] == 12 and facts["recall"] >= cells.RECALL
    store.upsert(named.where("vec_id % 10 >= 8"))  # vectors that come later go to the same cells
    have = {r.chunk_id: r.embedding for r in store.read().select("chunk_id", "embedding").collect()}
    ids, matrix = np.array(list(have)), np.array(list(have.values()), np.float64)
    assert len(ids) == 500
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    centroids, state = store._centroids(store.state), store.state
    own = (matrix @ centroids.T).argmax(1)
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        best = np.argsort(-(matrix @ matrix[i]))[:10]
        read = cells.nearest_cells(centroids, matrix[i], state["cells"]["probes"])
        hit, total = hit + np.isin(own[best], read).sum(), total + 10
    assert hit / total >= 0.9
    query = [float(x) for x in have[int(ids[0])]]
    near = store.near(query)
    assert sorted(r.chunk_id for r in near.collect()) == sorted(int(i) for i, c in zip(ids, own, strict=True) if c in cells.nearest_cells(centroids, np.array(query), state["cells"]["probes"]))
    assert "PartitionFilters: [cell" in near._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).replace("isnotnull(cell#", "cell#")
    exact = [tuple(r) for r in vector_search.top(store.read(), query, 500).select("chunk_id", "cosine").collect()]
    assert [tuple(r) for r in search.top_by_vector(store.read(), query, 500, FilterOptions(), store).select("chunk_id", "cosine").collect()] == exact  # cells hold too few: all are read
    assert search.top_by_vector(store.read(), query, 1, FilterOptions(), store).first().chunk_id == int(ids[0])


def test_listing_enters_no_ignored_folder(spark, tmp_path, monkeypatch):
    for path in ("a.py", "node_modules/x/y.js", "src/b.go", "src/.hidden/_c.py", "src/deep/er/d.txt", "build/out.o", ".git/HEAD", "x.log/e.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("text")
    seen = []
    listed = scan._driver_list
    monkeypatch.setattr(scan, "_driver_list", lambda spark, folder: seen.append(folder) or listed(spark, folder))
    rules = ["node_modules/", "build", "*.log"]
    want = ["a.py", "src/.hidden/_c.py", "src/b.go", "src/deep/er/d.txt"]
    assert sorted(r.relative_path for r in scan.listing(spark, str(tmp_path), rules).collect()) == want
    assert not any("node_modules" in f or "build" in f or ".git" in f or "x.log" in f for f in seen)
    assert sorted(r.relative_path for r in scan.listing(spark, str(tmp_path), rules, wide=0).collect()) == want
    again = scan.listing(spark, str(tmp_path), [*rules, "!build/out.o"]).collect()
    assert sorted(r.relative_path for r in again) == sorted([*want, "build/out.o"])
    assert {r.relative_path: r.content for r in scan.tree(spark, str(tmp_path), rules).collect()} == dict.fromkeys(want, b"text")
    assert [r.relative_path for r in scan.some(spark, str(tmp_path), ["a.py", "gone.py", "src", "build/out.o"], rules).collect()] == ["a.py"]


def test_a_batch_of_a_stream_is_applied_once(spark, tmp_path, monkeypatch):
    root, source = tmp_path / "tree", tmp_path / "events"
    root.mkdir(), source.mkdir()
    for name in ("a.py", "b.py", "c.py"):
        (root / name).write_text(f"def {name[0]}(): return '{name}'\n")
    e = Engine(spark, str(root), str(tmp_path / "store"), embedding.HashingEmbedder(16))
    first = e.index()
    assert first["files"] == 3 and e.store.state["receipts"][e.project]["digest"] == first["digest"]
    (root / "a.py").write_text("def changed(): return 1\n")
    (root / "b.py").write_bytes(b"\x00\x01")  # no longer text
    (root / "c.py").write_text("never asked for\n")
    events = [("a.py", "write", 1), ("b.py", "write", 1)]
    (source / "1.json").write_text("\n".join(json.dumps({"path": p, "op": o, "ts": f"2024-01-01T00:00:0{t}Z"}) for p, o, t in events))
    stream = lambda: spark.readStream.schema("path string, op string, ts timestamp").json(str(source))
    monkeypatch.setattr(scan, "tree", lambda *a, **k: pytest.fail("a batch must not scan the tree"))
    e.watch(stream(), str(tmp_path / "cp"), tick=None).awaitTermination(120)
    have = {r.relative_path: r.content for r in e.chunks().collect()}
    assert set(have) == {"a.py", "c.py"} and "changed" in have["a.py"] and "never" not in have["c.py"]
    assert e.store.state["ledger"] == {str(tmp_path / "cp"): 0} and not e.store.proven(e.project)
    before = e.store.state
    assert not e.store.replace_files(e.chunks().drop("chunk_id"), e.project, batch=(str(tmp_path / "cp"), 0))
    assert e.store.state == before


def test_locations_of_nested_chunks(spark):
    rng = random.Random(5)
    spans = [(i, rng.choice(["a", "b"]), s := rng.choice([1, 2, 5, 64, 1000, 2**30]), s + rng.choice([0, 1, 7, 63, 64, 900, 2**20])) for i in range(300)]
    spans += [(900, "a", 10, 9), (901, "b", 1, 2**31 - 1)]
    chunks = spark.createDataFrame(spans, "chunk_id long, relative_path string, start_line int, end_line int")
    asked = sorted({(p, line) for p in "abc" for _, _, s, e in spans[:60] for line in (s - 1, s, s + 1, e, min(e + 1, 2**31 - 1))})
    got = {(r.relative_path, r.line): (r.span, r.chunk_id) for r in search.chunk_at(chunks, spark.createDataFrame(asked, "relative_path string, line int")).collect()}
    want = {}
    for p, line in asked:
        own = [(e - s, i) for i, q, s, e in spans if q == p and s <= line <= e]
        if own:
            want[p, line] = min(own)
    assert got == want and want


def test_mentions_of_many_targets_equal_those_of_one(spark, monkeypatch):
    from lodestrata.operators import graph
    monkeypatch.setattr(graph, "SLICE", 2)
    files = spark.createDataFrame([("x/a.ts", "import './util'; from '../lib/b'"), ("x/util.ts", "./a"), ("m.py", "import tools, util"), ("n.py", None), ("tools.py", "x"), ("x/c.js", "./util")], "relative_path string, content string")
    targets = ["x/util.ts", "lib/b.ts", "tools.py", "util.py", "main.go", "a.ts"]
    many = graph.imported_by_mentions(files, spark.createDataFrame([(t,) for t in targets], "relative_path string"))
    want = sorted((t, r.relative_path) for t in targets for r in graph.imported_by_mention(files, t).collect())
    assert sorted(map(tuple, many.collect())) == want and len(want) > 4


def test_requests_keep_their_budgets(spark):
    from lodestrata.operators import packing
    texts = ["a" * n for n in (1, 2, 0, 50, 3, 4, 9, 1, 1, 1, 1, 1)]
    spans = list(packing.requests(texts, 4, 10))
    assert [i for a, b in spans for i in range(a, b)] == list(range(len(texts))) and spans[1] == (3, 4)
    assert all(b - a <= 4 and (b - a == 1 or sum(map(len, texts[a:b])) <= 10) for a, b in spans)
    rows = spark.createDataFrame([(i, len(t)) for i, t in enumerate(texts * 9)], "k long, n long")
    got = packing.packed(rows, "k", F.col("n"), 4, 10).groupBy("request").agg(F.count("*").alias("c"), F.sum("size").alias("s"), F.max("size").alias("m")).collect()
    assert sum(r.c for r in got) == 12 * 9 and all(r.c <= 4 and (r.s <= 10 or r.s == r.m) for r in got)


def test_embedding_cache(spark, tmp_path):
    from datetime import datetime, timedelta

    from lodestrata.sources.cache import EmbeddingCache
    start = datetime(2024, 1, 1)
    at = lambda h: F.lit(start + timedelta(hours=h))
    rows = lambda pairs: spark.createDataFrame([(k, [float(v)]) for k, v in pairs], "cache_key string, embedding array<float>")
    cache, other = EmbeddingCache(spark, str(tmp_path / "c"), 3600 * 10), EmbeddingCache(spark, str(tmp_path / "o"))
    have = lambda h: {r.cache_key: r.embedding[0] for r in cache.entries(at(h)).collect()}
    assert have(0) == {}
    cache.add(rows([("a", 1), ("b", 2)]), at(0))
    cache.add(rows([("a", 3)]), at(5))
    assert have(6) == {"a": 3, "b": 2} and have(12) == {"a": 3} and have(20) == {}
    other.add(rows([("a", 9), ("z", 4)]), at(2))
    cache.merge_from(other)
    assert have(6) == {"a": 3, "b": 2, "z": 4} and {r.cache_key for r in cache.lookup(rows([("z", 0), ("q", 0)]), at(6)).collect()} == {"z"}
    cache.compact(at(11))
    assert len(cache.segments) == 1 and have(6) == {"a": 3, "z": 4}


def test_an_index_run_embeds_each_text_once_and_caches_it(spark, tmp_path):
    from lodestrata.sources.cache import EmbeddingCache

    class Counting(embedding.HashingEmbedder):
        def embed_documents(self, texts):
            with open(tmp_path / "asked", "a") as f:
                f.write("".join(f"{len(t)}\n" for t in texts))
            return super().embed_documents(texts)

    (tmp_path / "t").mkdir()
    for n in range(4):
        (tmp_path / "t" / f"f{n}.txt").write_text(f"text of file {n % 3}")
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    asked = lambda: len((tmp_path / "asked").read_text().split())
    assert Engine(spark, str(tmp_path / "t"), str(tmp_path / "s1"), Counting(8), cache=cache).index()["files"] == 4 and asked() == 3
    assert Engine(spark, str(tmp_path / "t"), str(tmp_path / "s2"), Counting(8), cache=cache).index()["files"] == 4 and asked() == 3


def test_memory_commands(spark, tmp_path, capsys):
    from lodestrata.cli import main
    (tmp_path / "t").mkdir()

    def run(*args):
        assert main(["--root", str(tmp_path / "t"), "--data", str(tmp_path / "s"), "memory", *args], spark) == 0
        return json.loads(capsys.readouterr().out)
    assert run("remember", "the cache is keyed by model", "--tags", "cache, design", "--importance", "0.9") == {"id": 1}
    assert run("remember", "lunch is at noon", "--ttl-hours", "5") == {"id": 2}
    found = run("recall", "how is the cache keyed", "--limit", "1")
    assert [r["id"] for r in found] == [1] and found[0]["tags"] == ["cache", "design"]
    assert run("recall", "cache", "--tags", "lunch") == [] and run("stats")["memories"] == 2
    with pytest.raises(ValueError):
        run("forget", "--tags", "design")
    with pytest.raises(ValueError):
        run("forget")
    assert run("forget", "--tags", "desi", "--confirm", "yes") == {"forgotten": 1} and run("forget", "--expired") == {"forgotten": 0}
    assert run("forget", "--id", "2") == {"forgotten": 1} and run("stats")["memories"] == 0
