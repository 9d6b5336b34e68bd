"""Answers of a symbol graph applied to searches, and related files without one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import go_import, js_import, python_import, required, trimmed

RERANK_WEIGHT = 0.15
#: Different needles that go out to the tasks at once.
SLICE = 100_000

# ---- fixed values: names that overviews and related files look for

ENTRY_POINTS = [
    "main.go", "cmd/*/main.go", "cmd/*/*.go", "index.js", "index.ts", "src/index.js", "src/index.ts", "src/main.js", "src/main.ts",
    "app.py", "main.py", "__main__.py", "src/main.rs", "src/lib.rs", "Cargo.toml", "package.json", "go.mod", "pyproject.toml", "setup.py",
]
KEY_FILES = [
    "README.md", "README.rst", "README.txt", "LICENSE", "LICENSE.md", "CONTRIBUTING.md", "CHANGELOG.md", "Makefile", "Dockerfile",
    "docker-compose.yml", "docker-compose.yaml", ".env.example", "config.yaml", "config.yml", "config.json",
]
CONFIG_FILES = ["config.yaml", "config.yml", "config.json", ".env", "settings.yaml", "settings.json"]
TEST_PATHS = ["{dir}{stem}_test{ext}", "{dir}{stem}.test{ext}", "{dir}{stem}.spec{ext}", "{dir}__tests__/{base}", "{dir}tests/test_{base}", "{dir}tests/{stem}_test{ext}"]
SKIPPED_DIRECTORIES = ["node_modules", "vendor", "dist", "build", "target", "__pycache__"]


def hub_scores(hotspots: DataFrame) -> DataFrame:
    """(symbol_name, hub): in-degree, shared out among symbols of one name; the largest by name."""
    own = F.when(F.col("shared_name") > 1, F.col("in_degree") / F.col("shared_name")).otherwise(F.col("in_degree").cast("double"))
    return hotspots.groupBy(F.col("symbol").alias("symbol_name")).agg(F.max(own).alias("hub"))


def reranked(hits: DataFrame, hotspots: DataFrame, weight: float = RERANK_WEIGHT) -> DataFrame:
    """Hits (chunk_id, symbol_name, score) with ``structural_score`` and the blended ``final_score``."""
    hubs = hub_scores(hotspots)
    most = hubs.agg(F.greatest(F.max("hub"), F.lit(1.0)).alias("__most"))
    met = hits.join(hubs, "symbol_name", "left").crossJoin(F.broadcast(most))  # one row
    structural = F.coalesce(F.col("hub"), F.lit(0.0)) / F.coalesce("__most", F.lit(1.0))
    out = met.withColumn("structural_score", F.round(structural, 6)).withColumn("final_score", F.round(F.col("score") * (1 - weight) + structural * weight, 6))
    return out.drop("hub", "__most").orderBy(F.desc("final_score"), "chunk_id")


def impact_files(nodes: DataFrame) -> DataFrame:
    """(file, is_test) of a symbol's blast radius (kind definition, caller or test; file; ord), the
    definition first, then by order of mention."""
    return nodes.groupBy("file").agg(F.min("ord").alias("ord"), F.min(F.col("role") == "test").alias("is_test")).orderBy("ord", "file")


def in_scope(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of the files (column ``relative_path``)."""
    return chunks.join(files.select("relative_path"), "relative_path", "left_semi")


def resolve_scope(files: list[str], symbol: str, affected: list[str] | None) -> tuple[list[str] | None, str]:
    """Files to search in and a note: explicit files win over a symbol; a symbol that the graph does
    not know gives no scope."""
    if files:
        return files, f"scope: {len(files)} given files"
    if symbol:
        return (affected, f"scope: {len(affected)} files affected by {symbol}") if affected else (None, f"no scope: {symbol} is not in the graph")
    return None, "no scope"


# ---- related files


def _ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def imports(files: DataFrame) -> DataFrame:
    """(relative_path, import) of files (relative_path, content), by extension. A Go import block
    lasts until its closing parenthesis; whether a line is inside is a running count over its file."""
    lines = files.select("relative_path", _ext(F.col("relative_path")).alias("ext"), F.posexplode(F.split("content", "\n", -1)).alias("no", "raw")).withColumn("line", trimmed(F.col("raw")))
    starts, line = F.col("line").startswith, F.col("line")
    opens = (F.col("ext") == ".go") & line.startswith("import (")
    closes = (F.col("ext") == ".go") & (line == ")")
    order = Window.partitionBy("relative_path").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.last(F.when(opens, F.lit(True)).when(closes, F.lit(False)), ignorenulls=True).over(order)
    go = lines.where("ext = '.go'").withColumn("inside", F.coalesce(mark, F.lit(False))).where(~opens & ~closes)
    of_go = go.select("relative_path", "no", F.when(F.col("inside"), go_import(line)).when(starts("import "), go_import(F.substring(line, 8, 1 << 20))).alias("import"))
    head = starts("import ") | starts("from ")
    js = lines.where(F.col("ext").isin(".js", ".ts", ".jsx", ".tsx"))
    of_js = js.where(head).select("relative_path", "no", js_import(line).alias("import")).unionByName(js.where(F.contains("line", F.lit("require("))).select("relative_path", "no", required(line).alias("import")))
    of_py = lines.where("ext = '.py'").where(head).select("relative_path", "no", python_import(line).alias("import"))
    return of_go.unionByName(of_js).unionByName(of_py).where("import is not null and import <> ''").select("relative_path", "import")


def imported_by_suffix(imported: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, relative_path): files one of whose imports is the target's directory or ends with it.
    Every import is cut at its slashes, so that suffixes meet directories in an equi-join; test files
    and the target itself do not count."""
    parts = F.split("import", "/")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))
    cut = imported.where(~F.col("relative_path").endswith("_test.go")).select("relative_path", F.explode(suffixes).alias("directory"))
    wanted = targets.select(F.col("relative_path").alias("target"), F.regexp_replace("relative_path", "/?[^/]*$", "").alias("directory"))
    return cut.join(wanted, "directory").where("relative_path <> target").select("target", "relative_path").distinct()


def imported_by_mention(files: DataFrame, target: str) -> DataFrame:
    """Files of the target's language whose text mentions how it would be imported."""
    base = target.rsplit("/", 1)[-1]
    stem, _, ext = base.rpartition(".")
    directory = target.rsplit("/", 2)[-2] if "/" in target else "."
    ext = f".{ext}".lower()
    needles = [f"./{stem}", f"../{directory}/{stem}"] if ext in (".js", ".ts", ".jsx", ".tsx") else [stem] if ext == ".py" else []
    hit = F.lit(False)
    for x in needles:
        hit = hit | F.contains("content", F.lit(x))
    return files.where((_ext(F.col("relative_path")) == ext) & (F.col("relative_path") != target) & hit).select("relative_path")


def needles(targets: DataFrame) -> DataFrame:
    """(target, group, needle): how each target (relative_path) would be written where it is imported."""
    path = F.col("relative_path")
    base = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    directory = F.when(F.contains(path, F.lit("/")), F.element_at(F.split(path, "/"), -2)).otherwise(F.lit("."))
    ways = F.when(_group(path) == "js", F.array(F.concat(F.lit("./"), stem), F.concat(F.lit("../"), directory, F.lit("/"), stem))).when(_group(path) == "py", F.array(stem))
    return targets.select(path.alias("target"), _ext(path).alias("group"), F.explode(ways).alias("needle"))


def _group(path: Column) -> Column:
    return F.when(_ext(path).isin(".js", ".ts", ".jsx", ".tsx"), "js").when(_ext(path) == ".py", "py")


def imported_by_mentions(files: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, relative_path): as ``imported_by_mention`` for many targets (relative_path) in one pass over
    the texts: an automaton finds all their needles at once. It goes out in slices of ``SLICE`` different
    needles, one of which a worker holds at a time; what it finds meets its targets in a join."""
    import ahocorasick

    wanted = needles(targets)
    context, slices, part = files.sparkSession.sparkContext, [], []
    for row in wanted.select("needle").distinct().orderBy("needle").toLocalIterator():
        part.append(row[0])
        if len(part) == SLICE:
            slices.append(context.broadcast(part))
            part = []
    slices += [context.broadcast(part)] if part else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, now = None, None
        for batch in batches:
            for no, words in enumerate(slices):
                if now != no:
                    automaton, now = ahocorasick.Automaton(), no
                    for w in words.value:
                        automaton.add_word(w, w)
                    automaton.make_automaton()
                paths, found = [], []
                for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = {w for _, w in automaton.iter(text or "")}
                    paths += [path] * len(own)
                    found += sorted(own)
                yield pa.record_batch({"relative_path": pa.array(paths, pa.string()), "needle": pa.array(found, pa.string())})

    if not slices:
        return wanted.select("target", F.col("needle").alias("relative_path")).where("false")
    texts = files.where(_group(F.col("relative_path")).isNotNull()).select("relative_path", "content")
    hits = texts.mapInArrow(run, "relative_path string, needle string").withColumn("group", _ext(F.col("relative_path")))
    return hits.join(wanted, ["needle", "group"]).where("relative_path <> target").select("target", "relative_path").distinct()


def candidates(target: str) -> list[tuple[str, str]]:
    """(relationship, path) of tests and configurations that a file may have."""
    directory, slash, base = target.rpartition("/")
    stem, dot, ext = base.rpartition(".")
    stem, ext = (stem, dot + ext) if dot else (base, "")
    fill = {"dir": directory + slash, "stem": stem, "ext": ext, "base": base}
    return [("test", t.format(**fill)) for t in TEST_PATHS] + [("config", directory + slash + c) for c in CONFIG_FILES]


def related_files(files: DataFrame, target: str, graph: DataFrame | None = None) -> DataFrame:
    """(relative_path, relationship): what the graph says if it has indexed the file, be it nothing;
    or else imports, importers, tests and configurations."""
    if graph is not None:
        return graph.select("relative_path", F.col("reason").alias("relationship"))
    spark = files.sparkSession
    own = imports(files.where(F.col("relative_path") == target)).select(F.col("import").alias("relative_path"), F.lit("imports").alias("relationship"))
    if target.endswith(".go"):
        spot = spark.createDataFrame([(target,)], "relative_path string")
        users = imported_by_suffix(imports(files), spot).select("relative_path")
    else:
        users = imported_by_mention(files, target)
    wanted = F.broadcast(spark.createDataFrame(candidates(target), "relationship string, relative_path string"))  # a dozen rows
    there = files.select("relative_path").join(wanted, "relative_path")
    return own.unionByName(users.withColumn("relationship", F.lit("imported_by"))).unionByName(there.select("relative_path", "relationship")).distinct()


# ---- overview


def entry_points(files: DataFrame, limit: int = 10) -> DataFrame:
    """(relative_path, ord) of entry points, in the order of the patterns, each once."""
    from ..functions.text import glob_regex

    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(ENTRY_POINTS))):
        rank = F.when(F.col("relative_path").rlike(glob_regex(p)), F.lit(i)).otherwise(rank)
    return files.select("relative_path", rank.alias("ord")).where("ord is not null").orderBy("ord", "relative_path").limit(limit)


def key_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("relative_path").isin(KEY_FILES)).select("relative_path").orderBy("relative_path")


def directory_tree(files: DataFrame, depth: int = 3, width: int = 15) -> DataFrame:
    """(parent, name, is_dir, level): directories first, hidden and vendored ones left out, at most
    ``width`` entries of each directory."""
    parts = F.split("relative_path", "/")
    levels = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth)))
    entry = lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("parent"), F.get(parts, i - 1).alias("name"), (i < F.size(parts)).alias("is_dir"), i.alias("level"))
    shown = ~F.exists(parts, lambda p: p.startswith(".") | p.isin(SKIPPED_DIRECTORIES))
    rows = files.where(shown).select(F.explode(F.transform(levels, entry)).alias("e")).select("e.*").distinct()
    order = Window.partitionBy("parent").orderBy(F.desc("is_dir"), "name")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= width).drop("n").orderBy("level", "parent", F.desc("is_dir"), "name")
