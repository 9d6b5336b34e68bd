"""What has changed between the files that are and the files that are indexed; what state follows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compared(current: DataFrame, indexed: DataFrame, hash_col: str = "source_hash") -> DataFrame:
    """(relative_path, status): new, modified, deleted or same."""
    met = current.select("relative_path", F.col(hash_col).alias("now")).join(indexed.select("relative_path", F.col(hash_col).alias("then")), "relative_path", "full_outer")
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "modified").otherwise("same")
    return met.select("relative_path", status.alias("status"))


def pending(current: DataFrame, indexed: DataFrame, hash_col: str = "source_hash") -> DataFrame:
    """One row: new_files, modified_files, deleted_files, total_pending."""
    row = compared(current, indexed, hash_col).agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_files") for s in ("new", "modified", "deleted")])
    return row.withColumn("total_pending", F.col("new_files") + F.col("modified_files") + F.col("deleted_files"))


def to_index(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """The files whose path and hash are not both indexed."""
    return current.join(indexed.select("relative_path", "file_hash"), ["relative_path", "file_hash"], "left_anti")


def feed(files: DataFrame, indexed: DataFrame, paths: list[str], full: bool = False) -> DataFrame:
    """Files with ``wanted``, whether they are to be indexed; only those keep their content. Written
    once, this is what a run works from, whatever happens to the files meanwhile."""
    same = indexed.select("relative_path", "file_hash").distinct().withColumn("__same", F.lit(True))
    met = files.join(same, ["relative_path", "file_hash"], "left")
    wanted = under(F.col("relative_path"), paths) & (F.lit(full) | F.col("__same").isNull())
    return met.withColumn("wanted", wanted).withColumn("content", F.when(F.col("wanted"), F.col("content"))).drop("__same")


def feed_digest(files: DataFrame, path: str = "relative_path", hash_col: str = "source_hash") -> DataFrame:
    """One row (files, digest): an order-independent digest of what a run works from, the sum of 60 bits of
    the SHA-256 of each path and hash. Two feeds differ if their digests do."""
    own = F.conv(F.substring(F.sha2(F.concat_ws("\x00", path, hash_col), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(own), F.lit(0)).cast("string").alias("digest"))


def to_prune(indexed: DataFrame, current: DataFrame, scan_complete: bool = True) -> DataFrame:
    """Indexed files that are gone. After an incomplete scan: none."""
    gone = indexed.join(current.select("relative_path"), "relative_path", "left_anti").orderBy("relative_path")
    return gone if scan_complete else gone.where("false")


def without_orphans(rows: DataFrame, valid: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return rows.join(valid.select(id_col), id_col, "left_semi")


def orphans(rows: DataFrame, valid: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Rows with a positive id that is not among the valid ones."""
    return rows.where(F.col(id_col) > 0).join(valid.select(id_col), id_col, "left_anti")


def under(path: Column, selected: list[str]) -> Column:
    """Equal to a selected path or below it; everything if none is selected."""
    if not selected:
        return F.lit(True)
    out = F.lit(False)
    for s in selected:
        out = out | (path == s.rstrip("/")) | path.startswith(s.rstrip("/") + "/")
    return out


def structural_hashes(files: DataFrame, structural: DataFrame) -> DataFrame:
    """Files with the indexing hash of those that structural chunks apply to (same path and source
    hash, some chunk), and their own otherwise."""
    good = structural.where("n_chunks > 0").select("relative_path", "source_hash", F.col("index_hash").alias("__h"))
    return files.join(good, ["relative_path", "source_hash"], "left").withColumn("file_hash", F.coalesce("__h", "file_hash")).drop("__h")


def missing_structural(files: DataFrame, structural: DataFrame) -> DataFrame:
    """Structural files that are not there with the same hash; indexing that requires structure must
    not begin unless this is empty."""
    return structural.join(files.select("relative_path", "source_hash"), ["relative_path", "source_hash"], "left_anti")


# ---- readiness


@dataclass(frozen=True)
class Readiness:
    state: str
    action: str
    blocks_search: bool


#: State, action, and whether searches must wait; the first whose condition holds counts.
_ACTIONS = {"empty": ("index", True), "profile_mismatch": ("index_force", True), "unknown": ("index_force", False), "stale": ("index", False), "ready": ("", False)}


def readiness_state(indexed: Column, fresh: Column, profile_matches: Column, freshness: Column) -> Column:
    return (F.when(~indexed, "empty").when(~profile_matches, "profile_mismatch").when(F.coalesce(freshness == "unknown", F.lit(False)), "unknown")
            .when(~fresh | F.coalesce(freshness == "stale", F.lit(False)), "stale").otherwise("ready"))


def readiness(facts: DataFrame) -> DataFrame:
    """Facts with state, action and blocks_search."""
    out = facts.withColumn("state", readiness_state(F.col("indexed"), F.col("fresh"), F.col("profile_matches"), F.col("freshness_state")))
    action, blocks = F.lit(""), F.lit(False)
    for state, (todo, blocked) in _ACTIONS.items():
        action = F.when(F.col("state") == state, todo).otherwise(action)
        blocks = F.when(F.col("state") == state, F.lit(blocked)).otherwise(blocks)
    return out.withColumn("action", action).withColumn("blocks_search", blocks)


def readiness_of(indexed: bool, fresh: bool, profile_matches: bool, freshness: str | None = None) -> Readiness:
    if not indexed:
        state = "empty"
    elif not profile_matches:
        state = "profile_mismatch"
    elif freshness == "unknown":
        state = "unknown"
    else:
        state = "stale" if not fresh or freshness == "stale" else "ready"
    return Readiness(state, *_ACTIONS[state])


def profile_matches(stored: dict, active: dict) -> bool:
    """Two embedding profiles are the same if all fields are."""
    return stored == active


def profile_id(profile: dict) -> str:
    """Schema, provider, model, dimensions, distance, modality and preprocessor, joined; hashes of
    templates and options follow where there are any."""
    import hashlib
    import json

    names = ("schema_version", "provider", "model", "dimensions", "distance", "modality", "preprocessor")
    parts = [str(profile.get(n, "")) for n in names]
    parts += [hashlib.sha256(json.dumps(profile[n], sort_keys=True).encode()).hexdigest() for n in ("templates", "options") if profile.get(n)]
    return ":".join(parts)
