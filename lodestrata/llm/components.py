"""Connected components by rounds of hooking and pointer jumping, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a and b of one orderable type): root is the
    smallest node that can be reached. Self-links and repeated links do no harm.

    In a round every node hooks to its smallest neighbour, hooks are followed to their ends by
    repeated squaring, and the links are drawn anew between the ends. Hooks only lead to smaller
    nodes, so no cycle can form, and each round at least halves the number of ends that still have
    links. Minimums combine before the shuffle, so a node with very many links is no burden.
    """
    both = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(both, "cc-links")
    roots = None
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
        hook = _followed(materialize(ends, "cc-hooks"))
        if roots is None:
            merged = hook
        else:
            after = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            merged = roots.join(after, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        merged = materialize(merged, "cc-roots")
        of = lambda side: hook.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
        moved = edges.join(of("a"), "a").join(of("b"), "b").where("ra <> rb")
        fewer = materialize(moved.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "cc-links")
        for old in (edges, hook, roots):
            discard(old)
        edges, roots = fewer, merged
    if roots is None:
        roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def _followed(hook: DataFrame) -> DataFrame:
    """Replace every node's hook by the end of its chain of hooks."""
    while True:
        onward = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = hook.join(onward, "root").select("node", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved"))
        step = materialize(step, "cc-jumps")
        done = step.where("moved").isEmpty()
        discard(hook)
        out = step.select("node", "root")
        out._scratch_path = step._scratch_path
        if done:
            return out
        hook = out
