"""Connected components by repeated contraction of written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stage


def components(edges: DataFrame) -> DataFrame:
    """Map every node of ``edges(a, b)`` to one node of its component: ``(node, root)``.

    Each round hooks every node to its neighbour of least hash (itself included),
    follows hooks to the end of the chain once, and renames the ends of all edges.
    Hooking by hash instead of by id makes chains short whatever the ids are, so a
    constant share of the nodes goes in each round.  A node that owns a third of
    all edges is reduced map-side by ``min``; joins on it split when skewed.  Null
    nodes and loops are dropped.  No edges give no rows.
    """
    rest = edges.where("a <> b").select("a", "b").distinct()
    rest = stage(rest, "edges")
    labels = None
    while rest.take(1):
        both = rest.union(rest.select("b", "a"))
        low = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n")))
        own = F.struct(F.xxhash64("a"), F.col("a"))
        hook = both.groupBy("a").agg(low.alias("m")).select(
            F.col("a").alias("node"),
            F.when(F.col("m.h") < own["col1"], F.col("m.n")).otherwise(F.col("a")).alias("root"),
        )
        hook = _shorten(stage(hook, "hooks"))
        renamed = (
            rest.join(hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(hook.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        rest = stage(renamed, "edges")
        labels = hook if labels is None else stage(_through(labels, hook), "labels")
    if labels is None:
        return rest.select(F.col("a").alias("node"), F.col("a").alias("root"))
    return labels


def _through(labels: DataFrame, hook: DataFrame) -> DataFrame:
    """Follow one more hook from each label that has one."""
    more = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return labels.join(more, "root", "left").select(
        "node", F.coalesce("next", "root").alias("root")
    )


def _shorten(hook: DataFrame) -> DataFrame:
    """Follow hooks until every node points at the end of its chain."""
    while True:
        longer = stage(_through(hook, hook), "hooks")
        moved = (
            longer.withColumnRenamed("root", "to")
            .join(hook, "node")
            .where("root <> to")
            .take(1)
        )
        hook = longer
        if not moved:
            return hook
