"""Connected components as joins over small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends and
    contracts the links, so what is left shrinks at least by half. Minima are summed up map-side, so
    a node with very many links is no hot key; joins go between written tables, which adaptive
    execution can split. The driver sees only whether links are left.
    """
    links = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = written(links.distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
            .select("node", F.least("node", "low").alias("up")), "hooks")
        while True:
            above = hooks.filter("node <> up").select(F.col("node").alias("up"), F.col("up").alias("up2"))
            step = hooks.join(above, "up", "left").select("node", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved"))
            step = written(step, "hooks")
            moved = not step.filter("moved").isEmpty()
            hooks = step.select("node", "up")
            if not moved:
                break
        end = lambda c: hooks.select(F.col("node").alias(c), F.col("up").alias(f"{c}2"))
        links = written(
            links.join(end("a"), "a").join(end("b"), "b").filter("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
        if labels is None:
            labels = hooks
        else:
            top = hooks.select(F.col("node").alias("up"), F.col("up").alias("up2"))
            labels = written(labels.join(top, "up", "left").select("node", F.coalesce("up2", "up").alias("up")), "labels")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("up").alias("component"))
