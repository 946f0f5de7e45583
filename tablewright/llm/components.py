"""Connected components of a table of links, by contraction.

Up to ``ONE_TASK`` links, a number that is counted first, are joined by union-find in
one task. Beyond it, each round points every node at its smallest neighbour (or at itself),
follows the pointers to their ends by doubling, and replaces the nodes of the
remaining links by these ends. At most half of a component's nodes are ends, so
the rounds are logarithmic; a hot node is aggregated before its shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import keep

#: Links that one task joins at most: 16 bytes each, so a few megabytes.
ONE_TASK = 300_000


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        a, b = (table[c].to_numpy() for c in ("a", "b"))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(nodes)))

        def end(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            x, y = end(x), end(y)
            parent[max(x, y)] = min(x, y)
        return pa.table({"node": nodes, "label": nodes[[end(x) for x in range(len(nodes))]]})

    return keep(links.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(run, "node long, label long"), "components")


def _ends(parents: DataFrame) -> DataFrame:
    """Follow ``node -> parent`` to the ends, by doubling."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
        doubled = keep(parents.join(up, "parent").select("node", F.col("further").alias("parent"), (F.col("further") != F.col("parent")).alias("moved")), "components")
        parents = doubled.select("node", "parent")
        if not doubled.filter("moved").head(1):
            return parents


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``node, label`` of every node in ``links`` (columns ``a`` and ``b``); the
    label is the smallest node of the component. Self-links, repeated and null
    links do no harm; no links give no rows."""
    links = keep(links.select("a", "b").filter("a <> b").distinct(), "components")
    if links.count() <= one_task:
        return _in_one_task(links)
    labels = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("parent")), "components")
        ends = _ends(parents)
        if labels is None:
            labels = ends.select("node", F.col("parent").alias("label"))
        else:
            labels = keep(
                labels.join(ends.select(F.col("node").alias("label"), "parent"), "label", "left")
                .select("node", F.coalesce("parent", "label").alias("label")), "components")
        up = ends.select("node", "parent")
        links = keep(
            links.join(up.withColumnsRenamed({"node": "a", "parent": "pa"}), "a")
            .join(up.withColumnsRenamed({"node": "b", "parent": "pb"}), "b")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .filter("a <> b").distinct(), "components")
        if not links.head(1):
            return labels
