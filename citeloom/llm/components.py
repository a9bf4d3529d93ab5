"""Connected components of an edge table, by smallest label with pointer jumping; stored between rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import dropped, stored


def tree_edges(linked: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join trees, of a matrix of links between rows ``left`` and ``right``.

    ``label`` has each row's tree and is kept up to date: over all calls there is one edge less than
    rows in every tree.
    """
    out = []
    for k in np.flatnonzero(linked.any(1)):
        i, near = int(left[k]), right[linked[k]]
        trees, first = np.unique(label[near], return_index=True)
        for tree, at in zip(trees.tolist(), first.tolist(), strict=True):
            if tree != label[i]:
                out.append((i, int(near[at])))
                label[label == tree] = label[i]
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of ``edges`` (a, b): label is the smallest node of its component."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "cc-edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        low = labels.join(seen, F.col("node") == F.col("a")).select("node", F.least("label", "low").alias("low"), F.col("label").alias("was"))
        low = stored(low, "cc-low")
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("far"))
        after = stored(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), "was"), "cc-labels")
        moved = after.where("label <> was").limit(1).count()
        dropped(low, labels)
        labels = after
        if not moved:
            dropped(both)
            return labels.select("node", "label")
