"""Connected components, within a task and on the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest vertex of each vertex's component, for edges i-j among n vertices."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)  # hook the roots as well, so that labels travel in jumps
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every vertex of ``edges`` (columns a, b): the smallest vertex that edges reach.

    Labels take the smallest label of the neighbours and then that label's own label, until nothing changes; the jumps
    make the number of rounds logarithmic in the length of chains.  Each round is written to the shared folder, which
    cuts the lineage.  Aggregations combine before the shuffle, so a vertex with very many edges is no hot spot.
    """
    edges = edges.filter("a <> b")
    both = scratch.table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.table(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("low"))
        hooked = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("component").alias("old"), F.least("component", "low").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("far"))
        new = scratch.table(hooked.join(jump, "new", "left").select("id", "old", F.least("new", "far").alias("component")), "labels")
        changed = new.filter("old <> component").limit(1).count()
        scratch.drop(labels)
        labels = new.drop("old")
        if not changed:
            return labels
