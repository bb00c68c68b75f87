"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges: (a, b), any order, repeats allowed. Returns (id, component): the smallest id reachable, for every id with an edge.

    Each round takes the least label among neighbours, then the label of the label; rounds grow with the
    logarithm of the longest path. Labels are written to the shared folder after each round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.keep(both, f"{name}-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), f"{name}-0")
    n = 0
    while True:
        n += 1
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("_cc_near"))
        hooked = labels.join(near, "id").select("id", "component", F.least("component", "_cc_near").alias("_cc_new"))
        up = labels.select(F.col("id").alias("_cc_new"), F.col("component").alias("_cc_up"))
        out = hooked.join(up, "_cc_new").select("id", F.least("_cc_new", "_cc_up").alias("component"), (F.least("_cc_new", "_cc_up") < F.col("component")).alias("moved"))
        out = scratch.keep(out, f"{name}-{n}")
        moved = not out.where("moved").isEmpty()
        scratch.drop(f"{name}-{n - 1}")
        labels = out.select("id", "component")
        if not moved:
            scratch.drop(f"{name}-edges")
            return labels
