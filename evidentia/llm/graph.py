"""Connected components over links between 64-bit nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is the smallest node that can be reached.

    Each round takes the smallest root among the neighbours, then the root of
    that root, so a chain halves per round. Minima are combined before the
    shuffle, and each round is written to the shared folder, which cuts the
    lineage. No links give no rows; loops and repeated links do no harm.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage(both, "links")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    roots = stage(roots.select("node", F.least("node", "root").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        met = roots.join(near, "node").select("node", F.least("root", "near").alias("met"), F.col("root").alias("was"))
        step = met.join(roots.select(F.col("node").alias("met"), F.col("root").alias("further")), "met")
        step = stage(step.select("node", F.least("met", "further").alias("root"), (F.col("was") > F.least("met", "further")).alias("moved")), "roots")
        moved = step.filter("moved").limit(1).count()
        roots = step.select("node", "root")
        if not moved:
            return roots
