"""Connected components of a graph given as edges, by smallest labels with pointer jumping, a stored table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import written


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, comp) for every node with an edge; comp is the smallest node of its component.

    Each round a node takes the smallest label among its neighbours', then the label of that label, so the rounds grow
    with the logarithm of a component's diameter rather than the diameter. Minima are combined before the shuffle.
    """
    both = written(edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
                   .unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("comp")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = lower.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("far")), "comp")
        new = written(jump.select("node", "was", F.least("comp", "far").alias("comp")), "labels")
        changed = new.where("comp <> was").limit(1).count()
        labels = new.drop("was")
        if not changed:
            return labels
