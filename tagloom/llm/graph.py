"""Connected components of an edge table, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_round


def components(edges: DataFrame) -> DataFrame:
    """node, component of every node in edges (columns a, b: bigint); component is the smallest node reachable.

    Every round takes the smallest label among the neighbours and then the label of the label, so
    the number of rounds grows with the logarithm of a path's length in practice. Rounds are
    checkpointed. Null ends, loops and repeated edges are harmless; no edges give no rows.
    """
    # both directions come from one evaluation: edges may be computed from groups whose rows arrive in any order
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_round(edges.where("a is not null and b is not null and a <> b").select(F.explode(ends).alias("e")).select("e.a", "e.b").distinct())
    labels = cut_round(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        nearer = labels.join(heard, labels.node == heard.a).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        step = cut_round(nearer.join(jump, nearer.label == jump.via).select("node", "old", F.least("label", "further").alias("label")))
        if step.where("label <> old").limit(1).count() == 0:
            return step.select("node", F.col("label").alias("component"))
        labels = step.select("node", "label")
