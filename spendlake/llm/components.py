"""Connected components of an edge table by smallest labels with pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a, b``, not null): the smallest node that
    can be reached. Each round takes the smallest label among a node's neighbours and then
    its label's label, so the number of rounds grows with the logarithm of the longest path.
    Rounds are written to the shared folder; an edge table without rows gives none."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near")))
        met = written(labels.join(near, F.col("node") == F.col("a"))
                      .select("node", "label", F.least("label", "near").alias("to")), "labels")
        jump = met.select(F.col("node").alias("at"), F.col("to").alias("next"))
        new = written(met.join(jump, F.col("to") == F.col("at"), "left")
                      .select("node", F.col("label").alias("old"), F.least("to", F.coalesce("next", "to")).alias("label")), "labels")
        if new.filter("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
