"""Connected components by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplight.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every end of the edges (a, b); label is the smallest id reachable.

    Every round takes the smallest label next to each id and then the label of
    that label, so that long chains need a logarithm of their length in rounds.
    Rounds are staged; joins are between staged tables, so that an id with very
    many edges is a skewed partition that can be split.
    """
    sym = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select(F.col("b"), F.col("a")))
    sym = stage(sym.union(sym.select("id", F.col("id").alias("to"))).distinct(), "edges")
    labels = stage(sym.groupBy("id").agg(F.min("to").alias("label")), "labels")
    while True:
        near = sym.join(labels.select(F.col("id").alias("to"), "label"), "to").groupBy("id").agg(F.min("label").alias("near"))
        near = stage(near, "near")
        beyond = near.select(F.col("id").alias("near"), F.col("near").alias("label"))
        jumped = stage(near.join(beyond, "near").select("id", F.col("label")), "labels")
        moved = jumped.join(labels.withColumnRenamed("label", "old"), "id").filter("label != old").limit(1).count()
        labels = jumped
        if not moved:
            return labels
