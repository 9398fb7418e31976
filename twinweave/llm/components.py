"""Connected components of an edge table by minimum labels and pointer jumping, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.operators import graph


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable by edges (a, b), for every node that has one."""
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()
    return graph.components(pairs).select(F.col("item_idx").alias("node"), F.col("component_id").alias("component"))
