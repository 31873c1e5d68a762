"""Connected components of an edge table, by alternating star contractions in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Up to so many edges a round is dealt to one task for each ``TASK_EDGES``; beyond, the session's partitions and skew handling take over.
FEW_EDGES, TASK_EDGES = 400_000, 25_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) of two whole numbers -> (node, root): root is the smallest node that can be reached; only nodes with an edge.

    Each round links every node's larger neighbours to its smallest one (large star), then every node's smaller neighbours to the
    smallest (small star). Both aggregate before they join, and a round's result is checkpointed, so that the lineage stays short.
    A hub's edges are only ever grouped through a map-side minimum and joined by the node, which skew handling can split.
    """
    now = common.checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if not n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if (n, total) == seen:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = (n, total)
        dealt = (lambda df: df.repartition(-(-n // TASK_EDGES), "u")) if n <= FEW_EDGES else (lambda df: df)  # noqa: B023
        both = dealt(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = dealt(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = dealt(small).distinct()
        now = common.checkpointed(small)
    raise RuntimeError("components did not settle")
