"""Connected components by alternating large-star and small-star steps.

Published method: Kiveris et al., "Connected Components in MapReduce and
Beyond" (SoCC 2014).  Each step is a map-side combined minimum per vertex and a
join; the number of rounds grows with the logarithm of the component size, not
with its diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenaflow.session import cut_lineage


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Label every vertex that has an edge with the smallest vertex it reaches.

    Returns ``vertex, component``.  Vertices without edges are their own
    component and are left to the caller.  Vertices may be any orderable type.
    Every round lowers the sum of a forest's labels until all are stars; a round
    that changes nothing before that is an error.
    """
    current = cut_lineage(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where("u <> v").distinct()
    )
    while True:
        small = cut_lineage(_small_star(_large_star(current)))
        if _is_star_forest(small):
            return small.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
                small.select(F.col("v").alias("vertex"), F.col("v").alias("component"))
            ).distinct()
        if current.exceptAll(small).isEmpty() and small.exceptAll(current).isEmpty():
            raise RuntimeError("components do not settle")
        current = small


def _is_star_forest(edges: DataFrame) -> bool:
    """Every vertex is either the centre of a star or a leaf with one edge."""
    roles = edges.select(F.col("u").alias("vertex"), F.lit(1).alias("leaf")).unionByName(
        edges.select(F.col("v").alias("vertex"), F.lit(0).alias("leaf")).distinct()
    )
    return roles.groupBy("vertex").agg(
        F.sum("leaf").alias("leaf_edges"), F.min("leaf").alias("lowest_role")
    ).where("leaf_edges > 1 OR (leaf_edges = 1 AND lowest_role = 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex links its larger neighbours to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("low"))
    return (
        both.join(lowest, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("low", F.col("u")).alias("v"))
        .where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex links its smaller neighbours, and itself, to the smallest one."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("low"))
    joined = edges.join(lowest, "u")
    return (
        joined.select(F.col("v").alias("u"), F.col("low").alias("v"))
        .unionByName(lowest.select("u", F.col("low").alias("v")))
        .where("u <> v").distinct()
    )
