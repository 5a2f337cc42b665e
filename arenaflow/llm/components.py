"""Distributed union-find: connected components by repeated contraction.

In every round each vertex points to the smallest vertex in its closed
neighbourhood, under an order that changes from round to round, and edges are
redrawn between the vertices pointed to.  About half of the vertices of a
component or more vanish in a round, whatever its shape, so the edge tables
shrink and the number of rounds follows the logarithm of the largest component.
Minima are combined before every shuffle, so the centre of a large star is no
hot spot.  The pointers are put together from the last, smallest round back.
Once no more than ``FEW`` edges are left, a round is one task without a shuffle or a broadcast.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenaflow.llm.frames import stored


#: Edges that one task contracts; a fixed number, whatever the input.
FEW = 1 << 16


def _gathered(frame: DataFrame, few: bool) -> DataFrame:
    return frame.coalesce(1) if few else frame


def _joined(frame: DataFrame, other: DataFrame, on: str, how: str = "inner", few: bool = False) -> DataFrame:
    """Few rows meet inside their task: a broadcast would be a job and a table on the driver for each."""
    return frame.join(other.hint("shuffle_hash") if few else other, on, how)


def _simple(edges: DataFrame, left: str, right: str) -> DataFrame:
    return edges.where(F.col(left) != F.col(right)).select(
        F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``vertex, root`` for every vertex (a long) with an edge to another one; a root is one of its vertices.

    Edges with a null end and loops are left out; no edges give an empty table.
    """
    draw = random.Random(42)
    current = stored(_simple(edges, left, right), "edges")
    steps: list[tuple[DataFrame, bool]] = []
    while count := current.count():
        few = count <= FEW
        turn = F.lit(draw.getrandbits(63))
        both = _gathered(current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b"))), few)
        lowest = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(turn)).alias("low"))
        step = stored(lowest.select(
            F.col("a").alias("vertex"),
            F.least("low", F.col("a").bitwiseXOR(turn)).bitwiseXOR(turn).alias("root")), "pointers")
        steps.append((step, few))
        pointers = _gathered(step, few)
        near = _joined(_gathered(current, few), pointers.select(F.col("vertex").alias("a"), F.col("root").alias("a2")), "a", few=few)
        far = _joined(near, pointers.select(F.col("vertex").alias("b"), F.col("root").alias("b2")), "b", few=few)
        current = stored(_simple(far.select("a2", "b2"), "a2", "b2"), "edges")
    if not steps:
        return current.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    step, few = steps.pop()
    labels = _gathered(step, few)
    while steps:
        later = labels.select(F.col("vertex").alias("root"), F.col("root").alias("last"))
        step, few = steps.pop()
        labels = _joined(_gathered(step, few), later, "root", "left", few).select(
            "vertex", F.coalesce("last", "root").alias("root"))
    return labels
