"""Approximate nearest neighbours by low-dimensional stable projections in a kd-tree.

Vectors are projected onto a few random Gaussian directions.  A squared projected
distance, over the squared true one, follows a chi-square law with as many
degrees of freedom as there are directions.  A query visits the leaves of a
kd-tree over the projections, nearest first, and verifies their vectors by their
true measure.  It stops when the next leaf is so far that a vector better than
the worst one held would lie there with a chance below ``1 - confidence``.

Largest inner products become smallest distances by one more coordinate that
gives all vectors the same length.  Equal vectors are indexed once, with as many
of their smallest ids as a result can hold, so a vector that a third of all rows
share is one entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """``shard_rows`` vectors are one index; ``query_rows`` queries meet it in one task."""

    directions: int = 8
    confidence: float = 0.9
    leaf_rows: int = 64
    shard_rows: int = 8192
    query_rows: int = 2048
    spare: int = 8
    seed: int = 42


def chi_square_below(value: np.ndarray, degrees: int) -> np.ndarray:
    """Chance that a chi-square variable with an even number of degrees stays below ``value``."""
    half = np.asarray(value, dtype=float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for step in range(1, degrees // 2):
        term = term * half / step
        total = total + term
    return 1 - np.exp(-half) * total


class Tree:
    """Leaves of a kd-tree: rows of every leaf and the box around their projections."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        self.leaves: list[np.ndarray] = []
        open_ = [np.arange(len(points))]
        while open_:
            rows = open_.pop()
            spread = points[rows].max(axis=0) - points[rows].min(axis=0)
            if len(rows) <= leaf_rows or not spread.any():
                self.leaves.append(rows)
                continue
            order = rows[np.argsort(points[rows, spread.argmax()], kind="stable")]
            open_ += [order[:len(order) // 2], order[len(order) // 2:]]
        self.low = np.stack([points[rows].min(axis=0) for rows in self.leaves])
        self.high = np.stack([points[rows].max(axis=0) for rows in self.leaves])

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared projected distance of every query to every box, the least any row inside can have."""
        total = np.zeros((len(queries), len(self.leaves)))
        for axis in range(queries.shape[1]):
            value = queries[:, axis:axis + 1]
            total += np.maximum(np.maximum(self.low[:, axis] - value, value - self.high[:, axis]), 0) ** 2
        return total


def search(vectors: np.ndarray, queries: np.ndarray, wanted: int, longest: float, settings: Settings,
           ) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and inner products of the best ``wanted`` found for each query (-1 where there are fewer), ties to earlier rows.

    ``longest`` is the largest squared length of any vector of the collection.
    The third value counts verified pairs.
    """
    draw = np.random.default_rng(settings.seed)
    directions = draw.standard_normal((vectors.shape[1] + 1, settings.directions))
    lengths = (vectors ** 2).sum(axis=1)
    extra = np.sqrt(np.maximum(longest - lengths, 0))
    tree = Tree(vectors @ directions[:-1] + extra[:, None] * directions[-1], settings.leaf_rows)
    boxes = tree.distances(queries @ directions[:-1])
    order = np.argsort(boxes, axis=1, kind="stable")
    ranked = np.take_along_axis(boxes, order, axis=1)
    ends = longest + (queries ** 2).sum(axis=1)
    best = np.full((len(queries), wanted), -np.inf)
    rows = np.full((len(queries), wanted), -1)
    active = np.arange(len(queries))
    done, verified = 0, 0
    while len(active) and done < len(tree.leaves):
        upto = min(len(tree.leaves), max(4, 2 * done))
        asked = order[active, done:upto]
        for leaf in np.unique(asked):
            who = active[(asked == leaf).any(axis=1)]
            members = tree.leaves[leaf]
            products = queries[who] @ vectors[members].T
            verified += products.size
            worth = (products >= best[who, -1:]).any(axis=1)
            if not worth.any():
                continue
            who, products = who[worth], products[worth]
            values = np.concatenate([best[who], products], axis=1)
            places = np.concatenate([rows[who], np.broadcast_to(members, products.shape)], axis=1)
            # Of equal products the earlier rows stay.
            top = np.lexsort((places, -values), axis=1)[:, :wanted]
            best[who] = np.take_along_axis(values, top, axis=1)
            rows[who] = np.take_along_axis(places, top, axis=1)
        done = upto
        if done < len(tree.leaves):
            worst = np.maximum(ends[active] - 2 * best[active, -1], 1e-300)
            reach = np.where(np.isfinite(worst), ranked[active, done] / worst, 0.0)
            active = active[chi_square_below(reach, settings.directions) < settings.confidence]
    return rows, best, verified


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, finite in every component and not zero."""
    numbers = F.transform(vector, lambda value: value.cast("double"))
    bad = F.exists(numbers, lambda value: value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & ~bad & F.exists(numbers, lambda value: value != 0))


def nearest(vectors: DataFrame, queries: DataFrame, wanted: int = 20, key: str = "vec_id",
            vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """``query_id, rank, <key>, score`` of the largest inner products found for each query.

    A query never meets rows with its own id; equal scores go by the smaller
    id; vectors of another dimension than the query's take no part, nor do
    unusable ones or rows without an id.  Fewer candidates give fewer rows.
    """
    numbers = F.transform(vector, lambda value: value.cast("double"))
    length = F.aggregate(numbers, F.lit(0.0), lambda total, value: total + value * value)
    good = usable(vectors, vector).where(F.col(key).isNotNull()).select(key, F.col(vector).alias("_vector"))
    asked = usable(queries, vector).where(F.col(key).isNotNull()).select(key, F.col(vector).alias("_vector"))
    # Ranks below a constant are cut before the shuffle, so copies of one vector never gather.
    copies = Window.partitionBy("_vector").orderBy(key)
    unique = good.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= wanted + 1).groupBy(
        "_vector").agg(F.sort_array(F.collect_list(key)).alias("_ids"))
    total, longest = usable(vectors, vector).agg(F.count(F.lit(1)), F.max(length)).first()
    many = asked.count()
    shards = max(1, -(-total // settings.shard_rows))
    blocks = max(1, -(-many // settings.query_rows))
    size = F.size("_vector")
    indexed = unique.select(
        "_vector", "_ids", size.alias("_size"), F.pmod(F.xxhash64("_ids"), F.lit(shards)).alias("_shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    dealt = asked.select(
        key, "_vector", size.alias("_size"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("_shard"))
    largest = float(longest or 0.0)

    def solve(index: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_answers(index, block, wanted, key, largest, settings),
                            columns=["query_id", key, "score"]).astype(
            {"query_id": "int64", key: "int64", "score": "float64"})

    groups = ["_shard", "_block", "_size"]
    found = indexed.groupBy(*groups).cogroup(dealt.groupBy(*groups)).applyInPandas(
        solve, f"query_id long, `{key}` long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted).select(
        "query_id", "rank", key, "score")


def _answers(index: pd.DataFrame, block: pd.DataFrame, wanted: int, key: str, longest: float,
             settings: Settings) -> Iterator[tuple[int, int, float]]:
    if not len(index) or not len(block):
        return
    # Rows by their smallest id, so that ties go to it however many there are.
    index = index.iloc[np.argsort([own[0] for own in index["_ids"]], kind="stable")]
    vectors = np.stack(index["_vector"]).astype(np.float64)
    queries = np.stack(block["_vector"]).astype(np.float64)
    ids = index["_ids"].tolist()
    rows, _, _ = search(vectors, queries, wanted + 1 + settings.spare, longest, settings)
    for query, own, found in zip(queries, block[key].tolist(), rows):
        found = found[found >= 0]
        scores = (vectors[found] * query).sum(axis=1)
        pairs = sorted((-score, int(number)) for score, row in zip(scores.tolist(), found) for number in ids[row]
                       if number != own)
        for score, number in pairs[:wanted]:
            yield own, number, -score
