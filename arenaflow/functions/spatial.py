"""Neighbourhood kernels in time and space that never enumerate a dense group's pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow.session import cut_lineage

#: Times that undecided pairs of cells are split, by ``SPLIT`` along every axis.
LEVELS = 3
SPLIT = 4


def _cells(points: DataFrame, group: list[str], gap: float, side: float, prefix: str) -> DataFrame:
    located = points.select("*", *_coordinates(gap, side))
    return located.groupBy(*group, "ct", "cx", "cy").agg(
        F.count("*").alias("n"), F.min("id").alias("member"),
        *[function(axis).alias(f"{name}_{axis}") for axis in ("t", "x", "y")
          for name, function in (("lo", F.min), ("hi", F.max))],
    ).select(*group, F.struct("ct", "cx", "cy", "n", "member", "lo_t", "hi_t", "lo_x", "hi_x", "lo_y", "hi_y")
             .alias(prefix))


def _coordinates(gap: float, side: float) -> list[Column]:
    return [F.floor(F.col("t") / gap).cast("bigint").alias("ct"),
            F.floor(F.col("x") / side).cast("bigint").alias("cx"),
            F.floor(F.col("y") / side).cast("bigint").alias("cy")]


def _apart(axis: str) -> Column:
    """Smallest possible distance of two boxes on one axis."""
    return F.greatest(F.lit(0.0), F.col(f"b.lo_{axis}") - F.col(f"a.hi_{axis}"),
                      F.col(f"a.lo_{axis}") - F.col(f"b.hi_{axis}"))


def _across(axis: str) -> Column:
    """Largest possible distance of two boxes on one axis."""
    return F.greatest(F.col(f"b.hi_{axis}") - F.col(f"a.lo_{axis}"), F.col(f"a.hi_{axis}") - F.col(f"b.lo_{axis}"))


def _decide(pairs: DataFrame, gap: float, distance: float) -> DataFrame:
    limit = F.lit(distance * distance)
    never = (_apart("t") > gap) | (_apart("x") * _apart("x") + _apart("y") * _apart("y") > limit)
    always = (_across("t") <= gap) & (_across("x") * _across("x") + _across("y") * _across("y") <= limit)
    return pairs.where(~never).withColumn("always", always)


def _children(points: DataFrame, group: list[str], gap: float, side: float) -> DataFrame:
    """Cells of this size, keyed by the cell ``SPLIT`` times as wide that they lie in."""
    return _cells(points, group, gap, side, "child").select(
        *group, *[F.floor(F.col(f"child.{axis}") / SPLIT).cast("bigint").alias(axis) for axis in ("ct", "cx", "cy")], "child")


def _keyed(pairs: DataFrame, side_name: str) -> DataFrame:
    return pairs.select("*", *[F.col(f"{side_name}.{axis}").alias(axis) for axis in ("ct", "cx", "cy")])


def band_edges(points: DataFrame, group: list[str], gap: float, distance: float) -> DataFrame:
    """Edges that connect the points linked by ``|dt| <= gap`` and distance ``<= distance``.

    ``points`` holds ``group`` columns and ``id, t, x, y``.  The edges span the
    same connected components as all linking pairs, without listing them: points
    of one small cell all link, so they form a star, and two neighbouring cells
    need a single edge.  Whether two cells link at all is decided from their
    bounding boxes (of a single point, the box is the point); pairs that boxes leave open are split a fixed
    number of times, all by the same rule, and what is open then is a search for one point in reach.
    """
    # A cell narrower than distance / sqrt(2) keeps all its points within reach.
    side = distance / 1.415
    reach = 2
    cells = _cells(points, group, gap, side, "a")
    stars = points.select("*", *_coordinates(gap, side)).join(
        cells.select(*group, "a.ct", "a.cx", "a.cy", "a.member"), [*group, "ct", "cx", "cy"]
    ).where("id <> member").select(*group, F.col("id").alias("left_id"), F.col("member").alias("right_id"))

    forward = [(dt, dx, dy) for dt in (0, 1) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)
               if (dt, dx, dy) > (0, 0, 0)]
    offsets = F.array(*[F.struct(F.lit(dt).alias("dt"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                        for dt, dx, dy in forward])
    seeking = cells.select(*group, "a", F.inline(offsets)).select(
        *group, "a", (F.col("a.ct") + F.col("dt")).alias("ct"), (F.col("a.cx") + F.col("dx")).alias("cx"),
        (F.col("a.cy") + F.col("dy")).alias("cy"))
    others = cells.select(*group, F.col("a.ct").alias("ct"), F.col("a.cx").alias("cx"), F.col("a.cy").alias("cy"),
                          F.col("a").alias("b"))
    pairs = cut_lineage(_decide(seeking.join(others, [*group, "ct", "cx", "cy"]).drop("ct", "cx", "cy"), gap, distance).select(
        *group, F.struct("a.member").alias("from"), F.struct("b.member").alias("to"), "a", "b", "always"))

    def decided(frame: DataFrame) -> DataFrame:
        return frame.where("always").select(
            *group, F.col("from.member").alias("left_id"), F.col("to.member").alias("right_id"))

    edges = stars.unionByName(decided(pairs))
    level_gap, level_side = gap, side
    for _ in range(LEVELS):
        level_gap, level_side = level_gap / SPLIT, level_side / SPLIT
        children, open_ = _children(points, group, level_gap, level_side), pairs.where("NOT always").drop("always")
        for name in ("a", "b"):
            open_ = _keyed(open_, name).join(children, [*group, "ct", "cx", "cy"]).drop("ct", "cx", "cy", name).withColumnRenamed(
                "child", name)
        pairs = cut_lineage(_decide(open_, gap, distance))
        edges = edges.unionByName(decided(pairs))
    open_ = pairs.where("NOT always").select(*group, "from", "to", "a", "b")
    placed = points.select(*group, "t", "x", "y", *_coordinates(level_gap, level_side))
    seekers = _keyed(open_, "a").join(placed, [*group, "ct", "cx", "cy"]).select(
        *group, "from", "to", F.col("t").alias("at"), F.col("x").alias("ax"), F.col("y").alias("ay"), "b")
    p, q = _keyed(seekers, "b").alias("p"), placed.alias("q")
    dx, dy = F.col("p.ax") - F.col("q.x"), F.col("p.ay") - F.col("q.y")
    met = (F.abs(F.col("p.at") - F.col("q.t")) <= gap) & (dx * dx + dy * dy <= F.lit(distance * distance))
    for name in (*group, "ct", "cx", "cy"):
        met = (F.col(f"p.{name}") == F.col(f"q.{name}")) & met
    return edges.unionByName(p.join(q, met, "left_semi").select(
        *group, F.col("from.member").alias("left_id"), F.col("to.member").alias("right_id"))).distinct()


# --- densest neighbourhood ------------------------------------------------------------------

_COORDINATE, _COUNT = "decimal(12,6)", "decimal(11,0)"


def _exact(column: Column) -> Column:
    return column.cast(_COORDINATE)


_MOMENTS = ("n", "sum_x", "sum_y", "sum_sq")
_BOX = ("lo_x", "hi_x", "lo_y", "hi_y")


def _nodes(points: DataFrame, group: list[str], side: float) -> DataFrame:
    """Nodes of one level of the tree: place, box, and moments (count, sums, sum of squares) of their points."""
    x, y = _exact(F.col("x")), _exact(F.col("y"))
    return points.select(*group, "x", "y", *[F.floor(F.col(axis) / side).cast("bigint").alias(f"c{axis}") for axis in ("x", "y")]
                         ).groupBy(*group, "cx", "cy").agg(
        *[function(axis).alias(f"{name}_{axis}") for axis in ("x", "y") for name, function in (("lo", F.min), ("hi", F.max))],
        F.count("*").alias("n"), F.sum(x).alias("sum_x"), F.sum(y).alias("sum_y"), F.sum(x * x + y * y).alias("sum_sq")).select(
        *group, "cx", "cy", F.struct("cx", "cy", *_BOX, *_MOMENTS).alias("node"))


def _square(parts: list[Column]) -> Column:
    return parts[0] * parts[0] + parts[1] * parts[1]


def densest_seed(points: DataFrame, group: list[str], radius: float, order: list[str]) -> DataFrame:
    """Per group the point with most neighbours, then the nearest ones, then first in order.

    ``points`` holds ``group``, ``x``, ``y`` and the ``order`` columns.  Branch
    and bound over a tree of moments: a node of possible seeds meets the nodes
    around it; those within reach of all its points count through their
    moments, those out of reach go, and pairs cut by a circle are opened on the
    next level.  A node's seeds have no more neighbours than what counts and what is cut together,
    so nodes below the count that is certain elsewhere in the group are not opened.  Only
    pairs cut on the lowest level are looked into point by point.  Sums of squares
    use exact decimals, so equal distances tie exactly.
    """
    limit = F.lit(radius * radius)
    far = _square([F.greatest(F.col(f"b.hi_{axis}") - F.col(f"a.lo_{axis}"), F.col(f"a.hi_{axis}") - F.col(f"b.lo_{axis}"))
                   for axis in ("x", "y")])
    near = _square([F.greatest(F.lit(0.0), F.col(f"b.lo_{axis}") - F.col(f"a.hi_{axis}"),
                               F.col(f"a.lo_{axis}") - F.col(f"b.hi_{axis}")) for axis in ("x", "y")])
    side = radius / SPLIT
    top = _nodes(points, group, side)
    span = range(-SPLIT - 1, SPLIT + 2)
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in span for dy in span
                       if max(abs(dx) - 1, 0) ** 2 + max(abs(dy) - 1, 0) ** 2 <= SPLIT ** 2])
    met = top.select(*group, F.col("node").alias("a"), F.inline(around)).select(
        *group, "a", (F.col("a.cx") + F.col("dx")).alias("cx"), (F.col("a.cy") + F.col("dy")).alias("cy")).join(
        top.withColumnRenamed("node", "b"), [*group, "cx", "cy"]).drop("cx", "cy")
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), *[F.lit(0).cast(kind).alias(name) for name, kind in (
        ("sum_x", "decimal(22,6)"), ("sum_y", "decimal(22,6)"), ("sum_sq", "decimal(36,12)"))])
    met = met.withColumn("held", zero)
    for level in range(LEVELS):
        judged = cut_lineage(met.where(near <= limit).withColumn("whole", far <= limit))
        node = [*group, "a.cx", "a.cy"]
        counted = judged.groupBy(*group, F.col("a.cx").alias("cx"), F.col("a.cy").alias("cy")).agg(
            F.struct(*[F.coalesce(F.sum(F.when(F.col("whole"), F.col(f"b.{name}"))), F.lit(0)).alias(name) for name in _MOMENTS]
                     ).alias("more"), F.first("held").alias("before"), F.first("a").alias("a"),
            F.coalesce(F.sum(F.when(~F.col("whole"), F.col("b.n"))), F.lit(0)).alias("open")).select(
            *group, "cx", "cy", "a", "open", F.struct(*[
                (F.col(f"more.{name}") + F.col(f"before.{name}")).cast(kind).alias(name) for name, kind in (
                    ("n", "bigint"), ("sum_x", "decimal(22,6)"), ("sum_y", "decimal(22,6)"), ("sum_sq", "decimal(36,12)"))]).alias("held"))
        best = counted.groupBy(*group).agg(F.max("held.n").alias("certain"))
        hopeful = cut_lineage(counted.join(best, group).where(F.col("held.n") + F.col("open") >= F.col("certain")).drop("certain"))
        cut = judged.where("NOT whole").select(*node, "b").join(hopeful.select(*group, "cx", "cy", "a", "held"), [*group, "cx", "cy"])
        if level == LEVELS - 1:
            break
        side /= SPLIT
        below = _nodes(points, group, side).select(
            *group, *[F.floor(F.col(f"node.{place}") / SPLIT).cast("bigint").alias(place) for place in ("cx", "cy")],
            F.col("node").alias("child"))
        # Every node keeps one row that names no neighbour, so that children without cut pairs go on.
        alone = hopeful.select(*group, "cx", "cy", "a", "held", F.lit(None).cast(
            hopeful.schema["a"].dataType).alias("b"))
        opened = cut.select(*group, "cx", "cy", "held", "b").join(below, [*group, "cx", "cy"]).drop("cx", "cy").select(
            *group, F.col("child").alias("a"), "held", F.col("b.cx").alias("cx"), F.col("b.cy").alias("cy")).join(
            below.withColumnRenamed("child", "b"), [*group, "cx", "cy"]).drop("cx", "cy")
        met = opened.select(*group, "a", "b", "held").unionByName(alone.select(*group, "cx", "cy", "held", "b").join(
            below, [*group, "cx", "cy"]).select(*group, F.col("child").alias("a"), "b", "held"))
        # The missing neighbour stands at the node itself and counts nothing.
        empty = F.struct("a.cx", "a.cy", *[F.col(f"a.{name}") for name in _BOX], *[
            F.lit(0).cast(met.select(f"a.{name}").schema[0].dataType).alias(name) for name in _MOMENTS])
        met = met.withColumn("b", F.coalesce("b", empty))
    placed = points.select(*group, *order, "x", "y", *[F.floor(F.col(axis) / side).cast("bigint").alias(f"c{axis}")
                                                      for axis in ("x", "y")])
    point = [*group, *order, "x", "y"]
    candidates = hopeful.select(*group, "cx", "cy", "held").join(placed, [*group, "cx", "cy"])
    others = placed.select(*group, F.col("x").alias("qx"), F.col("y").alias("qy"), "cx", "cy")
    dx, dy = F.col("qx") - F.col("x"), F.col("qy") - F.col("y")
    ring = cut.select(*group, "cx", "cy", F.col("b.cx").alias("bx"), F.col("b.cy").alias("by")).join(
        placed, [*group, "cx", "cy"]).drop("cx", "cy").withColumnsRenamed({"bx": "cx", "by": "cy"}).join(
        others, [*group, "cx", "cy"]).where(dx * dx + dy * dy <= limit).select(
        *point, F.lit(1).cast("bigint").alias("n"), _exact(F.col("qx")).alias("sum_x"), _exact(F.col("qy")).alias("sum_y"),
        (_exact(F.col("qx")) * _exact(F.col("qx")) + _exact(F.col("qy")) * _exact(F.col("qy"))).alias("sum_sq"))
    total = candidates.select(*point, "held.*").unionByName(ring).groupBy(*point).agg(
        *[F.sum(name).alias(name) for name in _MOMENTS])
    x, y = _exact(F.col("x")), _exact(F.col("y"))
    sum_x, sum_y = F.col("sum_x").cast("decimal(22,6)"), F.col("sum_y").cast("decimal(22,6)")
    spread = (
        F.col("sum_sq").cast("decimal(36,12)")
        - F.lit(2).cast("decimal(1,0)") * (x * sum_x + y * sum_y).cast("decimal(36,12)")
        + F.col("n").cast(_COUNT) * (x * x + y * y).cast("decimal(26,12)")
    )
    rank = F.struct(F.col("n"), (-spread).alias("closeness"), *[(-F.col(name)).alias(name) for name in order])
    return total.groupBy(*group).agg(F.max_by(F.struct("x", "y"), rank).alias("seed"))
