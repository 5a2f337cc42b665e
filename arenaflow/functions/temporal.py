"""Ordered kernels: as-of lookup, running totals and gap sessions.

A key may hold a large share of all rows, so none of these kernels sorts a
whole key in one task.  Each key is cut into time cells: rows are ordered only
inside a cell, and what crosses a cell border travels as one summary row per
cell.  Summaries are built by partial aggregation before any shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def cell_number(time: Column, width: float) -> Column:
    return F.floor(time / F.lit(width)).cast("bigint")


def asof_lookup(
    requests: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    request_time: str,
    fact_time: str,
    tie_breaker: Sequence[str],
    values: Sequence[str],
    cell_width: float,
    output: str,
    forward: bool = False,
    highest: bool = False,
    few_requests: bool = False,
    unique_times: bool = False,
) -> DataFrame:
    """Attach the newest fact at or before each request (or oldest at or after).

    The fact arrives as the struct ``output`` with ``fact_time`` and ``values``;
    it is NULL when no fact qualifies.  Facts that share a key and a time are
    resolved by ``tie_breaker``: the last one wins backwards, the first forwards.

    With ``highest`` the answer is, among all facts at or before the request,
    the one with the highest ``tie_breaker``, whatever its time.

    With ``few_requests`` only facts in a requested cell are ordered; all other
    facts are reduced to their cell summary.  ``unique_times`` promises that a
    key has one fact per time, so facts need not be collapsed first.
    """
    pick = F.min_by if forward else F.max_by
    usable = facts.where(" AND ".join(f"`{name}` IS NOT NULL" for name in [*keys, fact_time]))
    carried_names = [*tie_breaker, *values] if highest else list(values)
    names = [name for name in dict.fromkeys(carried_names) if name != fact_time]
    payload = [*names, fact_time] if highest else [fact_time, *names]
    # Columns are picked one by one: fixed-width buffers keep a hash aggregate,
    # a struct buffer would sort every fact first.
    if unique_times:
        single = usable.select(*keys, *payload)
    else:
        tie = F.col(tie_breaker[0]) if len(tie_breaker) == 1 else F.struct(*[F.col(name) for name in tie_breaker])
        single = usable.groupBy(*keys, fact_time).agg(*[
            pick(name, tie if tie_breaker else F.lit(0)).alias(name) for name in names]) if names else usable.select(
            *keys, fact_time).distinct()
    single = single.withColumn("__cell", cell_number(F.col(fact_time), cell_width))
    fact_rows = single.select(
        *keys, F.col(fact_time).alias("__time"), "__cell", F.lit(0).alias("__kind"), F.struct(*payload).alias("__fact"),
        F.lit(None).cast(_struct_of(requests)).alias("__request"),
    )
    fact_type = fact_rows.schema["__fact"].dataType
    request_rows = requests.select(
        *keys, F.col(request_time).alias("__time"),
        cell_number(F.col(request_time), cell_width).alias("__cell"),
        F.lit(1).alias("__kind"), F.lit(None).cast(fact_type).alias("__fact"),
        F.struct("*").alias("__request"),
    )
    asked = request_rows.select(*keys, "__cell").distinct()
    ordered = fact_rows
    if few_requests:
        ordered = fact_rows.join(asked, [*keys, "__cell"], "left_semi").select(request_rows.columns)
    ordered = ordered.unionByName(request_rows)

    time_order = F.col("__time").desc() if forward else F.col("__time").asc()
    inside = (
        Window.partitionBy(*keys, "__cell").orderBy(time_order, F.col("__kind"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def running(column: str) -> Column:
        return F.max(column) if highest else F.last(column, ignorenulls=True)

    resolved = ordered.withColumn("__here", running("__fact").over(inside)).where("__kind = 1")

    cell_order = F.col("__cell").desc() if forward else F.col("__cell").asc()
    across = (
        Window.partitionBy(*keys).orderBy(cell_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    if highest:
        summaries = fact_rows.groupBy(*keys, "__cell").agg(F.max("__fact").alias("__cell_fact"))
    else:
        edge = F.min(fact_time) if forward else F.max(fact_time)
        summaries = single.groupBy(*keys, "__cell").agg(
            edge.alias("__edge"), *[pick(name, F.col(fact_time)).alias(name) for name in names]
        ).withColumnRenamed("__edge", fact_time).select(*keys, "__cell", F.struct(*payload).alias("__cell_fact"))
    carried = (
        summaries.unionByName(asked.withColumn("__cell_fact", F.lit(None).cast(fact_type)))
        .groupBy(*keys, "__cell").agg(F.max("__cell_fact").alias("__cell_fact"))
        .withColumn("__carried", running("__cell_fact").over(across))
        .where("__carried IS NOT NULL")
        .select(*keys, "__cell", "__carried")
    )
    joined = resolved.join(carried, [*keys, "__cell"], "left")
    best = F.greatest("__here", "__carried") if highest else F.coalesce("__here", "__carried")
    found = F.when(F.col("__time").isNotNull(), best)
    return joined.select("__request.*", found.alias(output))


def _struct_of(frame: DataFrame) -> StructType:
    return StructType(frame.schema.fields)


def nearest_lookup(
    requests: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    request_time: str,
    fact_time: str,
    tie_breaker: Sequence[str],
    values: Sequence[str],
    tolerance: float,
    cell_width: float,
    output: str,
    unique_times: bool = False,
) -> DataFrame:
    """Nearest fact in time within ``tolerance``; a tie goes to the earlier fact.

    The nearest fact is either the last one before or the first one after, so
    two as-of lookups answer it without pairing requests with candidates.
    """
    before = asof_lookup(requests, facts, keys, request_time, fact_time, tie_breaker, values,
                         cell_width, "__before", unique_times=unique_times)
    both = asof_lookup(before, facts, keys, request_time, fact_time, tie_breaker, values,
                       cell_width, "__after", forward=True, unique_times=unique_times)
    back = F.col(request_time) - F.col(f"__before.{fact_time}")
    ahead = F.col(f"__after.{fact_time}") - F.col(request_time)
    back_ok, ahead_ok = back <= tolerance, ahead <= tolerance
    chosen = (
        F.when(back_ok & (~F.coalesce(ahead_ok, F.lit(False)) | (back <= ahead)), F.col("__before"))
        .when(ahead_ok, F.col("__after"))
    )
    return both.withColumn(output, chosen).drop("__before", "__after")


def running_total(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    cell_width: float,
    output: str,
) -> DataFrame:
    """Running sum of ``value`` per key in ``order``; the first order column is the time."""
    celled = frame.withColumn("__cell", cell_number(F.col(order[0]), cell_width))
    inside = (
        Window.partitionBy(*keys, "__cell").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    across = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        celled.groupBy(*keys, "__cell").agg(F.sum(value).alias("__cell_total"))
        .withColumn("__earlier", F.sum("__cell_total").over(across))
        .select(*keys, "__cell", "__earlier")
    )
    return (
        celled.withColumn("__here", F.sum(value).over(inside))
        .join(earlier, [*keys, "__cell"], "left")
        .withColumn(output, F.col("__here") + F.coalesce("__earlier", F.lit(0)))
        .drop("__cell", "__here", "__earlier")
    )


def gap_cells(
    frame: DataFrame,
    keys: Sequence[str],
    time: str,
    gap: float,
    partials: Mapping[str, Column],
) -> DataFrame:
    """Pre-aggregate rows to cells no wider than ``gap`` and number the sessions.

    Two rows of one cell are never more than ``gap`` apart, so a session break
    can only lie between cells: ``min(next) - max(previous) > gap``.  The window
    therefore sees one row per cell, not one row per event.
    """
    cells = frame.groupBy(*keys, cell_number(F.col(time), gap).alias("__cell")).agg(
        F.min(time).alias("__first"), F.max(time).alias("__last"),
        *[column.alias(name) for name, column in partials.items()],
    )
    order = Window.partitionBy(*keys).orderBy("__cell")
    starts = F.col("__first") - F.lag("__last").over(order) > gap
    flagged = cells.withColumn("__starts", F.coalesce(starts, F.lit(True)).cast("bigint"))
    return flagged.withColumn("session_number", F.sum("__starts").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - 1).drop("__starts")


def gap_sessions(
    frame: DataFrame,
    keys: Sequence[str],
    time: str,
    gap: float,
    partials: Mapping[str, Column],
    merges: Mapping[str, Column],
) -> DataFrame:
    """One row per activity session: a pause longer than ``gap`` starts a new one.

    ``partials`` are computed per cell and ``merges`` combine them per session.
    """
    return (
        gap_cells(frame, keys, time, gap, partials)
        .groupBy(*keys, "session_number")
        .agg(F.min("__first").alias("session_start"), F.max("__last").alias("session_end"),
             *[column.alias(name) for name, column in merges.items()])
    )


def ordered_index(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell_width: float,
    output: str,
) -> DataFrame:
    """0-based position of every row in its key; the first order column is numeric.

    The position is the size of all earlier cells plus a rank inside the cell.
    """
    celled = frame.withColumn("__cell", cell_number(F.col(order[0]), cell_width))
    inside = Window.partitionBy(*keys, "__cell").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        celled.groupBy(*keys, "__cell").agg(F.count("*").alias("__size"))
        .withColumn("__before", F.coalesce(F.sum("__size").over(across), F.lit(0)))
        .select(*keys, "__cell", "__before")
    )
    return (
        celled.withColumn("__rank", F.row_number().over(inside))
        .join(before, [*keys, "__cell"])
        .withColumn(output, F.col("__before") + F.col("__rank") - 1)
        .drop("__cell", "__rank", "__before")
    )


def carry_forward(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fills: Mapping[str, tuple[str, str]],
    cell_width: float,
    inclusive: bool = True,
) -> DataFrame:
    """Running value of columns per key in ``order``; the first order column is numeric.

    ``fills`` maps an output to ``(column, how)`` with ``how`` one of ``last``
    (latest non-NULL so far), ``first`` (earliest non-NULL so far) or ``max``.
    With ``inclusive=False`` the row itself does not count.
    """
    celled = frame.withColumn("__cell", cell_number(F.col(order[0]), cell_width))
    inside = Window.partitionBy(*keys, "__cell").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    across = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*[F.col(name) for name in order])

    def running(how: str, column: str) -> Column:
        if how == "max":
            return F.max(column)
        return (F.first if how == "first" else F.last)(column, ignorenulls=True)

    def summary(how: str, column: str) -> Column:
        if how == "max":
            return F.max(column)
        return (F.min_by if how == "first" else F.max_by)(column, F.when(F.col(column).isNotNull(), place))

    summaries = celled.groupBy(*keys, "__cell").agg(
        *[summary(how, column).alias(f"__cell_{name}") for name, (column, how) in fills.items()])
    carried = summaries.select(*keys, "__cell", *[
        running(how, f"__cell_{name}").over(across).alias(f"__from_{name}") for name, (_, how) in fills.items()])
    here = celled.select("*", *[
        running(how, column).over(inside).alias(f"__here_{name}") for name, (column, how) in fills.items()])
    joined = here.join(carried, [*keys, "__cell"], "left")

    def combine(name: str, how: str) -> Column:
        before, now = F.col(f"__from_{name}"), F.col(f"__here_{name}")
        if how == "max":
            return F.greatest(before, now)
        return F.coalesce(before, now) if how == "first" else F.coalesce(now, before)

    kept = [name for name in frame.columns if name not in fills]
    return joined.select(*kept, *[combine(name, how).alias(name) for name, (_, how) in fills.items()])
