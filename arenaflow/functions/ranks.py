"""Exact order statistics by radix selection: a fixed number of counting passes, no group is ordered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a value looked at in a pass: a group has at most 2 ** DIGIT counts, whatever its size.
DIGIT = 16


def ordered_bits(value: Column, kind: T.DataType) -> Column:
    """A long that orders as ``value`` does: integers as they are, decimals unscaled, doubles by their bits (NaN last)."""
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (value.cast(f"decimal(38,{kind.scale})") * F.lit(10 ** kind.scale).cast("decimal(19,0)")).cast("bigint")
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double")).cast("bigint")
        # Negative doubles count backwards.
        return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))
    raise TypeError(f"no order-preserving bits for {kind.simpleString()}")


def exact_order_statistics(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    positions: Mapping[str, Column],
) -> DataFrame:
    """Values found at given 0-based sorted positions, one column per entry.

    ``positions`` maps an output name to a position expressed over the column
    ``n`` (the group's row count).  Equal values are counted first.  Every pass counts the values by their
    next ``DIGIT`` bits from the top and keeps those whose digit holds the wanted position, so
    that after the last one a single value is left.  Counts are combined before every shuffle and only the counts
    of a group's digits are added up in order.
    """
    bits = ordered_bits(F.col(value), frame.schema[value].dataType)
    rows = frame.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__count")).withColumn("__bits", bits)
    sizes = rows.groupBy(*keys).agg(F.sum("__count").alias("n"))
    wanted = sizes.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("__name"), positions[name].cast("bigint").alias("__position")) for name in positions
    ])).alias("want")).select(*keys, "want.*")
    group = list(keys)
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftright("__bits", shift)
        numbered = rows.withColumn("__digit", digit if shift == 64 - DIGIT else digit.bitwiseAND((1 << DIGIT) - 1))
        before = Window.partitionBy(*group).orderBy("__digit").rowsBetween(Window.unboundedPreceding, -1)
        counts = numbered.groupBy(*group, "__digit").agg(F.sum("__count").alias("__size")).withColumn(
            "__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
        located = wanted.join(counts, group).where(
            (F.col("__position") >= F.col("__before")) & (F.col("__position") < F.col("__before") + F.col("__size")))
        rows = numbered.join(located.select(*keys, "__name", "__digit"), [*group, "__digit"]).select(
            *keys, "__name", value, "__count", "__bits")
        wanted = located.select(*keys, "__name", (F.col("__position") - F.col("__before")).alias("__position"))
        group = [*keys, "__name"]
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__name") == name, F.col(value))).alias(name) for name in positions])


def exact_median(frame: DataFrame, keys: Sequence[str], value: str, output: str) -> DataFrame:
    """Mean of the two middle values (the middle value for an odd count)."""
    return exact_order_statistics(frame, keys, value, {
        "__low": F.floor((F.col("n") - 1) / 2), "__high": F.floor(F.col("n") / 2),
    }).select(*keys, ((F.col("__low") + F.col("__high")) / 2).alias(output))
