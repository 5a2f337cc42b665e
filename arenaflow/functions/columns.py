"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """True only for a number that is neither NULL, NaN nor infinite."""
    as_double = value.cast("double")
    return F.coalesce(~F.isnan(as_double) & (F.abs(as_double) < F.lit(float("inf"))), F.lit(False))


def half_up(value: Column) -> Column:
    """Round to the nearest integer with halves going towards plus infinity."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def blank_to_null(value: Column) -> Column:
    """Trim, and treat an empty name as unknown."""
    return F.nullif(F.trim(value), F.lit(""))


def newest_first(*columns: Column) -> Column:
    """Comparable struct for ``max_by`` that sorts NULL below every value.

    Equivalent to ``ORDER BY c DESC NULLS LAST`` on every column, but usable in
    an aggregate, so the pick combines map-side instead of shuffling all rows.
    """
    return F.struct(*[part for column in columns for part in (column.isNotNull(), column)])


def stable_digest(*parts: Column) -> Column:
    """Hex SHA-256 of the parts joined by NUL characters."""
    pieces: list[Column] = []
    for index, part in enumerate(parts):
        if index:
            pieces.append(F.char(F.lit(0)))
        pieces.append(part.cast("string"))
    return F.sha2(F.concat(*pieces), 256)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))
