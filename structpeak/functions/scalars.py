"""Scalar expressions with the null and division rules used throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(column: Column | str) -> Column:
    """NaN and infinities become NULL, so one null rule covers every later step."""
    c = F.col(column) if isinstance(column, str) else column
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def guarded_ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """``round(a / b, digits)`` where b is positive, otherwise NULL."""
    return F.when(denominator > 0, F.round(numerator / denominator, digits))


def relative_error(predicted: Column, actual: Column) -> Column:
    """Distance over the actual value; infinite where the actual value is zero."""
    return F.when(actual == 0, F.lit(float("inf"))).otherwise(F.abs(predicted - actual) / F.abs(F.nullif(actual, F.lit(0))))


def minutes_between(start: Column, end: Column, wall_clock: bool = False) -> Column:
    """Whole seconds between two timestamps, in minutes, as double.

    Instants are compared by default; ``wall_clock`` is for timestamps without a time zone,
    whose difference must not depend on the session's zone.
    """
    if not wall_clock:
        return (F.unix_timestamp(end) - F.unix_timestamp(start)).cast("double") / F.lit(60.0)

    def seconds(t: Column) -> Column:
        return F.unix_date(F.to_date(t)).cast("bigint") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)

    return (seconds(end) - seconds(start)).cast("double") / F.lit(60.0)


def like_class(column: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """First matching LIKE pattern wins; an unmatched text is its own class."""
    out = None
    for pattern, name in rules:
        hit = column.like(pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return column if out is None else out.otherwise(column)


def version_text(prefix: str, as_of: Column) -> Column:
    """``prefix_yyyyMMdd_HHmm`` from an explicit time."""
    return F.concat_ws("_", F.lit(prefix), F.date_format(as_of, "yyyyMMdd_HHmm"))
