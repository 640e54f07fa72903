"""Window-shaped array expressions (all JVM side)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_to(values: Column, length: int) -> Column:
    """Extend an array to ``length`` by repeating its last element."""
    missing = F.lit(length) - F.size(values)
    return F.when(missing > 0, F.concat(values, F.array_repeat(F.element_at(values, -1), missing))).otherwise(values)


def bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with ``value`` evaluated once, however often the result reads it."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def central_difference(values: Column) -> Column:
    """Slope per step: centred inside, one-sided at both ends."""

    def slopes(w: Column) -> Column:
        last = F.size(w) - 1

        def slope(v: Column, i: Column) -> Column:
            return (
                F.when(i == 0, F.get(w, F.lit(1)) - v)
                .when(i == last, v - F.get(w, i - 1))
                .otherwise((F.get(w, i + 1) - F.get(w, i - 1)) / 2)
            )

        return F.transform(w, slope)

    return bound(values, slopes)


def rolling_spread(values: Column, width: int) -> Column:
    """Population standard deviation over ``width`` neighbours, ends replicated."""
    half = width // 2

    def padded(w: Column) -> Column:
        return F.concat(F.array_repeat(F.element_at(w, 1), half), w, F.array_repeat(F.element_at(w, -1), half))

    def spreads(w: Column, p: Column) -> Column:
        def at(i: Column) -> Column:
            terms = [F.get(p, i + j) for j in range(width)]
            squares = [t * t for t in terms]
            mean, mean_square = sum(terms[1:], terms[0]) / width, sum(squares[1:], squares[0]) / width
            return F.sqrt(F.greatest(mean_square - mean * mean, F.lit(0.0)))

        return F.transform(w, lambda _, i: at(i))

    return bound(values, lambda w: bound(padded(w), lambda p: spreads(w, p)))


def assemble_channels(values: Column, level: Column, level_delta: Column, width: int) -> Column:
    """Struct of the five channel arrays of one window."""
    return F.struct(
        values.alias("value"),
        central_difference(values).alias("derivative"),
        rolling_spread(values, width).alias("spread"),
        level.alias("level"),
        level_delta.alias("level_delta"),
    )

