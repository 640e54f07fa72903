"""Half-open interval join (price lists and other validity periods)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = "day"  # rows of one key in one slot are worked on together


def interval_left_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    valid_from: str,
    valid_to: str,
    small: bool = False,
    slot: str = SLOT,
) -> DataFrame:
    """Left join on equal keys and ``valid_from <= at < valid_to`` (NULL ``valid_to``: open).

    ``small`` is for a right side that the caller knows to fit a broadcast. Otherwise both sides are merged in time
    order. That needs intervals of a key that don't overlap; where some do, the right side is repeated once per calendar month
    it covers and joined on (keys, month).
    """
    if small:
        return _broadcast_join(left, right, keys, at, valid_from, valid_to)
    if _overlapping(right, keys, valid_from, valid_to):
        return _month_join(left, right, keys, at, valid_from, valid_to)
    return interval_merge(left, right, keys, at, valid_from, valid_to, slot)


def _usable(right: DataFrame, keys: Sequence[str], valid_from: str, valid_to: str) -> DataFrame:
    """Intervals that can hold something: known key and start, and not empty."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, valid_from]])
    return right.where(known & (F.col(valid_to).isNull() | (F.col(valid_from) < F.col(valid_to))))


def _overlapping(right: DataFrame, keys: Sequence[str], valid_from: str, valid_to: str) -> bool:
    following = F.lead(valid_from).over(Window.partitionBy(*keys).orderBy(valid_from))
    ends_late = F.col("_next").isNotNull() & (F.col(valid_to).isNull() | (F.col("_next") < F.col(valid_to)))
    return not _usable(right, keys, valid_from, valid_to).withColumn("_next", following).where(ends_late).isEmpty()


def interval_merge(
    left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, valid_from: str, valid_to: str, slot: str = SLOT
) -> DataFrame:
    """The join for intervals that don't overlap: the last one that began, if it still holds.

    Both sides are appended and sorted by time inside (key, time slot); the interval that is open at a slot's start
    comes from the slots before it, as one row a slot. Every row moves once, nothing is repeated, and a key
    that holds most of the rows is spread over its slots. Rows with an unknown key or time are set aside.
    """
    keys, held = list(keys), [c for c in right.columns if c not in keys]
    usable = _usable(right, keys, valid_from, valid_to)
    kind = right.select(F.struct(*held).alias("_right")).schema["_right"].dataType
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, at]])
    rows = left.where(known).select(F.struct(*keys).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(kind).alias("_right"))
    starts = usable.select(F.struct(*keys).alias("_key"), F.col(valid_from).cast(left.schema[at].dataType).alias("_at"), F.lit(0).alias("_side"), F.struct(*held).alias("_right"))
    events = rows.unionByName(starts, allowMissingColumns=True).withColumn("_slot", F.date_trunc(slot, "_at"))
    slots = events.groupBy("_key", "_slot").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.col("_at"))).alias("_last"))
    earlier = Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("_key", "_slot", F.last("_last", True).over(earlier).alias("_carried"))
    inside = Window.partitionBy("_key", "_slot").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    begun = events.withColumn("_begun", F.last("_right", True).over(inside)).where("_side = 1")
    open_ = F.coalesce("_begun", "_carried")
    holds = open_[valid_to].isNull() | (F.col("_at") < open_[valid_to])
    joined = begun.join(slots, ["_key", "_slot"]).select("_left.*", F.when(holds, open_).alias("_open")).select(*left.columns, "_open.*")
    loose = left.where(~known).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in held])
    return joined.unionByName(loose)


def _broadcast_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, valid_from: str, valid_to: str) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(F.broadcast(r), _equal(keys) & _held(at, valid_from, valid_to), "left").drop(*[f"_k_{k}" for k in keys])


def _month_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, valid_from: str, valid_to: str) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    low, high = (left.agg(f(at).alias("t")).scalar() for f in (F.min, F.max))
    first, last = _month(F.greatest(F.col(valid_from), low)), _month(F.least(F.coalesce(F.col(valid_to), high), high))
    covered = r.withColumn("_month", F.explode(F.when(first <= last, F.sequence(first, last))))  # only months the left side has
    placed = left.withColumn("_at_month", _month(F.col(at)))
    same_month = F.col("_at_month") == F.col("_month")
    match = _equal(keys) & same_month & _held(at, valid_from, valid_to)
    return placed.join(covered, match, "left").drop(*[f"_k_{k}" for k in keys], "_month", "_at_month")


def _equal(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in keys])


def _held(at: str, valid_from: str, valid_to: str) -> Column:
    return (F.col(at) >= F.col(valid_from)) & ((F.col(at) < F.col(valid_to)) | F.col(valid_to).isNull())


def _month(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)
