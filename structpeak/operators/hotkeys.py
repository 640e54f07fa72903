"""Routing by measured group size.

Most series fit one task. A series that holds a large share of all rows must not; it is
found by a pre-aggregated count and sent down the spread-out form of the same operator.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows one task may hold for one group.
TASK_ROWS = 1_000_000
# Most hot keys carried as a broadcast list; with more, everything takes the spread form.
LISTED_KEYS = 10_000
# How a part is to be worked on beyond one task per group; both are true.
FEW = "few"  # at most LISTED_KEYS groups
MANY = "many"
# Rows a side may have to be broadcast on purpose.
BROADCAST_ROWS = 100_000


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    """Null-safe equality of the key columns of two frames."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def split_hot(df: DataFrame, keys: Sequence[str], task_rows: int = TASK_ROWS):
    """``(ordinary, hot, spread)`` parts of ``df``; a part that is empty by measurement is None."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    hot = sizes.where(F.col("_rows") > task_rows).select(*keys)
    listed = hot.limit(LISTED_KEYS + 1).collect()
    if not listed:
        return df, None, False
    if len(listed) > LISTED_KEYS:
        return None, df, MANY
    hot_list = F.broadcast(df.sparkSession.createDataFrame(listed, hot.schema))
    match = same_key(df, hot_list, keys)
    return df.join(hot_list, match, "left_anti"), df.join(hot_list, match, "left_semi"), FEW


def by_group_size(
    df: DataFrame,
    keys: Sequence[str],
    build: Callable[[DataFrame, bool | str], DataFrame],
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Run ``build(part, spread)`` on each part and append the results."""
    ordinary, hot, spread = split_hot(df, keys, task_rows)
    parts = [build(p, s) for p, s in ((ordinary, False), (hot, spread)) if p is not None]
    return reduce(lambda a, b: a.unionByName(b), parts)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows, counting no further than that."""
    return df.limit(rows + 1).count() <= rows
