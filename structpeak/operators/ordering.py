"""Exact order statistics without sorting a whole group in one task.

A group is cut into ordered buckets; each bucket is sorted on its own and receives the
row count of the buckets before it. Bucket tables have a fixed number of rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from structpeak.operators.hotkeys import FEW

CUTS = 64
DIGEST_PREFIX = 3  # hex digits: 4096 buckets


def digest_rank(df: DataFrame, digest: str, position: str = "position", total: str = "total") -> DataFrame:
    """1-based position of each row in the order of a uniform hex digest, and the row total.

    The digest prefix is the bucket, so buckets are even and the global order never meets
    in one task; the bucket table has 4096 rows at most.
    """
    tagged = df.withColumn("_bucket", F.substring(digest, 1, DIGEST_PREFIX))
    counts = tagged.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias(total),
    )
    inside = Window.partitionBy("_bucket").orderBy(digest)
    return (
        tagged.withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(position, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_bucket", "_inside", "_before")
    )


def near_equal_part(position: Column, total: Column, parts: int) -> Column:
    """0-based part of a 1-based position; the first ``total % parts`` parts get one more."""
    base = F.expr("0") + F.floor(total / parts)
    extra = total % parts
    wide = extra * (base + 1)
    small = F.greatest(base, F.lit(1))
    return (
        F.when(position <= wide, F.floor((position - 1) / (base + 1)))
        .otherwise(extra + F.floor((position - 1 - wide) / small))
        .cast("int")
    )


def cumulative_histogram(
    df: DataFrame, keys: Sequence[str], value: str, levels: int = 1, cuts: int = CUTS, few_groups: bool = False
) -> DataFrame:
    """Distinct values per group with ``rows`` (ties), ``below`` (rows strictly smaller), ``total``.

    Equal values collapse before anything is ordered. The rest is cut at sketch quantiles;
    each level divides a bucket by ``cuts`` again. The cuts only decide who sorts what, so
    the counts are exact whatever the sketch's error is. ``few_groups`` says the groups were
    counted and are few, so their first cuts may be broadcast.
    """
    hist = _ordered_histogram(df, keys, value, levels, cuts, few_groups).where(F.col(value).isNotNull())
    return hist.select(*[F.col("_g")[k].alias(k) for k in keys], value, "rows", "below", "total")


def _ordered_histogram(df: DataFrame, keys: Sequence[str], value: str, levels: int, cuts: int, few_groups: bool) -> DataFrame:
    """The histogram by ``_g``; a group's missing values give one row that counts nothing."""
    hist = _grouped(df, keys).groupBy("_g", value).agg(F.count(value).alias("rows"))
    shares = [i / cuts for i in range(1, cuts)]
    path: list[str] = []
    for level in range(levels):
        # asking for the counts here too lets both readers of the histogram share its exchange
        edges = hist.groupBy("_g", *path).agg(
            F.percentile_approx(value, shares, 10_000).alias("_edges"), F.sum("rows").alias("_held")
        ).where(F.col("_held") >= 0).drop("_held")
        if level == 0 and (few_groups or not keys):
            edges = F.broadcast(edges)
        hist = hist.join(edges, ["_g", *path]).withColumn(f"_b{level}", _bucket(value, cuts)).drop("_edges")
        path.append(f"_b{level}")

    sizes = hist.groupBy("_g", *path).agg(F.sum("rows").alias("_rows"))
    along = Window.partitionBy("_g").orderBy(*path)
    sizes = sizes.select(
        "_g", *path,
        F.coalesce(F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    inside = Window.partitionBy("_g", *path).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        hist.withColumn("_inside", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
        .join(sizes, ["_g", *path])
        .select("_g", value, "rows", (F.col("_inside") + F.col("_offset")).alias("below"), "total")
    )


def _bucket(value: str, cuts: int) -> Column:
    """Number of ``_edges`` below the value, by halving steps over the ordered edges."""
    steps = [1 << b for b in range((cuts - 1).bit_length() - 1, -1, -1)]

    def closer(found: Column, step: Column) -> Column:
        below = F.get("_edges", found + step - 1) < F.col(value)
        return F.when(below, found + step).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), closer)


#: Bits below the prefix after each pass: sign, exponent and 8 bits, then 20, then the last 24 bits of the value.
RADIX_SHIFTS = (44, 24, 0)


@F.arrow_udf(LongType())
def _float_bits(x: pa.Array) -> pa.Array:
    value = x.to_numpy(zero_copy_only=False)
    size = np.abs(value).view(np.int64)
    bits = np.where(np.isnan(value), 0x7FF8 << 48, np.where(value < 0, -size, size))
    return pa.array(bits, mask=x.is_null().to_numpy(zero_copy_only=False))


def ordered_bits(x: Column) -> Column:
    """A double as a long of the same order: its sign times its IEEE bits without the sign. NaN is the largest."""
    return _float_bits(x)



def radix_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], spread: str = FEW) -> DataFrame:
    """Linearly interpolated exact quantiles of large groups, by radix selection.

    Values are counted by their leading bits; the counts tell in which prefix each rank sought lies, and only
    values with that prefix are counted by their next bits. Three passes read the input and shuffle counts, never values.
    ``spread`` is FEW where the groups were counted and are few, so that the prefixes sought may be broadcast.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    points = _grouped(df, keys).select("_g", x.alias("_x"), ordered_bits(x).alias("_bits"))
    ranks = []
    for q in quantiles.values():
        place = F.lit(float(q)) * (F.col("_total") - 1)
        ranks += [F.floor(place), F.ceil(place)]
    wanted, totals = None, None
    for shift in RADIX_SHIFTS:
        prefix = F.shiftright("_bits", shift)
        if wanted is None:
            counts = points.groupBy("_g", prefix.alias("_prefix")).agg(F.count("_x").alias("_rows"))
            whole = F.sum("_rows").over(Window.partitionBy("_g"))
            along = Window.partitionBy("_g").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
            counts = counts.withColumn("_total", whole).withColumn("_below", F.coalesce(F.sum("_rows").over(along), F.lit(0)))
            totals = counts.select("_g", "_total").distinct()
            hit = F.filter(F.array_distinct(F.array(*ranks)), lambda r: (F.col("_below") <= r) & (r < F.col("_below") + F.col("_rows")))
            wanted = counts.select("_g", "_prefix", "_below", F.explode(hit).alias("_rank"))
        else:
            sought = wanted.select(F.col("_g").alias("_h"), F.col("_prefix").alias("_start")).distinct()
            same = (F.col("_g") == F.col("_h")) & (F.shiftright("_bits", before) == F.col("_start"))
            inside = points.join(F.broadcast(sought) if spread == FEW else sought, same).select("_g", "_start", prefix.alias("_prefix"), "_x")
            counts = inside.groupBy("_g", "_start", "_prefix").agg(F.count("_x").alias("_rows"), F.max("_x").alias("_value"))
            along = Window.partitionBy("_g", "_start").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
            counts = counts.withColumn("_in", F.coalesce(F.sum("_rows").over(along), F.lit(0)))
            joined = counts.join(wanted.select("_g", F.col("_prefix").alias("_start"), "_below", "_rank"), ["_g", "_start"])
            below = F.col("_below") + F.col("_in")
            wanted = joined.where((below <= F.col("_rank")) & (F.col("_rank") < below + F.col("_rows"))).select("_g", "_prefix", below.alias("_below"), "_rank", "_value")
        before = shift
    table = wanted.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))  # two entries a quantile
    out = totals.join(table, "_g", "left")
    columns = []
    for i, (n, q) in enumerate(quantiles.items()):
        low, high = F.try_element_at("_at", ranks[2 * i]), F.try_element_at("_at", ranks[2 * i + 1])
        place = F.lit(float(q)) * (F.col("_total") - 1)
        columns.append((low + (high - low) * (place - F.floor(place))).alias(n))
    return out.select(*[F.col("_g")[k].alias(k) for k in keys], *columns)


def _grouped(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group key as one struct: never NULL itself, and NULL parts are equal inside it."""
    return df.withColumn("_g", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], spread: bool | str = False
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per name.

    ``spread=False`` uses the built-in aggregate (one buffer per group, so only for groups
    of a checked size); otherwise the order statistics are read off the histogram.
    """
    keys = list(keys)
    if not spread:
        values = F.percentile(value, F.array(*[F.lit(q) for q in quantiles.values()]))
        return df.groupBy(*keys).agg(values.alias("_q")).select(
            *keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(quantiles)]
        )
    # many groups fill all tasks as they are, so a 64th of one is small enough a bucket
    hist = _ordered_histogram(df, keys, value, 2 if spread == FEW else 1, CUTS, spread == FEW)
    aggs = []
    for n, q in quantiles.items():
        place = F.lit(float(q)) * (F.col("total") - 1)
        for tag, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (F.col("below") <= at) & (at < F.col("below") + F.col("rows"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{tag}_{n}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"_f_{n}"))
    found = hist.groupBy("_g").agg(*aggs).select(
        "_g", *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in quantiles]
    )
    return found.select(*[F.col("_g")[k].alias(k) for k in keys], *quantiles)
