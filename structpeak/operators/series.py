"""Series operators: positions, gap filling, robust scaling and fixed windows.

The ordinary form needs one hash exchange on the series key: numbering, filling, scaling
and window building all share it. The spread form numbers rows inside time slots and adds
the size of the earlier slots, so one very long series uses many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structpeak.config import SERIES_KEY
from structpeak.functions.arrays import pad_to
from structpeak.operators import hotkeys
from structpeak.operators.hotkeys import FEW, MANY, same_key, split_hot
from structpeak.operators.ordering import exact_quantiles
from structpeak.session import released

FLAT = 1e-9  # a scale at or below this counts as zero
SLOT = "hour"  # at most 8,784 slots per series-year
WIDE_SLOT = "quarter"  # of series that one task could hold: slots are fewer than readings, however short the series


def _order(ts: str, tie: Sequence[str]) -> list[Column]:
    return [F.col(ts), *[F.col(t) for t in tie]]


def position_index(
    df: DataFrame, keys: Sequence[str] = SERIES_KEY, ts: str = "ts", tie: Sequence[str] = (), spread: bool | str = False
) -> DataFrame:
    """Add ``pos``, the 1-based row position of each reading in its series."""
    keys = list(keys)
    if not spread:
        by_time = Window.partitionBy(*keys).orderBy(*_order(ts, tie))
        return df.withColumn("pos", F.row_number().over(by_time).cast("bigint"))
    local = _slotted(df, keys, ts, tie, spread)
    sizes = local.groupBy("_key", "_slot").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_key", "_slot", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    numbered = local.join(offsets, ["_key", "_slot"]).withColumn("pos", F.col("_local") + F.col("_offset"))
    return _unkeyed(numbered, keys, df.columns, "pos")


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str] = SERIES_KEY,
    value: str = "value",
    ts: str = "ts",
    tie: Sequence[str] = (),
    spread: bool | str = False,
    out: str = "filled",
) -> DataFrame:
    """Add ``pos`` and the gap-free value.

    Missing readings are interpolated by position; before the first and after the last good
    reading the nearest good value holds; a series without any good reading becomes zero.
    """
    keys = list(keys)
    if spread:
        return _fill_gaps_spread(df, keys, value, ts, tie, out, spread)
    indexed = position_index(df, keys, ts, tie)
    by_time = Window.partitionBy(*keys).orderBy(*_order(ts, tie))
    ordering = ", ".join(f"`{c}`" for c in [ts, *tie])
    partition = ", ".join(f"`{k}`" for k in keys)
    good = F.when(F.col(value).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(value).alias("v")))
    return (
        indexed.withColumn("_good", good)
        .withColumn("_prev", F.last("_good", True).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_next", F.expr(f"lead(_good, 1) IGNORE NULLS OVER (PARTITION BY {partition} ORDER BY {ordering})"))
        .withColumn(out, _interpolated(value))
        .drop("_good", "_prev", "_next")
    )


def _interpolated(value: str) -> Column:
    prev, nxt = F.col("_prev"), F.col("_next")
    step = (F.col("pos") - prev["p"]) / (nxt["p"] - prev["p"])
    between = prev["v"] + (nxt["v"] - prev["v"]) * step
    return (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(prev.isNotNull() & nxt.isNotNull(), between)
        .otherwise(F.coalesce(prev["v"], nxt["v"], F.lit(0.0)))
    )


def _slot_start(df: DataFrame, keys: list[str], ts: str, spread: bool | str) -> DataFrame:
    """Add ``_slot``. Of many series most are short, and hours would hold a reading or two: counted ones that a task could hold get wide slots."""
    hour, wide = (F.date_trunc(width, ts).cast("timestamp") for width in (SLOT, WIDE_SLOT))
    if spread == MANY:
        ordinary, long, _ = split_hot(df, keys, hotkeys.TASK_ROWS)
        if long is None:
            return df.withColumn("_slot", wide)
        if ordinary is not None:
            return long.withColumn("_slot", hour).unionByName(ordinary.withColumn("_slot", wide))
    return df.withColumn("_slot", hour)


def _slotted(df: DataFrame, keys: list[str], ts: str, tie: Sequence[str], spread: bool | str) -> DataFrame:
    """Number rows inside (series, time slot).

    Key and slot are never NULL (a struct, and a first slot for missing times), so the same
    exchange serves this window and the joins on both. The key moves as that struct only; ``_unkeyed`` gives its parts back.
    """
    inside = Window.partitionBy("_key", "_slot").orderBy(*_order(ts, tie))
    slot = F.coalesce("_slot", F.lit("0001-01-01 00:00:00").cast("timestamp"))
    return (
        _slot_start(df, keys, ts, spread).withColumn("_key", F.struct(*keys)).withColumn("_slot", slot)
        .drop(*keys).withColumn("_local", F.row_number().over(inside).cast("bigint"))
    )


def _unkeyed(df: DataFrame, keys: list[str], columns: Sequence[str], *more: str) -> DataFrame:
    """The columns asked for, key parts read from ``_key``."""
    return df.select(*[F.col("_key")[c].alias(c) if c in keys else c for c in columns], *more)


def _fill_gaps_spread(df, keys, value, ts, tie, out, spread) -> DataFrame:
    local = _slotted(df, keys, ts, tie, spread)
    good = F.when(F.col(value).isNotNull(), F.struct(F.col("_local").alias("p"), F.col(value).alias("v")))
    slots = local.groupBy("_key", "_slot").agg(
        F.count("*").alias("_rows"), F.min(good).alias("_first"), F.max(good).alias("_last")
    )
    by_slot = Window.partitionBy("_key").orderBy("_slot")
    slots = slots.withColumn(
        "_offset", F.coalesce(F.sum("_rows").over(by_slot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    for edge in ("_first", "_last"):
        moved = F.struct((F.col(edge)["p"] + F.col("_offset")).alias("p"), F.col(edge)["v"].alias("v"))
        slots = slots.withColumn(edge, F.when(F.col(edge).isNotNull(), moved))
    slots = slots.select(
        "_key", "_slot", "_offset",
        F.last("_last", True).over(by_slot.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.expr("lead(_first, 1) IGNORE NULLS OVER (PARTITION BY _key ORDER BY _slot)").alias("_after"),
    )
    inside = Window.partitionBy("_key", "_slot").orderBy("_local")
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(value).alias("v")))
    filled = (
        local.join(slots, ["_key", "_slot"])
        .withColumn("pos", F.col("_local") + F.col("_offset"))
        .withColumn("_good", known)
        .withColumn("_prev", F.last("_good", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_next", F.expr("lead(_good, 1) IGNORE NULLS OVER (PARTITION BY _key, _slot ORDER BY _local)"))
        .withColumn("_prev", F.coalesce("_prev", "_before"))
        .withColumn("_next", F.coalesce("_next", "_after"))
        .withColumn(out, _interpolated(value))
    )
    return _unkeyed(filled, keys, [c for c in df.columns if c not in ("pos", out)], "pos", out)


def _attach(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], few: bool = False) -> DataFrame:
    """Left join of per-group columns; a NULL key part is a group of its own."""
    side = right.select(F.struct(*keys).alias("_key"), *columns)
    keyed = left.withColumn("_key", F.struct(*keys)).drop(*keys)
    return _unkeyed(keyed.join(F.broadcast(side) if few else side, "_key", "left"), list(keys), left.columns, *columns)


def scale_of(q_low: Column, q_high: Column, deviation: Column) -> Column:
    """Interquantile range, else standard deviation, else one."""
    width = q_high - q_low
    return F.when(width > FLAT, width).when(deviation != 0, deviation).otherwise(F.lit(1.0))


def robust_scaler(
    df: DataFrame,
    keys: Sequence[str] = SERIES_KEY,
    value: str = "value",
    q_low: float = 0.25,
    q_high: float = 0.75,
    spread: bool | str = False,
) -> DataFrame:
    """Median and interquantile scale of each group's present values; (0, 1) when there are none."""
    keys = list(keys)
    names = {"_lo": q_low, "_med": 0.5, "_hi": q_high}
    deviation = F.stddev_pop(value).alias("_sd")
    if not spread:
        q = F.percentile(value, F.array(*[F.lit(x) for x in names.values()])).alias("_q")
        stats = df.groupBy(*keys).agg(q, deviation, F.count(value).alias("n_good"))
        stats = stats.select(*keys, "_sd", "n_good", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    else:
        sd = df.groupBy(*keys).agg(deviation, F.count(value).alias("n_good"))
        stats = _attach(sd, exact_quantiles(df, keys, value, names, spread), keys, list(names))
    return stats.select(
        *keys,
        "n_good",
        F.coalesce("_med", F.lit(0.0)).alias("median"),
        F.coalesce(scale_of(F.col("_lo"), F.col("_hi"), F.col("_sd")), F.lit(1.0)).alias("scale"),
    )


def with_scaler(
    df: DataFrame,
    keys: Sequence[str] = SERIES_KEY,
    value: str = "value",
    q_low: float = 0.25,
    q_high: float = 0.75,
    spread: bool | str = False,
) -> DataFrame:
    """Add ``median`` and ``scale`` of the own group to every row."""
    keys = list(keys)
    if spread:
        return _attach(df, robust_scaler(df, keys, value, q_low, q_high, spread), keys, ["median", "scale"], spread == FEW)
    group = Window.partitionBy(*keys)
    return (
        df.withColumn("_q", F.percentile(value, F.array(F.lit(q_low), F.lit(0.5), F.lit(q_high))).over(group))
        .withColumn("_sd", F.stddev_pop(value).over(group))
        .withColumn("median", F.coalesce(F.col("_q")[1], F.lit(0.0)))
        .withColumn("scale", F.coalesce(scale_of(F.col("_q")[0], F.col("_q")[2], F.col("_sd")), F.lit(1.0)))
        .drop("_q", "_sd")
    )


def scaled(value: Column, median: Column, scale: Column) -> Column:
    return (value - median) / scale


def unscaled(value: Column, median: Column, scale: Column) -> Column:
    return value * scale + median


def fixed_windows(
    df: DataFrame,
    length: int,
    stride: int | None = None,
    keys: Sequence[str] = SERIES_KEY,
    values: Sequence[str] = ("filled",),
    constants: Sequence[str] = (),
    pad_short: bool = True,
) -> DataFrame:
    """One row per window of ``length`` consecutive positions.

    ``df`` carries ``pos`` from :func:`position_index` or :func:`fill_gaps`. An incomplete
    tail is dropped; a series shorter than one window gives a single window extended with
    its last value (or none with ``pad_short=False``). ``constants`` are per-series columns
    that travel along.
    """
    keys = list(keys)
    step = length if stride is None else stride
    if step == length:
        placed = df.withColumn("window_id", F.expr(f"(pos - 1) div {length}"))
    else:
        first = F.greatest(F.expr(f"(pos - {length} + {step} - 1) div {step}"), F.lit(0).cast("bigint"))
        last = F.expr(f"(pos - 1) div {step}")
        ids = F.when(first <= last, F.sequence(first, last))
        placed = df.withColumn("window_id", F.explode(ids))
    packed = F.sort_array(F.collect_list(F.struct(F.col("pos"), *[F.col(v) for v in values])))
    windows = placed.groupBy(*keys, "window_id").agg(
        packed.alias("_packed"), F.count("*").cast("int").alias("size"), *[F.first(c).alias(c) for c in constants]
    )
    whole = F.col("size") == length
    keep = whole | (F.col("window_id") == 0) if pad_short else whole
    windows = windows.where(keep)
    arrays = [pad_to(F.col("_packed").getField(v), length).alias(v) for v in values]
    return windows.select(*keys, "window_id", "size", *constants, *arrays)


def series_windows(
    readings: DataFrame,
    length: int,
    stride: int | None = None,
    keys: Sequence[str] = SERIES_KEY,
    tie: Sequence[str] = (),
    pad_short: bool = True,
    spread: bool | str = False,
    times: bool = True,
) -> DataFrame:
    """Readings to windows in scaled units: filled, cut, and scaled by the own series.

    Output: key, ``window_id``, ``size``, ``median``, ``scale``, ``times`` (unless unwanted), ``values``.
    """
    keys = list(keys)
    # of the readings as they are: the filled ones would move through their slots once more; one row a series stays of all that this moves
    scaler = released(robust_scaler(readings, keys, spread=spread)) if spread else None
    # filling first: its sort also serves the scaler's window
    filled = fill_gaps(readings, keys, tie=tie, spread=spread)
    if spread:
        filled = _attach(filled, scaler, keys, ["median", "scale"], spread == FEW)
    else:
        filled = with_scaler(filled, keys)
    wide = filled.withColumn("times", F.col("ts"))
    packed = ("filled", "times") if times else ("filled",)
    windows = fixed_windows(wide, length, stride, keys, packed, ("median", "scale"), pad_short)
    z = F.transform("filled", lambda v: scaled(v, F.col("median"), F.col("scale")))
    return windows.withColumn("values", z).drop("filled")


def full_groups(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Drop groups with fewer than ``rows`` rows."""
    keys = list(keys)
    enough = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= rows)
    return df.join(enough, same_key(df, enough, keys), "left_semi")


def annual_quantile(
    windows: DataFrame, array: str, quantile: float, keys: Sequence[str] = SERIES_KEY, spread: bool | str = False, out: str = "peak"
) -> DataFrame:
    """High quantile over all points of all windows of a series; NULL when no point is finite."""
    # the outer form: a plain explode makes the optimiser evaluate the array twice, to test its size
    points = windows.select(*keys, F.explode_outer(array).alias("_x"))
    present = F.when(~F.isnan("_x") & (F.abs("_x") < F.lit(float("inf"))), F.col("_x"))
    return exact_quantiles(points.withColumn("_x", present), keys, "_x", {out: quantile}, spread)
