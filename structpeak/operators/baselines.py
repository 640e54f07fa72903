"""Peak baselines without a model: raw maximum, quantiles, Hampel filter, sustained level, segments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structpeak.config import SERIES_KEY
from structpeak.operators.hotkeys import by_group_size
from structpeak.operators.ordering import exact_quantiles, radix_quantiles
from structpeak.operators.series import fill_gaps, position_index

CHUNK = 50_000  # positions one task handles of a spread series
MAD_TO_SIGMA = 1.4826  # fixed value: normal consistency factor of the median absolute deviation


def raw_maximum(readings: DataFrame, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    return readings.groupBy(*keys).agg(F.max("value").alias("raw_max"))


def raw_quantiles(readings: DataFrame, quantiles: dict[str, float], keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """High quantiles of the readings as they are; those of large series by radix selection."""

    def build(part: DataFrame, spread: bool | str) -> DataFrame:
        return radix_quantiles(part, keys, "value", quantiles, spread) if spread else exact_quantiles(part, keys, "value", quantiles)

    return by_group_size(readings, keys, build)


def chunked(indexed: DataFrame, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """Cut numbered rows into position chunks with neighbours repeated across the borders.

    Adds ``_chunk`` and ``_own``; a frame of ``before`` and ``after`` rows is complete for
    every own row, so a long series can be framed chunk by chunk.
    """
    lowest = F.greatest(F.expr(f"(pos - 1 - {after}) div {chunk}"), F.lit(0).cast("bigint"))
    highest = F.expr(f"(pos - 1 + {before}) div {chunk}")
    return indexed.withColumn("_chunk", F.explode(F.sequence(lowest, highest))).withColumn(
        "_own", F.expr(f"(pos - 1) div {chunk}") == F.col("_chunk")
    )


def _framed(readings, keys, tie, spread, before, after, build, filled=False, chunk=CHUNK) -> DataFrame:
    """Number the rows, then let ``build(df, window)`` add framed columns by position."""
    number = fill_gaps if filled else position_index
    indexed = number(readings, keys, tie=tie, spread=spread)
    if not spread:
        return build(indexed, Window.partitionBy(*keys).orderBy("ts", *tie))
    cut = chunked(indexed, before, after, chunk)
    out = build(cut, Window.partitionBy(*keys, "_chunk").orderBy("pos"))
    return out.where("_own").drop("_chunk", "_own")


def _array_median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    low = F.get(s, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, (low + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def hampel_filter(
    readings: DataFrame, half: int = 3, limit: float = 3.0, keys: Sequence[str] = SERIES_KEY, tie: Sequence[str] = (),
    spread: bool | str = False, chunk: int = CHUNK,
) -> DataFrame:
    """Replace readings far from the median of their ``2 * half + 1`` neighbours by that median.

    Far means more than ``limit`` scaled median absolute deviations. Adds ``cleaned``.
    """

    def build(df: DataFrame, by_time) -> DataFrame:
        near = F.collect_list("value").over(by_time.rowsBetween(-half, half))
        with_mid = df.withColumn("_near", near).withColumn("_mid", _array_median(F.col("_near")))
        mad = _array_median(F.transform("_near", lambda x: F.abs(x - F.col("_mid"))))
        far = F.abs(F.col("value") - F.col("_mid")) > F.lit(limit * MAD_TO_SIGMA) * mad
        return with_mid.withColumn("cleaned", F.when(far, F.col("_mid")).otherwise(F.col("value"))).drop("_near", "_mid")

    return _framed(readings, list(keys), tie, spread, half, half, build, chunk=chunk)


def hampel_maximum(readings: DataFrame, half: int = 3, limit: float = 3.0, keys: Sequence[str] = SERIES_KEY, tie: Sequence[str] = ()) -> DataFrame:
    cleaned = by_group_size(readings, keys, lambda part, spread: hampel_filter(part, half, limit, keys, tie, spread))
    return cleaned.groupBy(*keys).agg(F.max("cleaned").alias("hampel_max"))


def sustained_level(
    readings: DataFrame, rows: int, keys: Sequence[str] = SERIES_KEY, tie: Sequence[str] = (), spread: bool | str = False, chunk: int = CHUNK
) -> DataFrame:
    """Add ``held``: the lowest filled value of the last ``rows`` readings, NULL until complete."""

    def build(df: DataFrame, by_time) -> DataFrame:
        low = F.min("filled").over(by_time.rowsBetween(-(rows - 1), 0))
        return df.withColumn("held", F.when(F.col("pos") >= rows, low))

    return _framed(readings, list(keys), tie, spread, rows - 1, 0, build, filled=True, chunk=chunk)


def sustained_maximum(readings: DataFrame, rows: int, keys: Sequence[str] = SERIES_KEY, tie: Sequence[str] = ()) -> DataFrame:
    """Largest level held over ``rows`` consecutive readings."""
    held = by_group_size(readings, keys, lambda part, spread: sustained_level(part, rows, keys, tie, spread))
    return held.groupBy(*keys).agg(F.max("held").alias("sustained_max"))


def daily_medians(readings: DataFrame, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Median and maximum of every day of a series: at most 366 rows per series-year."""
    day_key = [*keys, "day"]

    def build(part: DataFrame, spread: bool | str) -> DataFrame:
        # a day can only be too large for one task when its series is
        if spread:
            medians = exact_quantiles(part, day_key, "value", {"day_median": 0.5}, spread)
            tops = part.groupBy(*day_key).agg(F.max("value").alias("day_max"))
            return tops.join(medians, day_key).where(F.col("day_median").isNotNull())
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*day_key, "value"]])
        # one exchange by series serves the ranks of a day, its median and what follows
        placed = part.where(known).select(*day_key, "value").repartition(*keys)
        day = Window.partitionBy(*day_key)
        ranked = placed.withColumn("_rank", F.row_number().over(day.orderBy("value"))).withColumn("_rows", F.count("*").over(day))
        middle = [F.max(F.when(F.col("_rank") == F.expr(f"(_rows + {k}) div 2"), F.col("value"))) for k in (1, 2)]
        return ranked.groupBy(*day_key).agg(F.max("value").alias("day_max"), (0.5 * middle[0] + 0.5 * middle[1]).alias("day_median"))

    return by_group_size(readings.withColumn("day", F.to_date("ts")), keys, build)


def level_segments(days: DataFrame, half: int = 7, limit: float = 1.5, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Number the level segments of each series from its daily medians.

    A segment starts where the median of the next ``half`` days differs from that of the
    last ``half`` days by more than ``limit`` times the series' own interquartile range,
    and the day before did not already.
    """
    by_day = Window.partitionBy(*keys).orderBy("day")
    group = Window.partitionBy(*keys)
    quartiles = F.percentile("day_median", F.array(F.lit(0.25), F.lit(0.75))).over(group)
    left = F.percentile("day_median", F.lit(0.5)).over(by_day.rowsBetween(-half, -1))
    right = F.percentile("day_median", F.lit(0.5)).over(by_day.rowsBetween(0, half - 1))
    return (
        days.withColumn("shift", right - left)
        .withColumn("_q", quartiles)
        .withColumn("_over", F.coalesce(F.abs("shift") > F.lit(limit) * (F.col("_q")[1] - F.col("_q")[0]), F.lit(False)))
        .withColumn("_start", F.col("_over") & ~F.coalesce(F.lag("_over").over(by_day), F.lit(False)))
        .withColumn("segment", F.sum(F.col("_start").cast("int")).over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("series_range", F.col("_q")[1] - F.col("_q")[0])
        .drop("_q", "_over", "_start")
    )


def segment_features(segments: DataFrame, keys: Sequence[str] = SERIES_KEY, months: DataFrame | None = None) -> DataFrame:
    """One row per segment: level, length, season, return to the earlier level, registry change."""
    keys = list(keys)
    if months is not None:
        side = months.select(
            F.col("region").alias("_region"), F.col("entity").alias("_entity"),
            (F.col("year") * 12 + F.col("month")).alias("_m"), F.abs("level_delta").alias("network_change"),
        )
        at = F.year("day") * 12 + F.month("day")
        match = (F.col("region") == F.col("_region")) & (F.col("entity") == F.col("_entity")) & (at == F.col("_m"))
        segments = segments.join(side, match, "left").drop("_region", "_entity", "_m")
    else:
        segments = segments.withColumn("network_change", F.lit(0.0))
    rows = segments.groupBy(*keys, "segment").agg(
        F.percentile("day_median", 0.5).alias("segment_level"),
        F.max("day_max").alias("segment_max"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count("*").alias("n_days"),
        F.max("series_range").alias("series_range"),
        F.coalesce(F.max("network_change"), F.lit(0.0)).alias("network_change"),
    )
    order = Window.partitionBy(*keys).orderBy("segment")
    back = F.abs(F.lead("segment_level").over(order) - F.lag("segment_level").over(order))
    return (
        rows.withColumn("span_days", F.date_diff("last_day", "first_day") + 1)
        .withColumn("season", F.quarter("first_day"))
        .withColumn("returns", F.coalesce(back <= F.col("series_range"), F.lit(False)))
    )


def vote_segments(features: DataFrame, short_days: int, large_change: float) -> DataFrame:
    """Rule votes: a short segment that returns is a manoeuvre; a large network change speaks against."""
    manoeuvre = (F.col("returns") & (F.col("span_days") < short_days)).cast("int")
    legitimate = (F.col("network_change") > large_change).cast("int")
    return (
        features.withColumn("vote_manoeuvre", manoeuvre)
        .withColumn("vote_legitimate", legitimate)
        .withColumn("votes", manoeuvre - legitimate)
        .withColumn("is_normal", (manoeuvre - legitimate) <= 0)
    )


def normal_segment_maximum(voted: DataFrame, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Maximum over the segments the rules left as normal."""
    return voted.groupBy(*keys).agg(
        F.max(F.when(F.col("is_normal"), F.col("segment_max"))).alias("segment_peak"),
        F.count("*").alias("n_segments"),
        F.sum((~F.col("is_normal")).cast("int")).alias("n_excluded"),
    )


def data_audit(readings: DataFrame, labels: DataFrame, months: DataFrame) -> DataFrame:
    """Per region and year: series, readings, missing values, label share and registry months."""
    by = ["region", "year"]
    per_series = readings.groupBy(*by, "entity").agg(F.count("*").alias("_n"), F.count("value").alias("_v"))
    counts = per_series.groupBy(*by).agg(
        F.count("*").alias("n_series"), F.sum("_n").alias("n_readings"), F.sum(F.col("_n") - F.col("_v")).alias("missing"))
    labelled = labels.groupBy(*by).agg(F.count("label").alias("n_labels"))
    known = months.groupBy(*by).agg(F.count("*").alias("registry_months"))
    zero = F.lit(0).cast("bigint")
    out = counts.join(labelled, by, "left").join(known, by, "left")
    out = out.withColumn("n_labels", F.coalesce("n_labels", zero)).withColumn("registry_months", F.coalesce("registry_months", zero))
    return out.withColumn("label_share", F.col("n_labels") / F.col("n_series"))
