"""Monthly registry: month-to-month change, global statistics and alignment with readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAT = 1e-9


def registry_months(
    raw: DataFrame,
    region: str = "region",
    entity: str = "entity",
    year: str = "year",
    month: str = "month",
    period: str = "period",
    level: str = "level",
) -> DataFrame:
    """Clean registry with ``level_delta``: the change to the previous stored month of the entity.

    Months without a level are dropped first, so the change spans the gap; the first month's
    change is zero. Key texts are trimmed; of several rows
    for one month (equal keys after trimming) the last one stays. An entity has one row per month, so its window
    is bounded by the calendar.
    """
    kept = raw.select(
        F.col(region).alias("region"), F.col(entity).alias("entity"), F.col(year).cast("int").alias("year"),
        F.col(month).cast("int").alias("month"), F.col(period).alias("period"), F.col(level).cast("double").alias("level"),
    ).where(F.col("level").isNotNull() & ~F.isnan("level"))
    by_month = Window.partitionBy("region", "entity").orderBy("period")
    change = F.col("level") - F.lag("level").over(by_month)
    trimmed = kept.withColumn("level_delta", F.coalesce(change, F.lit(0.0))).select(
        F.trim(F.col("region").cast("string")).alias("region"), F.trim(F.col("entity").cast("string")).alias("entity"),
        "year", "month", "period", "level", "level_delta",
    )
    last = F.max_by(F.struct("period", "level", "level_delta"), F.struct("period", "level", "level_delta")).alias("_last")
    return trimmed.groupBy("region", "entity", "year", "month").agg(last).select("region", "entity", "year", "month", "_last.*")


def registry_stats(months: DataFrame) -> DataFrame:
    """One row: mean and deviation of the level, deviation of the change, with safe defaults."""
    def safe(c: str) -> Column:
        sd = F.stddev_pop(c)
        return F.when(sd > FLAT, sd).otherwise(F.lit(1.0))

    return months.agg(
        F.coalesce(F.avg("level"), F.lit(0.0)).alias("level_mean"),
        safe("level").alias("level_std"),
        safe("level_delta").alias("delta_std"),
    )


def _safe_scale(s: Column) -> Column:
    return F.when(s > FLAT, s).otherwise(F.lit(1.0))


def normal_level(level: Column, mean: Column, std: Column) -> Column:
    return F.coalesce((level - mean) / _safe_scale(std), F.lit(0.0))


def normal_delta(delta: Column, std: Column) -> Column:
    return F.coalesce(delta / _safe_scale(std), F.lit(0.0))


def _stat_columns(stats: DataFrame | dict) -> tuple[Column, Column, Column]:
    names = ("level_mean", "level_std", "delta_std")
    if isinstance(stats, dict):
        return tuple(F.lit(float(stats[n])) for n in names)
    return tuple(stats.select(n).scalar() for n in names)


def align_registry(readings: DataFrame, months: DataFrame, stats: DataFrame | dict, ts: str = "ts") -> DataFrame:
    """Add normalised ``level`` and ``level_delta`` of the reading's calendar month.

    A month the registry does not know reads as the mean level with no change. The registry
    side is broadcast only when the optimiser finds it small; otherwise the join shuffles on
    the full month key, which spreads one entity over its months.
    """
    mean, std, delta_std = _stat_columns(stats)
    side = months.select(
        F.col("region").alias("_region"), F.col("entity").alias("_entity"), F.col("year").alias("_year"),
        F.col("month").alias("_month"), F.col("level").alias("_level"), F.col("level_delta").alias("_delta"),
    )
    match = (
        (F.col("region") == F.col("_region")) & (F.col("entity") == F.col("_entity"))
        & (F.year(ts) == F.col("_year")) & (F.month(ts) == F.col("_month"))
    )
    return (
        readings.join(side, match, "left")
        .withColumn("level", normal_level(F.col("_level"), mean, std))
        .withColumn("level_delta", normal_delta(F.col("_delta"), delta_std))
        .drop("_region", "_entity", "_year", "_month", "_level", "_delta")
    )


def align_windows(windows: DataFrame, months: DataFrame, stats: DataFrame | dict, times: str = "times") -> DataFrame:
    """The same alignment for whole windows: one join row per window instead of per reading.

    The months of an entity travel as one array without gaps (twelve entries a year), so a
    time stamp finds its month by position.
    """
    mean, std, delta_std = _stat_columns(stats)
    number = F.col("year") * 12 + F.col("month")
    entry = F.struct(
        normal_level(F.col("level"), mean, std).alias("level"), normal_delta(F.col("level_delta"), delta_std).alias("delta")
    )
    known = months.groupBy(F.col("region").alias("_region"), F.col("entity").alias("_entity")).agg(
        F.min(number).alias("_first"), F.max(number).alias("_last"),
        F.map_from_entries(F.collect_list(F.struct(number.alias("key"), entry.alias("value")))).alias("_known"),
    )
    dense = F.transform(F.sequence("_first", "_last"), lambda m: F.try_element_at("_known", m))
    side = known.select("_region", "_entity", "_first", dense.alias("_months"))
    match = (F.col("region") == F.col("_region")) & (F.col("entity") == F.col("_entity"))

    def found(t: Column) -> Column:
        at = F.year(t) * 12 + F.month(t) - F.col("_first")
        hit = F.when(at >= 0, F.get("_months", at))
        return F.struct(F.coalesce(hit["level"], F.lit(0.0)).alias("level"), F.coalesce(hit["delta"], F.lit(0.0)).alias("delta"))

    return (
        windows.join(side, match, "left")
        .withColumn("_found", F.transform(times, found))
        .withColumn("level", F.col("_found.level"))
        .withColumn("level_delta", F.col("_found.delta"))
        .drop("_region", "_entity", "_first", "_months", "_found")
    )

