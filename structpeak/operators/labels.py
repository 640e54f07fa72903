"""Expert labels: latest value per key, pairing with results, linear calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structpeak.config import RESULT_KEY


def latest_per_key(
    log: DataFrame, keys: Sequence[str], value: str, ts: str, tie: Sequence[str] = (), out: str | None = None
) -> DataFrame:
    """Last present value per key; keys whose values are all missing give NULL."""
    order = F.struct(*[F.col(c) for c in (ts, *tie)])
    present = F.when(F.col(value).isNotNull(), order)
    return log.groupBy(*keys).agg(F.max_by(value, present).alias(out or value))


def with_labels(results: DataFrame, labels: DataFrame, keys: Sequence[str] = RESULT_KEY) -> DataFrame:
    """Every result row with its label if there is one; labels without a result vanish."""
    return results.join(labels, list(keys), "left")


def line_columns(x: str, y: str) -> tuple[Column, Column]:
    """Least-squares slope and intercept; (1, 0) with fewer than two pairs or constant x."""
    usable = (F.regr_count(y, x) >= 2) & (F.coalesce(F.regr_sxx(y, x), F.lit(0.0)) > 0)
    return (
        F.when(usable, F.regr_slope(y, x)).otherwise(F.lit(1.0)),
        F.when(usable, F.regr_intercept(y, x)).otherwise(F.lit(0.0)),
    )


def calibration_line(pairs: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per group (or one row): slope, intercept and the number of pairs."""
    slope, intercept = line_columns(x, y)
    grouped = pairs.groupBy(*by)
    return grouped.agg(slope.alias("slope"), intercept.alias("intercept"), F.regr_count(y, x).alias("n_pairs"))


def calibrated(results: DataFrame, line: DataFrame, x: str, out: str) -> DataFrame:
    """Apply a one-row calibration to every row, labelled or not."""
    return results.withColumn(out, line.select("slope").scalar() * F.col(x) + line.select("intercept").scalar())


def production_override(results: DataFrame, label: str, estimate: str, out: str) -> DataFrame:
    """Published value: the label where there is one, else the estimate. Never evaluated."""
    return results.withColumn(out, F.coalesce(F.col(label), F.col(estimate)))


def labelled_series(readings: DataFrame, labels: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Readings of every labelled series with the label beside, in one join for all labels."""
    return readings.join(labels.select(*keys, label), list(keys), "inner")
