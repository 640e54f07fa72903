"""Readings to a fitted model: sample, window, fit; and the label-guided refit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structpeak.config import SERIES_KEY, PeakConfig
from structpeak.operators.contamination import contaminated_copies
from structpeak.operators.hotkeys import by_group_size
from structpeak.operators.model import Denoiser, fit_denoiser
from structpeak.operators.refit import labelled_examples, refit
from structpeak.operators.registry import align_windows, registry_stats
from structpeak.operators.sampling import rows_of_sample, sample_entities, sample_windows
from structpeak.operators.series import series_windows

KAPPA_GRID = (float("inf"), 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.25)


def config_with_stats(config: PeakConfig, months: DataFrame | None) -> PeakConfig:
    """Store the registry's global statistics in the configuration that goes with the model."""
    if months is None:
        return config
    row = registry_stats(months).head()
    return replace(config, level_mean=row["level_mean"], level_std=row["level_std"], delta_std=row["delta_std"])


def _windows(readings: DataFrame, config: PeakConfig, months: DataFrame | None, tie: Sequence[str], pad_short: bool) -> DataFrame:
    def build(part: DataFrame, spread: bool | str) -> DataFrame:
        return series_windows(part, config.length, tie=tie, pad_short=pad_short, spread=spread)

    windows = by_group_size(readings, SERIES_KEY, build)
    if months is None:
        return windows
    stats = {"level_mean": config.level_mean, "level_std": config.level_std, "delta_std": config.delta_std}
    return align_windows(windows, months, stats)


def training_windows(
    readings: DataFrame, config: PeakConfig, months: DataFrame | None = None, tie: Sequence[str] = (), seed_shift: int = 0
) -> DataFrame:
    """All windows of all series, or of a sample where the configuration asks for one.

    Series shorter than one window are left out of training.
    """
    if config.sample_entities is not None:
        readings = rows_of_sample(readings, sample_entities(readings, config.sample_entities, config.seed))
    windows = _windows(readings, config, months, tie, pad_short=False)
    return windows if config.windows_per_series is None else sample_windows(windows, config.windows_per_series, config.seed + seed_shift)


def train(
    readings: DataFrame, config: PeakConfig, months: DataFrame | None = None, tie: Sequence[str] = (), version: str = "unversioned"
) -> Denoiser:
    config = config_with_stats(config, months)
    return fit_denoiser(training_windows(readings, config, months, tie), config, version=version)


def refit_on_labels(
    readings: DataFrame,
    labels: DataFrame,
    model: Denoiser,
    months: DataFrame | None = None,
    tie: Sequence[str] = (),
    version: str = "unversioned",
    grid: Sequence[float] = KAPPA_GRID,
    weight: float = 8.0,
) -> Denoiser:
    """Second model version: the code limit that brings labelled peaks nearest to their labels.

    ``labels`` has one row per series with ``label``; with a ``measure`` column, only labels of the
    model's measure count. A second label of a series fails the job. Only labelled series are windowed for
    the label part. The pool is encoded from contaminated copies and compared with the clean windows.
    """
    keys = list(SERIES_KEY)
    if "measure" in labels.columns:
        labels = labels.where(F.col("measure") == model.config.measure)
    single = F.when(F.count("*") == 1, F.first("label")).otherwise(F.raise_error(F.lit("several labels for one series")).cast("double"))
    labels = labels.groupBy(*keys).agg(single.alias("label"))
    labelled = readings.join(labels.select(*keys), keys, "left_semi")
    examples = labelled_examples(_windows(labelled, model.config, months, tie, pad_short=True), labels)
    pool = training_windows(readings, model.config, months, tie, seed_shift=1)
    dirty = contaminated_copies(pool, model.config)
    return refit(examples, dirty, model, grid, version, weight=weight, pool_input="contaminated")
