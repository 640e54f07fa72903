"""Synthetic contamination of scaled windows: plateaus, spikes and noise from seeded draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structpeak.config import SERIES_KEY, PeakConfig
from structpeak.functions.arrays import assemble_channels, bound
from structpeak.functions.draws import gaussian, key_seed, uniform

# Streams of a window's seed, one per draw.
PLATEAU_ON, PLATEAU_START, PLATEAU_LENGTH, PLATEAU_SIGN, PLATEAU_SIZE = 1, 2, 3, 4, 5
SPIKE_ON, SPIKE_COUNT, SPIKE_PLACE, SPIKE_SIGN, SPIKE_SIZE = 6, 7, 8, 11, 14
NOISE = 100
# Column of a window's copies.
COPIES = "_copies"


def _sign(u: Column) -> Column:
    return F.when(u < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))


def _drawn_events(seed: Column, config: PeakConfig) -> Column:
    """Plateau bounds and size, and up to three spikes, of one window."""
    n = config.length
    start = F.floor(uniform(seed, PLATEAU_START) * n)
    stop = F.least(F.lit(n), start + n // 8 + F.floor(uniform(seed, PLATEAU_LENGTH) * (n - n // 8)))
    plateau = F.when(
        uniform(seed, PLATEAU_ON) < config.plateau_probability,
        config.plateau_amplitude * _sign(uniform(seed, PLATEAU_SIGN)) * (0.5 + uniform(seed, PLATEAU_SIZE)),
    ).otherwise(F.lit(0.0))
    spiky = uniform(seed, SPIKE_ON) < config.spike_probability
    count = F.when(spiky, 1 + F.floor(uniform(seed, SPIKE_COUNT) * 3)).otherwise(F.lit(0))
    spikes = F.array(*[
        F.struct(
            F.floor(uniform(seed, SPIKE_PLACE + j) * n).alias("place"),
            (config.spike_amplitude * _sign(uniform(seed, SPIKE_SIGN + j)) * (0.5 + uniform(seed, SPIKE_SIZE + j))).alias("size"),
        )
        for j in range(3)
    ])
    return F.struct(start.alias("start"), stop.alias("stop"), plateau.alias("plateau"),
                    F.slice(spikes, F.lit(1), count.cast("int")).alias("spikes"))


def contaminate(values: Column, seed: Column, config: PeakConfig) -> Column:
    """Contaminated copy of one window; every draw comes from ``seed``.

    Two spikes drawn at the same place overwrite each other, they do not add. Seed and
    events are evaluated once per window, then read for every point.
    """

    def point(v: Column, i: Column, s: Column, f: Column) -> Column:
        held = F.when((i >= f["start"]) & (i < f["stop"]), f["plateau"]).otherwise(F.lit(0.0))
        hits = F.filter(f["spikes"], lambda k: k["place"] == i)
        spike = F.coalesce(F.try_element_at(hits, F.lit(-1))["size"], F.lit(0.0))
        return v + held + spike + config.noise * gaussian(s, F.lit(NOISE) + 2 * i)

    return bound(seed, lambda s: bound(_drawn_events(s, config), lambda f: F.transform(values, lambda v, i: point(v, i, s, f))))


def with_copies(windows: DataFrame, config: PeakConfig, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Every window with its ``replicas`` contaminated copies in one array."""
    def copy(replica: int) -> Column:
        seed = key_seed(F.lit(str(config.seed)), F.lit(replica), *[F.col(k) for k in keys], F.col("window_id"))
        return F.struct(F.lit(replica).alias("replica"), seed.alias("noise_seed"),
                        contaminate(F.col("values"), seed, config).alias("contaminated"))

    return windows.withColumn(COPIES, F.array(*[copy(r) for r in range(1, config.replicas + 1)]))


def contaminated_copies(windows: DataFrame, config: PeakConfig, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """``replicas`` contaminated copies of every window, with the clean target kept beside; those of :func:`with_copies` where it was called before."""
    if COPIES not in windows.columns:
        windows = with_copies(windows, config, keys)
    return windows.select(*[c for c in windows.columns if c != COPIES], F.inline_outer(COPIES))


def with_channels(windows: DataFrame, config: PeakConfig, values: str = "values") -> DataFrame:
    """Add the five-channel struct built from ``values`` and the aligned registry arrays.

    The model builds the same channels batch-wise on the workers instead.
    """
    zeros = F.transform(F.col(values), lambda v: F.lit(0.0))
    level = F.col("level") if "level" in windows.columns else zeros
    delta = F.col("level_delta") if "level_delta" in windows.columns else zeros
    return windows.withColumn("channels", assemble_channels(F.col(values), level, delta, config.spread_width))
