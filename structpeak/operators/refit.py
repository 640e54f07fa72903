"""Label-guided refit: a limit on the codes, chosen on labels and a reconstruction pool."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structpeak.config import SERIES_KEY
from structpeak.operators.model import Denoiser, batch_codes, limited, list_matrix, model_inputs

BAND = 500  # e^500 times any count of rows stays a finite double


def soft_peak(df: DataFrame, keys: Sequence[str], value: str, tau: float, out: str = "soft_peak") -> DataFrame:
    """Softmax-weighted mean ``sum(e^(x/tau) x) / sum(e^(x/tau))`` per group.

    Values fall into bands of ``BAND * tau`` and weigh relative to the foot of their band, so
    no weight overflows and one pass of partial sums is enough: only a few band rows per
    group are shuffled, never the values.
    """
    keys = list(keys)
    step = BAND * tau
    band = F.floor(F.col(value) / F.lit(step))
    weight = F.exp((F.col(value) - F.col("_band") * F.lit(step)) / F.lit(tau))
    bands = df.where(F.col(value).isNotNull()).withColumn("_band", band).groupBy(*keys, "_band").agg(
        F.sum(weight).alias("_total"), F.sum(weight * F.col(value)).alias("_moment")
    )
    top = F.max("_band").over(Window.partitionBy(*keys))
    lowered = bands.withColumn("_factor", F.exp((F.col("_band") - top) * F.lit(float(BAND))))
    return lowered.groupBy(*keys).agg(
        (F.sum(F.col("_factor") * F.col("_moment")) / F.sum(F.col("_factor") * F.col("_total"))).alias(out)
    )


def labelled_examples(windows: DataFrame, labels: DataFrame, keys: Sequence[str] = SERIES_KEY, label: str = "label") -> DataFrame:
    """Windows of labelled series with the label in the series' own scaled units."""
    joined = windows.join(labels.select(*keys, label), list(keys), "inner")
    return joined.withColumn("label_scaled", (F.col(label) - F.col("median")) / F.col("scale"))


def _label_parts(model: Denoiser, grid: Sequence[float], keys: Sequence[str]):
    """Task function: for each labelled window and limit, weight and weighted sum relative to the foot of its band, as in ``soft_peak``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tau = model.config.tau
        for batch in batches:
            codes, n = batch_codes(batch, model), batch.num_rows
            for at, kappa in enumerate(grid):
                seen = limited(codes, model, kappa) @ model.decode
                band = np.floor(seen.max(axis=1) / (BAND * tau))
                weight = np.exp((seen - band[:, None] * BAND * tau) / tau)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(k) for k in keys], batch.column("label_scaled"), pa.array(np.full(n, at)), pa.array(band.astype(np.int64)),
                    pa.array(weight.sum(axis=1)), pa.array((weight * seen).sum(axis=1)),
                ], [*keys, "label_scaled", "at", "band", "total", "moment"])

    return run


def _pool_parts(model: Denoiser, grid: Sequence[float], values: str):
    """Task function: sum of the windows' mean absolute errors under every limit, and how many windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(grid)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, clean = batch_codes(batch, model, values), list_matrix(batch.column("target"), model.config.length)
            total += [np.abs(limited(codes, model, kappa) @ model.decode - clean).mean(axis=1).sum() for kappa in grid]
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid))), pa.array(total), pa.array([n] * len(grid))], ["at", "total", "n"])

    return run


def kappa_losses(
    labelled: DataFrame,
    pool: DataFrame,
    model: Denoiser,
    grid: Sequence[float],
    weight: float = 8.0,
    keys: Sequence[str] = SERIES_KEY,
    pool_input: str = "values",
) -> DataFrame:
    """Per candidate: pool reconstruction error plus weighted distance of soft peaks to labels.

    Encoder and decoder stay as they are. ``pool_input`` names the array the pool is encoded
    from; its target is always the clean ``values``. Windows are encoded once and tried under all limits
    in the same task: a labelled window sends its band, weight and
    weighted sum a limit, the pool one sum a limit and task.
    """
    keys, grid = list(keys), [float(k) for k in grid]
    registry = list(zip(model_inputs(labelled, model.config), ("values", "level", "level_delta"), strict=False))
    schema = ", ".join(f"`{k}` {labelled.schema[k].dataType.simpleString()}" for k in keys) + ", label_scaled double, at long, band long, total double, moment double"
    sent = labelled.select(*keys, F.col("label_scaled").cast("double").alias("label_scaled"), *[c.alias(n) for c, n in registry]).mapInArrow(_label_parts(model, grid, keys), schema)
    bands = sent.groupBy(*keys, "at", "band").agg(F.sum("total").alias("total"), F.sum("moment").alias("moment"), F.first("label_scaled").alias("label_scaled"))
    factor = F.exp((F.col("band") - F.max("band").over(Window.partitionBy(*keys, "at"))) * F.lit(float(BAND)))
    peaks = bands.withColumn("_f", factor).groupBy(*keys, "at").agg(
        (F.sum(F.col("_f") * F.col("moment")) / F.sum(F.col("_f") * F.col("total"))).alias("soft"), F.first("label_scaled").alias("label_scaled")
    )
    label_loss = peaks.groupBy("at").agg(F.avg(F.abs(F.col("soft") - F.col("label_scaled"))).alias("label_loss"), F.count("*").alias("n_labelled"))
    others = [(c, n) for c, n in zip(model_inputs(pool, model.config, pool_input), (pool_input, "level", "level_delta"), strict=False)]
    sums = pool.select(F.col("values").alias("target"), *[c.alias(n) for c, n in others]).mapInArrow(_pool_parts(model, grid, pool_input), "at long, total double, n long")
    pool_loss = sums.groupBy("at").agg((F.sum("total") / F.sum("n")).alias("pool_loss"))
    limits = F.array(*[F.lit(k) for k in grid])
    return pool_loss.join(F.broadcast(label_loss), "at", "left").select(  # one row a limit
        F.get(limits, F.col("at").cast("int")).alias("kappa"), "pool_loss", "label_loss", "n_labelled",
        (F.col("pool_loss") + F.lit(weight) * F.coalesce(F.col("label_loss"), F.lit(0.0))).alias("loss"),
    )


def refit(labelled: DataFrame, pool: DataFrame, model: Denoiser, grid: Sequence[float], version: str, **options) -> Denoiser:
    """The model with the best limit of the grid (ties go to the wider limit)."""
    best = kappa_losses(labelled, pool, model, grid, **options).orderBy("loss", F.col("kappa").desc()).head()
    return replace(model, kappa=float(best["kappa"]), version=version)
