"""Out-of-fold evaluation and error metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structpeak.functions.scalars import relative_error
from structpeak.operators.hotkeys import MANY, TASK_ROWS, small_enough
from structpeak.operators.labels import line_columns
from structpeak.operators.ordering import exact_quantiles
from structpeak.operators.sampling import fold_assignment

FEWEST_PAIRS = 10


def out_of_fold(pairs: DataFrame, x: str, y: str, k: int, seed: int, entity: str = "entity") -> DataFrame:
    """Predictions for each pair from a line fitted without its entity's fold.

    Only h0 values enter; a label never reaches its own prediction. Folds without two
    training rows give no prediction. Each pair feeds the partial sums of the k-1 other
    folds, so only k rows of sums are shuffled per task.
    """
    folds = fold_assignment(pairs, k, seed, entity)
    placed = pairs.join(folds, entity)
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    slope, intercept = line_columns(x, y)
    lines = (
        placed.select(F.explode(others).alias("_fold"), x, y).groupBy("_fold")
        .agg(slope.alias("slope"), intercept.alias("intercept"), F.count("*").alias("n_train"))
        .where(F.col("n_train") >= 2)
    )
    return placed.join(F.broadcast(lines), placed["fold"] == lines["_fold"]).withColumn(  # k rows
        "predicted", F.col("slope") * F.col(x) + F.col("intercept")
    ).drop("_fold")


def _too_many(df: DataFrame, spread: bool | None) -> bool:
    return not small_enough(df, TASK_ROWS) if spread is None else spread


def _grouped(df: DataFrame, by: Sequence[str], aggs: list, medians: dict[str, str], spread: bool) -> DataFrame:
    """Aggregates and exact medians per group; medians of large sets come from ordered buckets."""
    if not spread:
        return df.groupBy(*by).agg(*aggs, *[F.percentile(c, 0.5).alias(n) for n, c in medians.items()])
    out = df.groupBy(*by).agg(*aggs)
    for n, c in medians.items():
        found = exact_quantiles(df, by, c, {n: 0.5}, spread=MANY)
        if not by:
            out = out.withColumn(n, found.select(n).scalar())
            continue
        side = found.select(*[F.col(k).alias(f"_m_{k}") for k in by], n)
        match = F.lit(True)
        for k in by:
            match = match & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
        out = out.join(side, match, "left").drop(*[f"_m_{k}" for k in by])
    return out


def error_metrics(
    predictions: DataFrame, predicted: str, actual: str, by: Sequence[str] = (), spread: bool | None = None
) -> DataFrame:
    """MAE, median relative error, hit rates and n, overall and per group.

    The overall row has NULL group columns and ``overall = true``. While one task can hold
    all predictions both levels come from one pass of grouping sets; ``spread=None`` counts.
    """
    rel = F.col("_rel")
    aggs = [
        F.avg(F.abs("_err")).alias("mae"),
        F.avg((rel <= 0.05).cast("double")).alias("hit_05"),
        F.avg((rel <= 0.10).cast("double")).alias("hit_10"),
        F.count("*").alias("n"),
    ]
    base = predictions.withColumn("_err", F.col(predicted) - F.col(actual)).withColumn(
        "_rel", relative_error(F.col(predicted), F.col(actual))
    )
    if _too_many(predictions, spread):
        overall = _grouped(base, [], aggs, {"median_ape": "_rel"}, True).withColumn("overall", F.lit(True))
        if not by:
            return overall
        grouped = _grouped(base, list(by), aggs, {"median_ape": "_rel"}, True).withColumn("overall", F.lit(False))
        return grouped.unionByName(overall, allowMissingColumns=True)
    aggs.append(F.percentile(rel, 0.5).alias("median_ape"))
    if not by:
        return base.agg(*aggs).withColumn("overall", F.lit(True))
    columns = [F.col(b) for b in by]
    return base.groupingSets([columns, []], *columns).agg(*aggs, (F.grouping_id() > 0).alias("overall"))


def gated_metrics(pairs: DataFrame, metrics: DataFrame, fewest: int = FEWEST_PAIRS) -> DataFrame:
    """Metrics with a status; below ``fewest`` pairs only the warning row remains."""
    enough = pairs.agg(F.count("*").alias("n_pairs")).withColumn("enough", F.col("n_pairs") >= fewest)
    status = F.when(F.col("enough"), F.lit("ok")).otherwise(F.lit("too few labelled pairs"))
    shown = metrics.withColumn("_on", F.lit(True))
    return enough.withColumn("status", status).join(shown, F.col("enough") == F.col("_on"), "left").drop("_on", "enough")


def wide_metrics(
    predictions: DataFrame, predicted: str, actual: str, by: Sequence[str] = (), tau: float = 0.9, spread: bool | None = None
) -> DataFrame:
    """RMSE, MAPE, mean and median signed error, share under and pinball loss."""
    base = predictions.withColumn("_err", F.col(predicted) - F.col(actual))
    err = F.col("_err")
    aggs = [
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(relative_error(F.col(predicted), F.col(actual))).alias("mape"),
        F.avg(err).alias("bias"),
        F.avg((err < 0).cast("double")).alias("under_share"),
        F.avg(F.greatest(F.lit(-tau) * err, F.lit(1 - tau) * err)).alias("pinball"),
        F.count("*").alias("n"),
    ]
    return _grouped(base, list(by), aggs, {"median_error": "_err"}, _too_many(predictions, spread))


def tolerance_curve(predictions: DataFrame, predicted: str, actual: str, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Hit rate over a grid of tolerances."""
    rel = relative_error(F.col(predicted), F.col(actual))
    points = predictions.withColumn("epsilon", F.explode(F.array(*[F.lit(e) for e in grid])))
    return points.groupBy(*by, "epsilon").agg(F.avg((rel <= F.col("epsilon")).cast("double")).alias("hit_rate"), F.count("*").alias("n"))


def size_class(value, bounds: dict[str, float], rest: str):
    """Name of the first class whose upper bound lies above the value."""
    out = None
    for name, upper in bounds.items():
        out = F.when(value < upper, F.lit(name)) if out is None else out.when(value < upper, F.lit(name))
    return out.otherwise(F.lit(rest))


def with_recorded(predictions: DataFrame, records: DataFrame, keys: Sequence[str], name: str = "difficult") -> DataFrame:
    """Adds ``name``: whether ``records`` (say, switching operations) has the pair's keys at all.

    Records may repeat; only their distinct keys are joined. A null in a key equals a null.
    """
    if name in predictions.columns:
        raise ValueError(f"there is a column {name} already")
    # numbered names, so that no column of the predictions clashes
    seen = records.select(*[F.col(k).alias(f"recorded {i}") for i, k in enumerate(keys)]).distinct().withColumn("recorded", F.lit(True))
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & predictions[k].eqNullSafe(seen[f"recorded {i}"])
    return predictions.join(seen, match, "left").select(*[predictions[c] for c in predictions.columns], seen["recorded"].isNotNull().alias(name))


def by_time(pairs: DataFrame, last_fit_year: int) -> DataFrame:
    """Temporal split: fit up to a year, test on the following one, later years unused."""
    part = (
        F.when(F.col("year") <= last_fit_year, F.lit("fit"))
        .when(F.col("year") == last_fit_year + 1, F.lit("next_year")).otherwise(F.lit("unused"))
    )
    return pairs.withColumn("part", part)
