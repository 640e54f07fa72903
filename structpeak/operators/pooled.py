"""Window codes pooled per series, and a shallow regressor on labelled series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structpeak.config import SERIES_KEY
from structpeak.operators.model import Denoiser, window_codes
from structpeak.operators.ordering import exact_quantiles
from structpeak.session import durable

POOL_QUANTILES = {"q10": 0.1, "q50": 0.5, "q90": 0.9}


def pooled_codes(windows: DataFrame, model: Denoiser, keys: Sequence[str] = SERIES_KEY, spread: bool | str = False) -> DataFrame:
    """One row per series: mean and quantiles of every code, in component order."""
    keys = list(keys)
    if not spread:
        # all codes in one pass over the windows, which stand together
        coded, shares = window_codes(windows, model).select(*keys, "codes"), F.array(*[F.lit(q) for q in POOL_QUANTILES.values()])
        each = [F.get("codes", F.lit(i)) for i in range(model.encode.shape[1])]
        found = [c.alias(f"_{n}{i}") for i, x in enumerate(each) for n, c in (("m", F.avg(x)), ("q", F.percentile(x, shares)))]
        parts = [F.concat(F.array(f"_m{i}"), F.col(f"_q{i}")) for i in range(len(each))]
        return coded.groupBy(*keys).agg(*found).select(*keys, F.concat(*parts).alias("summary"))
    codes = window_codes(windows, model).select(*keys, F.posexplode_outer("codes").alias("component", "code"))
    by = [*keys, "component"]
    means = codes.groupBy(*by).agg(F.avg("code").alias("mean"))
    parts = means.join(exact_quantiles(codes, by, "code", POOL_QUANTILES, spread), by)
    summary = F.array("mean", *POOL_QUANTILES)
    packed = F.array_sort(F.collect_list(F.struct("component", summary.alias("s"))))  # one entry per component
    return parts.groupBy(*keys).agg(F.flatten(packed.getField("s")).alias("summary"))


def regress_on_codes(
    pooled: DataFrame, base: DataFrame, labels: DataFrame, start: str, label: str,
    keys: Sequence[str] = SERIES_KEY, ridge: float = 0.1,
) -> DataFrame:
    """Predicted label from the pooled codes and a robust start value, fitted on labelled series."""
    keys = list(keys)
    x = F.concat("summary", F.array(F.col(start).cast("double")))
    rows = pooled.join(base.select(*keys, start), keys).where(F.col(start).isNotNull())
    # whatever made the codes runs once: the fit reads its rows several times, the prediction once more
    features = durable(rows.select(*keys, start, array_to_vector(x).alias("features")))
    known = features.join(labels.select(*keys, label), keys).where(F.col(label).isNotNull())
    fitted = LinearRegression(featuresCol="features", labelCol=label, predictionCol="predicted", regParam=ridge,
                              elasticNetParam=0.0, solver="normal").fit(known)
    return fitted.transform(features).select(*keys, start, "predicted")
