"""Radix selection and the plans of scoring, fit and refit."""

import math
from dataclasses import replace

import numpy as np
import pytest
import synthetic
from pyspark.sql import functions as F

from structpeak.config import PeakConfig
from structpeak.operators.contamination import contaminated_copies
from structpeak.operators.hotkeys import FEW, MANY
from structpeak.operators.model import block_mean_denoiser, cross_products, training_examples
from structpeak.operators.ordering import ordered_bits, radix_quantiles
from structpeak.operators.refit import kappa_losses, labelled_examples
from structpeak.plans.scoring import annual_peaks, structural_windows
from structpeak.plans.training import training_windows

CONFIG = PeakConfig(channels=("value",), latent=8, seed=1, replicas=1)
ODD = [0.0, -0.0, 1.0, -1.0, 2.0, 1.9999999999999998, 0.9999999999999999, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 3.0, 8.0, 8.000000000000002, 1e-300, -1e300]


def text(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_ordered_bits_are_the_bits(spark):
    draw = np.random.default_rng(1)
    values = ODD + (draw.normal(size=3000) * 10.0 ** draw.integers(-300, 300, 3000)).tolist() + [math.ldexp(1.0, k) for k in range(-1074, 1024)]
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", ordered_bits(F.col("x")).alias("b")).collect()
    for x, b in rows:
        bits = int(np.abs(np.float64(x)).view(np.int64))
        assert b == (bits if x >= 0 else -bits), x


@pytest.mark.parametrize("spread", [FEW, MANY])
def test_radix_quantiles_equal_numpy(spark, spread):
    draw = np.random.default_rng(2)
    groups = {
        "normal": draw.normal(size=2001), "narrow": 1e6 + draw.normal(size=999) * 1e-7, "same": np.full(500, 3.25), "few": np.array([4.0, -7.0]), "one": np.array([2.5]),
        "wide": draw.normal(size=800) * 10.0 ** draw.integers(-200, 200, 800), "ties": draw.integers(-3, 4, 5000).astype(float), None: np.array([1.0, 2.0, 4.0]), "none": np.array([]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("few", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = {"low": 0.0, "q25": 0.25, "mid": 0.5, "q999": 0.999, "high": 1.0}
    got = {r["g"]: r for r in radix_quantiles(df, ["g"], "v", qs, spread).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for n, q in qs.items():
            assert got[g][n] == pytest.approx(np.quantile(vs, q), rel=1e-12) if len(vs) else got[g][n] is None
    whole = radix_quantiles(df, [], "v", {"mid": 0.5}).head()["mid"]
    assert whole == pytest.approx(np.median(np.concatenate(list(groups.values()))))
    assert radix_quantiles(df.limit(0), ["g"], "v", qs).count() == 0


def test_structural_quantile_equals_numpy(spark):
    """Few top points a series give the same as all points, gaps in the points and short series included."""
    series = synthetic.series(spark, ["a", "b"], spikes=True).unionByName(synthetic.series(spark, ["c"]).limit(100))
    model = replace(block_mean_denoiser(CONFIG, 12), center=np.zeros(12), width=np.ones(12), kappa=1.5)
    for q in (0.999, 0.5, 1.0, 0.0):
        scored = replace(model, config=replace(CONFIG, peak_quantile=q))
        rows = structural_windows(series, scored).select("entity", "structural").collect()
        got = {r["entity"]: r["peak"] for r in annual_peaks(series, scored, "MVA").collect()}
        for e in "abc":
            assert got[e] == pytest.approx(np.quantile(np.concatenate([r["structural"] for r in rows if r["entity"] == e]), q))


def test_scoring_moves_readings_once(spark, tmp_path):
    """One exchange of readings; the other holds a row a series and task. Points are never exploded."""
    synthetic.series(spark, ["a", "b"]).drop("truth").write.parquet(str(tmp_path / "r"))
    plan = text(annual_peaks(spark.read.parquet(str(tmp_path / "r")), block_mean_denoiser(CONFIG, 12), "MVA"))
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("MapInArrow") == 1
    assert "percentile" not in plan.split("MapInArrow")[0] and "Generate" not in plan


def test_matrices_are_summed_in_two_levels(spark):
    windows = training_windows(synthetic.series(spark, ["a"]).repartition(9), CONFIG).repartition(9)
    sums = cross_products(training_examples(windows, CONFIG), CONFIG)
    plan = text(sums)
    assert "Coalesce 4096" in plan and plan.count("MapInPandas") == 1
    assert "hashpartitioning(row" in plan and ", part" in plan
    assert len(sums.collect()) == 145


def test_losses_need_one_python_stage_a_side(spark):
    windows = training_windows(synthetic.series(spark, ["a", "b"]), CONFIG)
    labels = spark.createDataFrame([("r", "a", 2023, 15.0)], "region string, entity string, year int, label double")
    model = replace(block_mean_denoiser(CONFIG, 12), center=np.zeros(12), width=np.ones(12))
    losses = kappa_losses(labelled_examples(windows, labels), contaminated_copies(windows, CONFIG), model, [math.inf, 1.0, 0.5], pool_input="contaminated")
    plan = text(losses)
    assert plan.count("MapInArrow") == 2 and "ArrowEvalPython" not in plan and "explode(" not in plan
    assert [r["n_labelled"] for r in losses.collect()] == [1, 1, 1]
