from dataclasses import replace

import numpy as np
import pytest
import synthetic
from pyspark.sql import functions as F

from structpeak.config import PeakConfig
from structpeak.operators.model import block_mean_denoiser, reconstruct
from structpeak.plans.scoring import annual_peaks
from structpeak.plans.training import refit_on_labels, train
from structpeak.sources.artifact import load_model, save_model

CONFIG = PeakConfig(channels=("value",), windows_per_series=400, latent=8, seed=1, replicas=1)


def test_artifact_round_trip(spark, tmp_path):
    model = replace(block_mean_denoiser(CONFIG, 12, "v7"), kappa=0.75)
    save_model(spark, model, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"))
    assert back.config == model.config and (back.version, back.kappa) == ("v7", 0.75)
    assert np.array_equal(back.encode, model.encode) and np.array_equal(back.decode, model.decode)
    assert PeakConfig.from_dict({"length": 24, "unknown": 1}).length == 24


def test_other_measure_is_refused(spark):
    with pytest.raises(ValueError, match="fitted on"):
        annual_peaks(spark.range(0), block_mean_denoiser(CONFIG, 12), "IMAX")


def test_h0_is_nearer_than_the_raw_quantile(spark):
    """A year of spiky data: the latent peak beats the raw high quantile on a held-out series."""
    model = train(synthetic.series(spark, ["a", "b", "c"], spikes=True), CONFIG)
    assert model.encode.shape == (145, 8)
    held_out = synthetic.series(spark, ["z"], spikes=True)
    peak = annual_peaks(held_out, model, "MVA").head()["peak"]
    truth, raw = held_out.agg(F.percentile("truth", 0.999), F.percentile("value", 0.999)).head()
    assert abs(peak - truth) < abs(raw - truth) / 2


@pytest.fixture(scope="module")
def plateau(spark):
    pool = synthetic.series(spark, ["a", "b", "c"])
    series = synthetic.series(spark, ["z"], plateau=9.0)
    return pool, series, series.agg(F.percentile("truth", 0.999)).head()[0]


@pytest.mark.parametrize("channels", [("value",), ("value", "derivative", "spread", "level", "level_delta")])
def test_refit_moves_towards_the_label(spark, plateau, channels):
    """A long plateau the registry does not explain: the refit model is nearer to the label."""
    pool, series, truth = plateau
    h0 = train(pool, CONFIG.with_(channels=channels))
    labels = spark.createDataFrame([("r", "z", 2023, float(truth))], "region string, entity string, year int, label double")
    h1 = refit_on_labels(pool.unionByName(series), labels, h0, version="h1")
    before, after = (annual_peaks(series, m, "MVA").head()["peak"] for m in (h0, h1))
    assert abs(after - truth) < abs(before - truth) / 2 and np.isfinite(h1.kappa)


def test_scoring_of_a_hot_series_is_the_same(spark):
    series = synthetic.series(spark, ["z"], spikes=True)
    model = block_mean_denoiser(CONFIG, 12)
    whole, split = (annual_peaks(series, model, "MVA", task_rows=n).head()["peak"] for n in (10**6, 1000))
    assert abs(whole - split) < 1e-9


def test_weights_do_not_depend_on_partitions(spark):
    base = synthetic.series(spark, ["a"], spikes=True)
    one, other = (train(df, CONFIG) for df in (base.coalesce(1), base.repartition(13)))
    windows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(144)), lambda i: F.sin(i / 20)).alias("values"))
    a, b = (reconstruct(windows, m).head()["structural"] for m in (one, other))
    assert np.allclose(a, b, atol=1e-6)


def test_fit_equals_direct_least_squares(spark):
    """Distributed sums against one dense solve of the same examples."""
    from structpeak.operators.model import feature_matrix, training_examples
    from structpeak.plans.training import training_windows

    config = CONFIG.with_(channels=("value", "derivative", "spread"), reweight_rounds=0, latent=144, windows_per_series=40)
    base = synthetic.series(spark, ["a"])
    model = train(base, config)
    rows = training_examples(training_windows(base, config), config).collect()
    x = feature_matrix(np.array([r["input"] for r in rows]), None, None, config.channels, config.spread_width)
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.array([r["target"] for r in rows])
    penalty = np.eye(x.shape[1]) * config.ridge * len(x)
    penalty[-1, -1] = 0
    want = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    assert np.allclose(model.encode @ model.decode, want, atol=1e-6)


def test_regression_on_codes(spark):
    from structpeak.operators.pooled import regress_on_codes

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 3.0] + 4
    key = [("r", f"e{i}", 1) for i in range(60)]
    schema = "region string, entity string, year int"
    pooled = spark.createDataFrame([(*k, [float(a), float(b)]) for k, (a, b, _) in zip(key, x)], schema + ", summary array<double>")
    base = spark.createDataFrame([(*k, float(c)) for k, (_, _, c) in zip(key, x)], schema + ", start double")
    labels = spark.createDataFrame([(*k, float(v)) for k, v in list(zip(key, y))[:40]], schema + ", label double")
    got = {r["entity"]: r["predicted"] for r in regress_on_codes(pooled, base, labels, "start", "label", ridge=0.0).collect()}
    assert np.allclose([got[k[1]] for k in key], y, atol=1e-6)


def test_scoring_exchanges(spark, tmp_path):
    """One exchange for the series, one for the quantile's partial buffers; Python runs once."""
    from structpeak.operators.series import annual_quantile
    from structpeak.plans.scoring import structural_windows

    synthetic.series(spark, ["a", "b"]).drop("truth").write.parquet(str(tmp_path / "r"))
    windows = structural_windows(spark.read.parquet(str(tmp_path / "r")), block_mean_denoiser(CONFIG, 12))
    peaks = annual_quantile(windows, "structural", 0.999)
    peaks.collect()
    plan = peaks._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ArrowEvalPython") == 1
