import numpy as np
import pytest
from pyspark.sql import functions as F

from structpeak.operators.evaluate import error_metrics, gated_metrics, out_of_fold, wide_metrics
from structpeak.operators.labels import calibration_line, latest_per_key
from structpeak.operators.refit import soft_peak
from structpeak.operators.statistics import cliffs_delta, cluster_bootstrap, holm, signed_rank
from structpeak.plans.labelling import calibrated_h1, evaluate_calibration, paired_results
from structpeak.plans.reports import predominant, with_compute_change
from structpeak.plans.results import RESULT_SCHEMA, h0_records, publish_h0, publish_h1


def test_latest_present_label(spark):
    log = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("a", 3, None), ("b", 1, None)], "k string, t int, v double")
    assert dict(latest_per_key(log, ["k"], "v", "t").collect()) == {"a": 6.0, "b": None}


def test_line_of_degenerate_sets(spark):
    df = spark.createDataFrame([("one", 2.0, 3.0), ("flat", 2.0, 3.0), ("flat", 2.0, 5.0), ("ok", 1.0, 3.0), ("ok", 2.0, 5.0)], "g string, x double, y double")
    got = {r["g"]: (r["slope"], r["intercept"]) for r in calibration_line(df, "x", "y", ["g"]).collect()}
    assert got["one"] == got["flat"] == (1.0, 0.0) and np.allclose(got["ok"], (2.0, 1.0))


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(1)
    rows = [("AB"[e % 2], f"e{e}", y, float(x), float(1.1 * x + 2 + rng.normal())) for e in range(23) for y in (1, 2, 3) for x in [rng.uniform(5, 50)]]
    return rows, spark.createDataFrame(rows, "region string, entity string, year int, h0 double, label double").repartition(4)


def test_out_of_fold_never_sees_its_entity(pairs):
    rows, df = pairs
    got = out_of_fold(df, "h0", "label", 5, 42).collect()
    assert len(got) == len(rows)
    fold = {r["entity"]: r["fold"] for r in got}
    for r in got:
        train = [x for x in rows if fold[x[1]] != r["fold"]]
        a, b = np.polyfit([x[3] for x in train], [x[4] for x in train], 1)
        assert abs(r["predicted"] - (a * r["h0"] + b)) < 1e-8


@pytest.mark.parametrize("spread", [False, True])
def test_metrics(pairs, spread):
    rows, df = pairs
    df = df.withColumn("predicted", F.col("h0") * 1.1)
    got = {r["region"]: r for r in error_metrics(df, "predicted", "label", ["region"], spread).collect()}
    wide = {r["region"]: r for r in wide_metrics(df, "predicted", "label", ["region"], spread=spread).collect()}
    assert set(got) == {"A", "B", None} and got[None]["overall"] and not got["A"]["overall"]
    for region in ("A", "B", None):
        x = np.array([r[3:] for r in rows if region in (None, r[0])])
        err = 1.1 * x[:, 0] - x[:, 1]
        rel = np.abs(err) / np.abs(x[:, 1])
        r = got[region]
        assert np.allclose([r["mae"], r["median_ape"], r["hit_05"], r["hit_10"], r["n"]],
                           [np.abs(err).mean(), np.median(rel), (rel <= 0.05).mean(), (rel <= 0.1).mean(), len(x)])
        if region:
            assert np.allclose([wide[region]["rmse"], wide[region]["median_error"]], [np.sqrt((err**2).mean()), np.median(err)])


def test_gate(pairs):
    _, df = pairs
    few = df.limit(9)
    metrics = error_metrics(few.withColumn("predicted", F.col("h0")), "predicted", "label")
    rows = gated_metrics(few, metrics).collect()
    assert len(rows) == 1 and rows[0]["status"] == "too few labelled pairs" and rows[0]["mae"] is None
    assert gated_metrics(df, metrics).head()["status"] == "ok"


def test_results_to_h1(spark):
    rows = [("r", "feeder", f"e{i}", "MVA", 2024, float(i), None, "v", None) for i in range(1, 31)]
    rows.append(("r", "feeder", "gap", "MVA", 2024, None, None, "v", None))
    results = spark.createDataFrame(rows, RESULT_SCHEMA)
    log = spark.createDataFrame([("r", f"e{i}", "MVA", 2024, 2.0 * i + 1, t) for i in range(1, 13) for t in (1, 2)], "region string, entity string, measure string, year int, label double, labelled_at int")
    base = paired_results(results, log)
    h1 = {r["entity"]: r["peak_h1"] for r in calibrated_h1(base).collect()}
    assert h1["e3"] == 7.0 and abs(h1["e30"] - 61.0) < 1e-9 and h1["gap"] is None
    assert {r["status"] for r in evaluate_calibration(base).collect()} == {"ok"}
    as_of = F.lit("2024-05-01").cast("timestamp")
    staged = h0_records(spark.createDataFrame([("r", "e1", 2024, float("nan")), ("r", "new", 2024, 3.0)], "region string, entity string, year int, peak double"), "MVA", "v2")
    merged = {r["entity"]: r for r in publish_h0(results, staged, as_of).collect()}
    assert merged["e1"]["peak_h0"] is None and merged["e1"]["model_version"] == "v2" and merged["new"]["computed_at"] is None
    final = {r["entity"]: r for r in publish_h1(results, calibrated_h1(base), as_of).collect()}
    assert final["e3"]["peak_h1"] == 7.0 and final["e3"]["peak_h0"] == 3.0 and len(final) == 31
    assert set(RESULT_SCHEMA.names) == {"region", "kind", "entity", "measure", "year", "peak_h0", "peak_h1", "model_version", "computed_at"}


def test_soft_peak(spark):
    x = np.random.default_rng(0).normal(size=500) * 3
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, x double").repartition(7)
    w = np.exp((x - x.max()) / 0.05)
    assert abs(soft_peak(df, ["k"], "x", 0.05).head()["soft_peak"] - (w * x).sum() / w.sum()) < 1e-9


def test_tie_order_and_first_run(spark):
    df = spark.createDataFrame([(1, d, r, a, j, s) for d, r, a, j, s in [("2024-01-01", 1, 5.0, 5.0, 5.0), ("2024-01-01", 2, 1.0, 5.0, 5.0), ("2024-01-03", 1, 1.0, 2.0, 5.0), ("2024-01-04", 0, 0.0, 0.0, 5.0)]],
                               "job_id int, usage_date string, job_run_id int, cost_all_purpose double, cost_job_compute double, cost_serverless double")
    got = with_compute_change(predominant(df)).orderBy("usage_date", "job_run_id").collect()
    assert [r["predominant_compute"] for r in got] == ["All-Purpose Compute", "Job Compute", "Serverless Jobs", "Serverless Jobs"]
    assert [r["previous_predominant_compute"] for r in got] == [None, "All-Purpose Compute", "Job Compute", "Serverless Jobs"]
    assert [r["compute_type_changed"] for r in got] == [False, True, True, False]


def test_rank_tests(spark):
    rng = np.random.default_rng(5)
    d = np.round(rng.normal(0.3, 1, 80), 1)
    df = spark.createDataFrame([(float(v),) for v in d], "d double")
    got = signed_rank(df, "d").head()
    used = d[d != 0]
    order = np.abs(used)
    ranks = np.array([(order < v).sum() + ((order == v).sum() + 1) / 2 for v in order])
    assert abs(got["w_plus"] - ranks[used > 0].sum()) < 1e-9 and got["n"] == len(used)
    x, y = np.round(rng.normal(0.5, 1, 60), 1), np.round(rng.normal(0, 1, 45), 1)
    both = spark.createDataFrame([(1, float(v)) for v in x] + [(0, float(v)) for v in y], "f int, v double")
    delta = cliffs_delta(both, "v", F.col("f") == 1).head()
    want = (np.sign(x[:, None] - y[None, :])).mean()
    assert abs(delta["delta"] - want) < 1e-12 and (delta["n_first"], delta["n_second"]) == (60, 45)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "h string, p_value double")
    got = {r["h"]: round(r["adjusted_p"], 6) for r in holm(df).collect()}
    assert got == {"d": 0.02, "a": 0.03, "c": 0.06, "b": 0.06}


def test_bootstrap_covers_the_mean(pairs):
    rows, df = pairs
    df = df.withColumns({"hit": (F.col("h0") > 20).cast("double"), "one": F.lit(1.0)})
    got = cluster_bootstrap(df, "hit", "one", "entity", 300, 7).head()
    rate = np.mean([r[3] > 20 for r in rows])
    assert got["lower"] < rate < got["upper"] and got["upper"] - got["lower"] < 0.4


def test_records_mark_pairs(spark):
    """Repeated records mark once, a null key equals a null, other columns stay."""
    from structpeak.operators.evaluate import with_recorded

    pairs = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), (None, 1, 7.0), ("b", 1, 8.0), ("b", 1, 8.0)], "entity string, year int, recorded double")
    records = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), ("c", 9), ("b", 2)], "entity string, year int")
    got = with_recorded(pairs, records, ["entity", "year"])
    assert got.columns == ["entity", "year", "recorded", "difficult"]
    assert sorted(map(str, got.collect())) == sorted(map(str, pairs.selectExpr("*", "(coalesce(entity, '') in ('a', '') and year = 1) as difficult").collect()))
    assert with_recorded(pairs, records.limit(0), ["entity", "year"]).where("difficult").count() == 0
    assert with_recorded(pairs.limit(0), records, ["entity", "year"]).count() == 0
