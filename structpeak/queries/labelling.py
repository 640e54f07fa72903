"""Label log, pairing, calibration, out-of-fold evaluation and final values."""

from __future__ import annotations

from pyspark.sql import functions as F

from structpeak.config import RESULT_KEY
from structpeak.operators.evaluate import out_of_fold
from structpeak.operators.labels import (
    calibrated, calibration_line, labelled_series, latest_per_key, production_override, with_labels,
)
from structpeak.operators.sampling import fold_assignment, step_batches
from structpeak.plans.labelling import evaluate_calibration
from structpeak.queries.base import label_log, labels, pairs, query, readings, results, rounded, seed_sql, sql, table, uniform_sql


@query("latest_event_label", """
    SELECT user_id, event_type, arg_max(v, (ts, event_id)) FILTER (WHERE v IS NOT NULL) AS label
    FROM (SELECT *, CASE WHEN value >= 5 THEN value END AS v FROM events) GROUP BY user_id, event_type""")
def latest_event_label(spark, sf):
    log = table(spark, sf, "events").withColumn("v", F.when(F.col("value") >= 5, F.col("value")))
    return latest_per_key(log, ["user_id", "event_type"], "v", "ts", ["event_id"], "label")


@query("results_with_labels", sql(("results", "labels"), """
    SELECT r.region, r.entity, r.measure, r.year, round(r.peak_h0, 4) AS peak_h0, round(l.label, 4) AS label
    FROM results r LEFT JOIN labels l ON r.region = l.region AND r.entity = l.entity AND r.measure = l.measure AND r.year = l.year"""))
def results_with_labels(spark, sf):
    latest = latest_per_key(label_log(spark, sf), RESULT_KEY, "label", "labelled_at", ("quarter",))
    return rounded(with_labels(results(spark, sf), latest).select(*RESULT_KEY, "peak_h0", "label"), 4, "peak_h0", "label")


@query("labelled_series", sql(("readings", "labels"), """
    SELECT r.region, r.entity, r.year, count(*) AS n, round(sum(r.value), 2) AS total, round(any_value(l.label), 4) AS label
    FROM readings r JOIN labels l ON r.region = l.region AND r.entity = l.entity AND r.year = l.year
    GROUP BY r.region, r.entity, r.year"""))
def labelled_series_query(spark, sf):
    """All labelled series in one join instead of one read per label."""
    df = labelled_series(readings(spark, sf), labels(spark, sf), ["region", "entity", "year"], "label")
    return df.groupBy("region", "entity", "year").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.first("label"), 4).alias("label"))


@query("calibration_line", sql(("pairs",), """
    SELECT round(regr_slope(label, peak_h0), 6) AS slope, round(regr_intercept(label, peak_h0), 4) AS intercept, count(*) AS n_pairs FROM pairs"""))
def calibration_line_query(spark, sf):
    line = calibration_line(pairs(spark, sf), "peak_h0", "label")
    return rounded(rounded(line, 6, "slope"), 4, "intercept")


@query("regional_calibration", sql(("pairs",), """
    SELECT region, year, round(CASE WHEN ok THEN s ELSE 1.0 END, 6) AS slope, round(CASE WHEN ok THEN b ELSE 0.0 END, 4) AS intercept, n_pairs
    FROM (SELECT region, year, regr_slope(label, peak_h0) AS s, regr_intercept(label, peak_h0) AS b, count(*) AS n_pairs,
                 count(*) >= 2 AND regr_sxx(label, peak_h0) > 0 AS ok FROM pairs GROUP BY region, year)"""))
def regional_calibration(spark, sf):
    line = calibration_line(pairs(spark, sf), "peak_h0", "label", ["region", "year"])
    return rounded(rounded(line, 6, "slope"), 4, "intercept")


@query("calibrated_h1", sql(("results", "labels", "pairs"), """
    SELECT r.region, r.entity, r.measure, r.year, round(a * r.peak_h0 + b, 4) AS estimate,
           round(coalesce(l.label, a * r.peak_h0 + b), 4) AS peak_h1
    FROM results r LEFT JOIN labels l ON r.region = l.region AND r.entity = l.entity AND r.measure = l.measure AND r.year = l.year,
         (SELECT regr_slope(label, peak_h0) AS a, regr_intercept(label, peak_h0) AS b FROM pairs)"""))
def calibrated_h1_query(spark, sf):
    """Production values: the label where there is one, else the calibrated estimate."""
    base = with_labels(results(spark, sf), labels(spark, sf))
    line = calibration_line(base.dropna(subset=["peak_h0", "label"]), "peak_h0", "label")
    out = production_override(calibrated(base, line, "peak_h0", "estimate"), "label", "estimate", "peak_h1")
    return rounded(out.select(*RESULT_KEY, "estimate", "peak_h1"), 4, "estimate", "peak_h1")


_FOLDS = """SELECT entity, CAST(ntile(5) OVER (ORDER BY md5(concat_ws(':', '42', entity))) - 1 AS INTEGER) AS fold
            FROM (SELECT DISTINCT entity FROM pairs)"""


@query("fold_assignment", sql(("pairs",), "SELECT entity, fold FROM folds", folds=_FOLDS))
def fold_assignment_query(spark, sf):
    return fold_assignment(pairs(spark, sf), 5, 42)


@query("customer_folds", """
    SELECT c_custkey AS entity, CAST(ntile(7) OVER (ORDER BY md5(concat_ws(':', '42', CAST(c_custkey AS VARCHAR)))) - 1 AS INTEGER) AS fold FROM customer""")
def customer_folds(spark, sf):
    """The same rule on a larger set of ids, numbered by digest prefix."""
    return fold_assignment(table(spark, sf, "customer").select(F.col("c_custkey").alias("entity")), 7, 42)


_OOF = {
    "folds": _FOLDS,
    "placed": "SELECT p.*, f.fold FROM pairs p JOIN folds f ON p.entity = f.entity",
    "lines": """SELECT k, regr_slope(label, peak_h0) AS a, regr_intercept(label, peak_h0) AS b
                FROM placed, (SELECT unnest(range(5)) AS k) WHERE fold <> k GROUP BY k HAVING count(*) >= 2""",
    "oof": "SELECT p.*, a * peak_h0 + b AS predicted FROM placed p JOIN lines ON fold = k",
}


@query("out_of_fold_predictions", sql(("pairs",), """
    SELECT region, entity, year, fold, round(predicted, 4) AS predicted, round(label, 4) AS label FROM oof""", **_OOF))
def out_of_fold_predictions(spark, sf):
    out = out_of_fold(pairs(spark, sf), "peak_h0", "label", 5, 42)
    return rounded(out.select("region", "entity", "year", "fold", "predicted", "label"), 4, "predicted", "label")


@query("calibration_metrics", sql(("pairs",), """
    SELECT (SELECT count(*) FROM pairs) AS n_pairs, 'ok' AS status, region, round(avg(abs(predicted - label)), 4) AS mae,
           round(quantile_cont(abs(predicted - label) / abs(label), 0.5), 6) AS median_ape,
           round(avg(CASE WHEN abs(predicted - label) / abs(label) <= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS hit_05,
           round(avg(CASE WHEN abs(predicted - label) / abs(label) <= 0.10 THEN 1.0 ELSE 0.0 END), 6) AS hit_10,
           count(*) AS n, grouping(region) = 1 AS overall
    FROM oof GROUP BY GROUPING SETS ((region), ())""", **_OOF))
def calibration_metrics(spark, sf):
    """Out-of-fold errors overall and by region, gated on ten pairs."""
    base = with_labels(results(spark, sf), labels(spark, sf))
    return rounded(rounded(evaluate_calibration(base), 6, "median_ape", "hit_05", "hit_10"), 4, "mae")


@query("training_batches", sql(("pairs",), f"""
    SELECT step, region, entity, year, round(u, 6) AS draw FROM (
      SELECT *, {uniform_sql("s", 1)} AS u FROM (
        SELECT region, entity, year, step, {seed_sql("'9'", "step", "region", "entity", "year")} AS s
        FROM pairs, (SELECT unnest(range(1, 6)) AS step))) WHERE u < 0.2"""))
def training_batches(spark, sf):
    """Which labelled series enter the mini-batch of which step."""
    key = ["region", "entity", "year"]
    return rounded(step_batches(pairs(spark, sf).select(*key), 5, 0.2, 9, key), 6, "draw").select("step", *key, "draw")
