"""Wider error metrics, splits and label samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from structpeak.operators.evaluate import out_of_fold, size_class, tolerance_curve, wide_metrics, with_recorded
from structpeak.operators.sampling import frozen_split, list_digest, nested_chains, stratified_sample
from structpeak.queries.base import pairs, query, rounded, sql, suppliers, table
from structpeak.queries.labelling import _OOF

_WIDE = """
    round(sqrt(avg((predicted - label) * (predicted - label))), 4) AS rmse,
    round(avg(abs(predicted - label) / abs(label)), 6) AS mape, round(avg(predicted - label), 4) AS bias,
    round(quantile_cont(predicted - label, 0.5), 4) AS median_error,
    round(avg(CASE WHEN predicted < label THEN 1.0 ELSE 0.0 END), 6) AS under_share,
    round(avg(greatest(0.9 * (label - predicted), -0.1 * (label - predicted))), 4) AS pinball, count(*) AS n"""


def _oof(spark, sf):
    return out_of_fold(pairs(spark, sf), "peak_h0", "label", 5, 42)


def _rounded_wide(df):
    return rounded(rounded(df, 6, "mape", "under_share"), 4, "rmse", "bias", "median_error", "pinball")


@query("error_by_region_year", sql(("pairs",), f"SELECT region, year, {_WIDE} FROM oof GROUP BY region, year", **_OOF))
def error_by_region_year(spark, sf):
    return _rounded_wide(wide_metrics(_oof(spark, sf), "predicted", "label", ["region", "year"]))


@query("error_by_size", sql(("pairs",), f"""
    SELECT CASE WHEN peak_h0 < 103000 THEN 'small' WHEN peak_h0 < 104500 THEN 'medium' ELSE 'large' END AS size_class, {_WIDE}
    FROM oof GROUP BY 1""", **_OOF))
def error_by_size(spark, sf):
    sized = _oof(spark, sf).withColumn("size_class", size_class(F.col("peak_h0"), {"small": 103000.0, "medium": 104500.0}, "large"))
    return _rounded_wide(wide_metrics(sized, "predicted", "label", ["size_class"]))


@query("error_by_difficulty", sql(("pairs",), f"""
    SELECT r.entity IS NOT NULL AS difficult, {_WIDE} FROM oof o LEFT JOIN recorded r ON o.region = r.region AND o.entity = r.entity AND o.year = r.year GROUP BY 1""",
    **_OOF, recorded="""SELECT DISTINCT s.region, s.entity, year(l_shipdate) AS year FROM lineitem JOIN suppliers s ON s.entity = CAST(l_suppkey AS VARCHAR)
                        WHERE l_returnflag = 'R' AND l_quantity = 50"""))
def error_by_difficulty(spark, sf):
    """Errors of series with and without a recorded operation (a returned line of the largest quantity) in the year."""
    returned = table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") == 50))
    records = returned.join(suppliers(spark, sf), F.col("l_suppkey") == F.col("s_suppkey")).select("region", "entity", F.year("l_shipdate").alias("year"))
    marked = with_recorded(_oof(spark, sf), records, ["region", "entity", "year"])
    return _rounded_wide(wide_metrics(marked, "predicted", "label", ["difficult"]))


@query("tolerance_curve", sql(("pairs",), """
    SELECT region, epsilon, round(avg(CASE WHEN abs(predicted - label) / abs(label) <= epsilon THEN 1.0 ELSE 0.0 END), 6) AS hit_rate,
           count(*) AS n
    FROM oof, (SELECT unnest([0.01::DOUBLE, 0.02, 0.05, 0.1, 0.2, 0.5]) AS epsilon) GROUP BY region, epsilon""", **_OOF))
def tolerance_curve_query(spark, sf):
    grid = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5)
    return rounded(tolerance_curve(_oof(spark, sf), "predicted", "label", grid, ["region"]), 6, "hit_rate")


_SPLIT = """
    SELECT entity, region, row_number() OVER (PARTITION BY region ORDER BY md5(concat_ws(':', '11', entity)))
             <= floor(count(*) OVER (PARTITION BY region) * 0.2) AS is_test FROM suppliers"""


@query("frozen_split", sql(("suppliers",), "SELECT entity, region, is_test FROM split", split=_SPLIT))
def frozen_split_query(spark, sf):
    return frozen_split(suppliers(spark, sf), ["region"], 0.2, 11)


@query("frozen_split_digest", sql(("suppliers",), """
    SELECT is_test, n, md5(concat_ws('|', CAST(n AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR))) AS digest FROM (
      SELECT is_test, count(*) AS n,
             sum(CAST(CAST('0x' || substr(md5(concat_ws('|', region, entity)), 1, 10) AS BIGINT) AS HUGEINT)) AS a,
             sum(CAST(CAST('0x' || substr(md5(concat_ws('|', region, entity)), 11, 10) AS BIGINT) AS HUGEINT)) AS b
      FROM split GROUP BY is_test)""", split=_SPLIT))
def frozen_split_digest(spark, sf):
    """Digest of the test and pool lists, independent of row order."""
    return list_digest(frozen_split(suppliers(spark, sf), ["region"], 0.2, 11), ["region", "entity"], ["is_test"])


_CHAIN = """
    SELECT *, row_number() OVER (PARTITION BY repetition ORDER BY
             md5(concat_ws(':', '13', CAST(repetition AS VARCHAR), region, entity, CAST(year AS VARCHAR))), region, entity, year) AS position
    FROM pairs, (SELECT unnest(range(1, 6)) AS repetition)"""
_LEVEL = "CASE " + " ".join(f"WHEN position <= {n} THEN {n}" for n in (10, 25, 50, 100, 250)) + " END"
GRID = (10, 25, 50, 100, 250)


@query("nested_label_chains", sql(("pairs",), f"""
    SELECT repetition, region, entity, year, position, {_LEVEL} AS first_level FROM chain""", chain=_CHAIN))
def nested_label_chains(spark, sf):
    key = ["region", "entity", "year"]
    return nested_chains(pairs(spark, sf).select(*key), GRID, 5, 13, key).select("repetition", *key, "position", "first_level")


@query("stratified_label_sample", sql(("pairs",), """
    SELECT region, entity, year, position FROM (
      SELECT *, row_number() OVER (PARTITION BY region ORDER BY md5(concat_ws(':', '17', region, entity, CAST(year AS VARCHAR))), region, entity, year) AS position,
             count(*) OVER (PARTITION BY region) AS total, count(*) OVER () AS everything FROM pairs)
    WHERE position <= round(100.0 * total / everything)"""))
def stratified_label_sample(spark, sf):
    key = ["region", "entity", "year"]
    return stratified_sample(pairs(spark, sf).select(*key), ["region"], 100, 17, key)
