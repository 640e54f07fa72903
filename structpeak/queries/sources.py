"""Scans, filters, set operations and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from structpeak.config import RESULT_KEY
from structpeak.operators.merge import upsert
from structpeak.operators.sampling import rows_outside
from structpeak.operators.series import annual_quantile, series_windows, unscaled
from structpeak.plans.reports import network_by_month
from structpeak.plans.results import publish_h0_table, write_results
from structpeak.queries.base import KEY, LENGTH, TIE, query, readings, results, rounded, sql, suppliers, table
from structpeak.session import shared_folder
from structpeak.sources.tables import as_readings, catalog_table, read_region, save_series_table, union_regions


@query("region_union", """
    SELECT 'SUPPLIERS' AS region, CAST(s_name AS VARCHAR) AS entity, CAST(s_suppkey AS BIGINT) AS id, s_acctbal AS value,
           CAST(NULL AS VARCHAR) AS segment FROM supplier
    UNION ALL
    SELECT 'CUSTOMERS', c_name, c_custkey, c_acctbal, c_mktsegment FROM customer""")
def region_union(spark, sf):
    """Two tagged scans appended by name; a column one of them lacks is NULL there."""
    one = read_region(spark, f"{sf}/supplier.parquet", "SUPPLIERS").withColumnsRenamed(
        {"s_name": "entity", "s_suppkey": "id", "s_acctbal": "value"})
    two = read_region(spark, f"{sf}/customer.parquet", "CUSTOMERS").withColumnsRenamed(
        {"c_name": "entity", "c_custkey": "id", "c_acctbal": "value", "c_mktsegment": "segment"})
    return union_regions([one, two]).select("region", "entity", "id", "value", "segment")


_MEASURES = """
    SELECT CAST(l_linestatus AS VARCHAR) AS region, CAST(l_suppkey AS VARCHAR) AS entity, count(*) AS n, count({m}) AS present,
           round(sum({m}), 2) AS total FROM lineitem GROUP BY 1, 2"""


@query("measure_by_name", _MEASURES.format(m="l_quantity"))
def measure_by_name(spark, sf):
    """Run-time choice of the measure column; the scan reads only what is used."""
    raw = table(spark, sf, "lineitem").withColumn("region", F.col("l_linestatus")).withColumn("year", F.year("l_shipdate"))
    df = as_readings(raw, "l_quantity", {"entity": "l_suppkey", "ts": "l_shipdate", "year": "year"})
    return df.groupBy("region", "entity").agg(
        F.count("*").alias("n"), F.count("value").alias("present"), F.round(F.sum("value"), 2).alias("total"))


@query("finite_readings", """
    SELECT region, count(*) AS n, count(v) AS present, round(sum(v), 4) AS total FROM (
      SELECT l_returnflag AS region, CASE WHEN l_tax > 0 AND l_discount > 0 THEN l_discount / l_tax END AS v FROM lineitem)
    GROUP BY region""")
def finite_readings(spark, sf):
    """Ratios that are NaN or infinite become missing at ingest."""
    tax, discount = F.col("l_tax"), F.col("l_discount")
    ratio = (F.when((tax == 0) & (discount == 0), F.lit(float("nan"))).when(tax == 0, F.lit(float("inf")))
             .when(discount == 0, F.lit(float("-inf"))).otherwise(discount / tax))
    raw = table(spark, sf, "lineitem").withColumns({"region": F.col("l_returnflag"), "year": F.year("l_shipdate"), "ratio": ratio})
    df = as_readings(raw, "ratio", {"entity": "l_suppkey", "ts": "l_shipdate", "year": "year"})
    return df.groupBy("region").agg(
        F.count("*").alias("n"), F.count("value").alias("present"), F.round(F.sum("value"), 4).alias("total"))


@query("catalog_scan", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalog_scan(spark, sf):
    """Two catalog tables by their three-part names, in buckets of the join key: the join needs no exchange."""
    names = {}
    for name, key in (("nation", "n_regionkey"), ("region", "r_regionkey")):
        folder = shared_folder(spark, name)
        names[name] = f"spark_catalog.default.given_{folder.rsplit('-', 1)[1]}"
        save_series_table(table(spark, sf, name), names[name], 4, [key], [], folder)
    joined = catalog_table(spark, names["nation"]).join(catalog_table(spark, names["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_name", "r_name")


@query("series_table_windows", sql(("points",), """
    SELECT region, entity, year, round(quantile_cont(v, 0.999), 6) AS peak FROM points GROUP BY region, entity, year"""))
def series_table_windows(spark, sf):
    """The flagship chain on readings stored in buckets of the series key."""
    folder = shared_folder(spark, "readings")
    name = f"spark_catalog.default.readings_{folder.rsplit('-', 1)[1]}"
    save_series_table(readings(spark, sf), name, 16, KEY, ["ts", *TIE], folder)
    windows = series_windows(catalog_table(spark, name), LENGTH, tie=TIE)
    back = F.transform("values", lambda z: unscaled(z, F.col("median"), F.col("scale")))
    return rounded(annual_quantile(windows.withColumn("back", back), "back", 0.999), 6, "peak")


@query("parameterised_filter", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem
    WHERE l_linestatus = 'F' AND l_returnflag = 'R' AND l_shipdate IS NOT NULL
      AND CAST(l_shipdate AS DATE) BETWEEN CAST('1998-06-15' AS DATE) - INTERVAL 900 DAY AND CAST('1998-06-15' AS DATE)
    GROUP BY l_returnflag, l_linestatus""")
def parameterised_filter(spark, sf):
    """Filters with bound parameters: equality, inclusive date range, not-null."""
    return spark.sql(
        """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM {lines}
           WHERE l_linestatus = :status AND l_returnflag = :flag AND l_shipdate IS NOT NULL
             AND CAST(l_shipdate AS DATE) BETWEEN date_sub(CAST(:today AS DATE), 900) AND CAST(:today AS DATE)
           GROUP BY l_returnflag, l_linestatus""",
        args={"status": "F", "flag": "R", "today": "1998-06-15"}, lines=table(spark, sf, "lineitem"))


@query("distinct_entities", "SELECT DISTINCT l_suppkey AS entity FROM lineitem")
def distinct_entities(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity")).distinct()


@query("entities_without_late_orders", """
    SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN
      (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)""")
def entities_without_late_orders(spark, sf):
    """Complement by anti join."""
    late = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return rows_outside(table(spark, sf, "customer"), late, ["c_custkey"]).select("c_custkey", "c_name")


@query("network_length", """
    SELECT c_nationkey AS circuit, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
           round(sum(o_totalprice) / 1000, 6) AS km
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3 ORDER BY 2, 3, 1""")
def network_length(spark, sf):
    parts = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("circuit"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        F.col("o_totalprice").alias("length"))
    return network_by_month(parts).withColumn("km", F.round("km", 6))


# ------------------------------------------------------------------ merges

_STORED = f"""
    SELECT r.region, 'feeder' AS kind, r.entity, r.measure, r.year, r.peak_h0, r.peak_h0 * 1.5 AS peak_h1,
           'v1' AS model_version, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS computed_at
    FROM results r WHERE r.year <= 1999"""
_STAGED = """
    SELECT r.region, 'feeder' AS kind, CASE WHEN s_acctbal < 0 THEN NULL ELSE r.entity END AS entity, r.measure, r.year,
           CASE WHEN r.year = 1998 THEN NULL ELSE r.peak_h0 * 2 END AS peak_h0, 'v2' AS model_version
    FROM results r JOIN suppliers s ON r.entity = s.entity WHERE r.year >= 1998"""
_EQUAL = "d.region = s.region AND d.entity = s.entity AND d.measure = s.measure AND d.year = s.year"


def _stored(spark, sf):
    return results(spark, sf).where(F.col("year") <= 1999).select(
        "region", F.lit("feeder").alias("kind"), "entity", "measure", "year", "peak_h0", (F.col("peak_h0") * 1.5).alias("peak_h1"),
        F.lit("v1").alias("model_version"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("computed_at"))


def _staged(spark, sf):
    found = results(spark, sf).where(F.col("year") >= 1998).join(suppliers(spark, sf).select("entity", "s_acctbal"), "entity")
    return found.select(
        "region", F.lit("feeder").alias("kind"), F.when(F.col("s_acctbal") >= 0, F.col("entity")).alias("entity"), "measure", "year",
        F.when(F.col("year") != 1998, F.col("peak_h0") * 2).alias("peak_h0"), F.lit("v2").alias("model_version"))


_MERGED_H0 = f"""
    SELECT d.region, d.kind, d.entity, d.measure, d.year,
           round(CASE WHEN s.model_version IS NULL THEN d.peak_h0 ELSE s.peak_h0 END, 4) AS peak_h0, round(d.peak_h1, 4) AS peak_h1,
           coalesce(s.model_version, d.model_version) AS model_version,
           CASE WHEN s.model_version IS NULL THEN d.computed_at ELSE CAST('2024-06-01 12:00:00' AS TIMESTAMP) END AS computed_at
    FROM stored d LEFT JOIN recent s ON {_EQUAL}
    UNION ALL
    SELECT s.region, s.kind, s.entity, s.measure, s.year, round(s.peak_h0, 4), NULL, s.model_version, NULL
    FROM recent s WHERE NOT EXISTS (SELECT 1 FROM stored d WHERE {_EQUAL})"""


@query("merge_h0", sql(("results", "suppliers"), _MERGED_H0, stored=_STORED, staged=_STAGED, recent="SELECT * FROM staged"))
def merge_h0(spark, sf):
    """Upsert of h0: matched rows updated (NULL included), others inserted, h1 kept."""
    staged = _staged(spark, sf)
    merged = upsert(
        _stored(spark, sf), staged, RESULT_KEY,
        update={"peak_h0": "peak_h0", "model_version": "model_version",
                "computed_at": F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")},
        insert=staged.columns)
    return merged.withColumns({"peak_h0": F.round("peak_h0", 4), "peak_h1": F.round("peak_h1", 4)})


@query("merge_h0_partitions", sql(("results", "suppliers"), _MERGED_H0, stored=_STORED, staged=_STAGED, recent="SELECT * FROM staged WHERE year >= 1999"))
def merge_h0_partitions(spark, sf):
    """The upsert on a stored table, with recent years as source: older partitions are not touched."""
    path = shared_folder(spark, "results")
    write_results(_stored(spark, sf), path)
    staged = _staged(spark, sf).where("year >= 1999")
    publish_h0_table(spark, path, staged, F.lit("2024-06-01 12:00:00").cast("timestamp_ntz"))
    merged = spark.read.parquet(path).select(*_stored(spark, sf).columns)
    return merged.withColumns({"peak_h0": F.round("peak_h0", 4), "peak_h1": F.round("peak_h1", 4)})


@query("merge_h1", sql(("results", "suppliers"), f"""
    SELECT d.region, d.kind, d.entity, d.measure, d.year, round(d.peak_h0, 4) AS peak_h0,
           round(CASE WHEN s.model_version IS NULL THEN d.peak_h1 ELSE s.peak_h0 END, 4) AS peak_h1, d.model_version,
           CASE WHEN s.model_version IS NULL THEN d.computed_at ELSE CAST('2024-06-01 12:00:00' AS TIMESTAMP) END AS computed_at
    FROM stored d LEFT JOIN staged s ON {_EQUAL}""", stored=_STORED, staged=_STAGED))
def merge_h1(spark, sf):
    """Update-only merge: unmatched source rows are ignored."""
    staged = _staged(spark, sf).select("region", "entity", "measure", "year", F.col("peak_h0").alias("peak_h1"))
    merged = upsert(
        _stored(spark, sf), staged, RESULT_KEY,
        update={"peak_h1": "peak_h1", "computed_at": F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")})
    return merged.withColumns({"peak_h0": F.round("peak_h0", 4), "peak_h1": F.round("peak_h1", 4)})


@query("data_audit", sql(("readings", "labels", "months"), """
    SELECT r.region, r.year, r.n_series, r.n_readings, r.missing, coalesce(l.n_labels, 0) AS n_labels,
           round(coalesce(l.n_labels, 0) * 1.0 / r.n_series, 6) AS label_share, coalesce(m.n_months, 0) AS registry_months
    FROM (SELECT region, year, count(DISTINCT entity) AS n_series, count(*) AS n_readings, count(*) - count(value) AS missing
          FROM readings GROUP BY region, year) r
    LEFT JOIN (SELECT region, year, count(label) AS n_labels FROM labels GROUP BY region, year) l
      ON r.region = l.region AND r.year = l.year
    LEFT JOIN (SELECT region, year, count(*) AS n_months FROM months GROUP BY region, year) m
      ON r.region = m.region AND r.year = m.year"""))
def data_audit(spark, sf):
    """Coverage of readings, labels and registry per region and year."""
    from structpeak.operators.baselines import data_audit as audit
    from structpeak.queries.base import labels, months

    out = audit(readings(spark, sf), labels(spark, sf), months(spark, sf))
    return out.withColumn("label_share", F.round("label_share", 6))


@query("temporal_split", sql(("pairs",), """
    SELECT region, CASE WHEN year <= 1999 THEN 'fit' WHEN year = 2000 THEN 'next_year' ELSE 'unused' END AS part,
           count(*) AS n, round(avg(label), 4) AS mean_label FROM pairs GROUP BY 1, 2"""))
def temporal_split(spark, sf):
    from structpeak.operators.evaluate import by_time
    from structpeak.queries.base import pairs

    return by_time(pairs(spark, sf), 1999).groupBy("region", "part").agg(
        F.count("*").alias("n"), F.round(F.avg("label"), 4).alias("mean_label"))


@query("region_transfer", sql(("pairs",), """
    SELECT round(slope, 6) AS slope, round(intercept, 4) AS intercept, t.region, count(*) AS n,
           round(avg(abs(slope * peak_h0 + intercept - label)), 4) AS mae
    FROM (SELECT CASE WHEN ok THEN s ELSE 1.0 END AS slope, CASE WHEN ok THEN b ELSE 0.0 END AS intercept FROM (
            SELECT regr_slope(label, peak_h0) AS s, regr_intercept(label, peak_h0) AS b, count(*) >= 2 AND regr_sxx(label, peak_h0) > 0 AS ok
            FROM pairs WHERE region = 'ASIA')),
         pairs t WHERE t.region <> 'ASIA' GROUP BY ALL"""))
def region_transfer(spark, sf):
    """Calibrated on one region, tested on the others."""
    from structpeak.operators.labels import calibration_line
    from structpeak.queries.base import pairs

    base = pairs(spark, sf)
    line = calibration_line(base.where(F.col("region") == "ASIA"), "peak_h0", "label")
    a, b = line.select("slope").scalar(), line.select("intercept").scalar()
    moved = base.where(F.col("region") != "ASIA").withColumns({"slope": a, "intercept": b})
    miss = F.abs(F.col("slope") * F.col("peak_h0") + F.col("intercept") - F.col("label"))
    return moved.groupBy("slope", "intercept", "region").agg(F.count("*").alias("n"), F.round(F.avg(miss), 4).alias("mae")).select(
        F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "region", "n", "mae")
