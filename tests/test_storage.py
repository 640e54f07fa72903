"""Merge joins, upserts of single partitions and bucketed tables: results and plans."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from structpeak.config import RESULT_KEY
from structpeak.operators.joins import interval_left_join, interval_merge
from structpeak.operators.merge import touched_partitions, upsert
from structpeak.operators.series import fill_gaps, robust_scaler, series_windows
from structpeak.plans.results import RESULT_SCHEMA, publish_h0_table, publish_h1_table, write_results
from structpeak.sources.tables import catalog_table, save_series_table


def text(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def stamps(df, *columns):
    return df.withColumns({c: F.timestamp_seconds(c) for c in columns})


@pytest.fixture(scope="module")
def priced(spark):
    """Intervals with gaps, open ends, empty intervals and unknown keys; uses before, in, between and after them."""
    draw = random.Random(4)
    prices, uses = [], []
    for k in "abcde":
        at = draw.randrange(10**6)
        for n in range(draw.randrange(1, 30)):
            to = at + draw.randrange(1, 200000)
            prices.append((k, at, None if n == 28 else to, float(len(prices))))
            at = to + draw.choice([0, 0, 5, 300000])
    prices += [("f", 100, None, -1.0), ("g", 500, 500, -2.0), (None, 0, None, -3.0), ("h", None, 10, -4.0)]
    for i in range(3000):
        k = draw.choice(["a", "a", "a", "b", "c", "d", "e", "f", "g", "h", "z", None])
        uses.append((i, k, draw.choice([None, draw.randrange(5 * 10**6), draw.choice(prices)[1]])))
    want = {i: next((p for q, f, t, p in prices if q == k and k is not None and at is not None and f is not None and f <= at and (t is None or at < t)), None) for i, k, at in uses}
    left = stamps(spark.createDataFrame(uses, "id int, k string, at long"), "at").withColumn("_at", F.lit("mine"))
    return left.repartition(5), stamps(spark.createDataFrame(prices, "k string, f long, t long, price double"), "f", "t"), want


@pytest.mark.parametrize("slot", ["hour", "day", "year"])
def test_merged_intervals_equal_brute_force(priced, slot):
    left, right, want = priced
    out = interval_merge(left, right, ["k"], "at", "f", "t", slot)
    assert out.columns == ["id", "k", "at", "_at", "f", "t", "price"]
    assert {r["id"]: r["price"] for r in out.collect()} == want and {r["_at"] for r in out.collect()} == {"mine"}
    assert interval_merge(left.limit(0), right, ["k"], "at", "f", "t").count() == 0
    assert {r["price"] for r in interval_merge(left, right.limit(0), ["k"], "at", "f", "t").collect()} == {None}


def test_merge_repeats_and_broadcasts_nothing(spark, priced, tmp_path):
    left, right, _ = priced
    left.write.parquet(str(tmp_path / "l"))
    right.write.parquet(str(tmp_path / "r"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = text(interval_left_join(spark.read.parquet(str(tmp_path / "l")), spark.read.parquet(str(tmp_path / "r")), ["k"], "at", "f", "t"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "Generate" not in plan and "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning(_key") == 4  # all rows once; the slots, one row each, thrice


def test_overlapping_intervals_give_all_matches(spark):
    left = stamps(spark.createDataFrame([(1, "a", 50), (2, "a", 250), (3, "b", 50)], "id int, k string, at long"), "at")
    right = stamps(spark.createDataFrame([("a", 0, 100, 1.0), ("a", 40, None, 2.0)], "k string, f long, t long, price double"), "f", "t")
    got = sorted((r["id"], r["price"] or 0.0) for r in interval_left_join(left, right, ["k"], "at", "f", "t").collect())
    assert got == [(1, 1.0), (1, 2.0), (2, 2.0), (3, 0.0)]


def stored_files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_upsert_touches_named_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = [(r, "k", f"e{i}", "m", y, float(i), None, "v1", None) for r in ("n", "s", "7") for y in (2020, 2021, 2022) for i in range(5)]
    target = spark.createDataFrame(rows, RESULT_SCHEMA)
    write_results(target, path)
    before = stored_files(path)
    staged = spark.createDataFrame([("n", "k", "e1", "m", 2021, None, "v2"), ("n", "k", "new", "m", 2021, 9.0, "v2"), ("7", "k", "e0", "m", 2023, 5.0, "v2")],
                                   "region string, kind string, entity string, measure string, year int, peak_h0 double, model_version string")
    as_of = F.lit("2024-06-01").cast("timestamp")
    want = {tuple(r) for r in upsert(target, staged, RESULT_KEY, {"peak_h0": "peak_h0", "model_version": "model_version", "computed_at": as_of}, staged.columns).collect()}
    for _ in range(2):  # a second run of the same rows: updates, now also of the inserted ones
        publish_h0_table(spark, path, staged, as_of)
        got = spark.read.schema(RESULT_SCHEMA).parquet(path).select(*RESULT_SCHEMA.names)
        assert {tuple(r)[:8] for r in got.collect()} == {r[:8] for r in want} and got.count() == len(rows) + 2
        after = stored_files(path)
        same = {f for f in before if after.get(f) == before[f]}
        assert {f for f in before if "region=n/year=2021" not in f} == same
    publish_h1_table(spark, path, staged.select("region", "entity", "measure", "year", F.lit(3.5).alias("peak_h1")), as_of)
    assert {(r["region"], r["entity"], r["year"]) for r in spark.read.parquet(path).where("peak_h1 = 3.5").collect()} == {("n", "e1", 2021), ("n", "new", 2021), ("7", "e0", 2023)}


def test_partitions_are_named_with_unknown_parts(spark):
    source = spark.createDataFrame([("a", 1), ("a", None), (None, 2)], "r string, y int")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), (None, 2), (None, 1), ("b", 1)], "r string, y int")
    assert {tuple(x) for x in rows.where(touched_partitions(source, ["r", "y"])).collect()} == {("a", 1), ("a", None), (None, 2)}
    assert {tuple(x) for x in rows.where(touched_partitions(source.select("y"), ["y"])).collect()} == {tuple(x) for x in rows.collect()}
    assert rows.where(touched_partitions(source.limit(0), ["r", "y"])).count() == 0


def test_upsert_reads_each_side_once(spark, tmp_path):
    """Rows with unknown keys take the same join, dealt out by their salt."""
    spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 2.0), (None, 3.0)], "k string, v double").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([("a", 5.0), ("b", 6.0), (None, 7.0), (None, 7.0)], "k string, v double").write.parquet(str(tmp_path / "s"))
    target, source = (spark.read.parquet(str(tmp_path / n)) for n in "ts")
    out = upsert(target, source, ["k"], {"v": "v"}, ["k", "v"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 5.0), ("b", 6.0), (None, 2.0), (None, 2.0), (None, 3.0), (None, 7.0), (None, 7.0)], key=str)
    assert text(out).count("FileScan parquet") == 2


def test_bucketed_series_need_no_exchange(spark, tmp_path):
    rows = [("r", f"e{i % 7}", 2020, i, float(i) if i % 5 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "region string, entity string, year int, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    name = f"spark_catalog.default.series_{uuid.uuid4().hex}"
    save_series_table(df, name, 4, path=str(tmp_path / "series"))
    try:
        found = catalog_table(spark, name)
        for build in (fill_gaps, robust_scaler, lambda d: series_windows(d, 24)):
            plan = text(build(found))
            assert "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
            assert sorted(map(str, build(found).collect())) == sorted(map(str, build(df).collect()))
    finally:
        spark.sql(f"DROP TABLE {name}")
