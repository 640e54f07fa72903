import numpy as np
import pytest
from pyspark.sql import functions as F

from structpeak.config import PeakConfig
from structpeak.operators.contamination import contaminated_copies
from structpeak.operators.joins import interval_left_join
from structpeak.operators.merge import upsert
from structpeak.operators.registry import align_registry, align_windows, registry_months, registry_stats
from structpeak.operators.sampling import fold_assignment, frozen_split, list_digest, nested_chains, rows_of_sample, sample_entities, sample_windows, stratified_sample
from structpeak.sources import jdbc
from structpeak.sources.tables import read_measurements, write_measurements


def test_measurements_of_two_regions(spark, tmp_path):
    a = spark.createDataFrame([("x", "2024-01-01", 2024, 1.0, 9.0), ("x", "2024-01-02", 2024, float("nan"), 9.0)], "id string, at string, y int, MVA double, IMAX double")
    a.write.parquet(str(tmp_path / "N" / "leaf"))
    a.drop("MVA").write.parquet(str(tmp_path / "S" / "leaf"))
    names = {"entity": "id", "ts": "at", "year": "y"}
    df = read_measurements(spark, str(tmp_path), ["N", "S"], "MVA", names, "leaf")
    rows = sorted((r["region"], r["ts"], r["value"]) for r in df.collect() if True)
    assert [(r[0], r[2]) for r in rows] == [("N", 1.0), ("N", None), ("S", None), ("S", None)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "IMAX" not in plan  # only used columns are read
    write_measurements(df, str(tmp_path / "out"))
    one = spark.read.parquet(str(tmp_path / "out")).where((F.col("region") == "N") & (F.col("year") == 2024))
    assert one.count() == 2 and "PartitionFilters: [isnotnull(region" in one._jdf.queryExecution().executedPlan().toString()


def test_jdbc_options_hold_no_literals():
    target = jdbc.target_from_secrets("store", "some.Driver", {"STORE_URL": "jdbc:x", "STORE_USER": "u", "STORE_PASSWORD": "secret"})
    assert target.options("t") == {"url": "jdbc:x", "dbtable": "t", "driver": "some.Driver", "user": "u", "password": "secret"}
    assert "secret" not in repr(target)
    with pytest.raises(KeyError):
        jdbc.target_from_secrets("store", "some.Driver", {})
    assert jdbc.partition_options("year", 2018, 2024, 4)["numPartitions"] == "4"


REGISTRY = [(" r ", "a ", 2023, 1, 10.0), (" r ", "a ", 2023, 2, None), (" r ", "a ", 2023, 3, 16.0), ("r", "b", 2023, 1, 4.0), ("r", "b", 2022, 12, 5.0)]


@pytest.fixture(scope="module")
def months(spark):
    df = spark.createDataFrame(REGISTRY, "region string, entity string, year int, month int, level double")
    return registry_months(df.withColumn("period", F.col("year") * 100 + F.col("month")))


def test_registry_change_spans_missing_months(months):
    got = {(r["entity"], r["year"], r["month"]): r["level_delta"] for r in months.collect()}
    assert got == {("a", 2023, 1): 0.0, ("a", 2023, 3): 6.0, ("b", 2022, 12): 0.0, ("b", 2023, 1): -1.0}
    stats = registry_stats(months).head()
    assert np.allclose(list(stats), [8.75, np.std([10, 16, 4, 5]), np.std([0, 6, 0, -1])])
    empty = registry_stats(months.where("level > 100")).head()
    assert list(empty) == [0.0, 1.0, 1.0]


def test_readings_and_windows_align_alike(spark, months):
    stamps = ["2023-01-31 23:50:00", "2023-02-01 00:00:00", "2023-03-05 00:00:00", "2022-11-30 00:00:00", "2024-01-01 00:00:00"]
    rows = [("r", e, i, t) for e in ("a", "b", "c") for i, t in enumerate(stamps)]
    readings = spark.createDataFrame(rows, "region string, entity string, i int, t string").withColumn("ts", F.col("t").cast("timestamp"))
    stats = registry_stats(months)
    got = {(r["entity"], r["i"]): (r["level"], r["level_delta"]) for r in align_registry(readings, months, stats).collect()}
    s = stats.head()
    assert np.allclose(got["a", 0], [(10 - s[0]) / s[1], 0.0]) and np.allclose(got["a", 2], [(16 - s[0]) / s[1], 6 / s[2]])
    assert all(got[e, i] == (0.0, 0.0) for e, i in [("a", 1), ("a", 3), ("a", 4), ("c", 0), ("b", 3)])
    windows = readings.groupBy("region", "entity").agg(F.sort_array(F.collect_list(F.struct("i", "ts"))).getField("ts").alias("times"))
    for r in align_windows(windows, months, stats.head().asDict()).collect():
        assert np.allclose(r["level"], [got[r["entity"], i][0] for i in range(5)])
        assert np.allclose(r["level_delta"], [got[r["entity"], i][1] for i in range(5)])


@pytest.mark.parametrize("small", [True, False])
def test_interval_join_is_half_open_and_left(spark, small):
    prices = spark.createDataFrame(
        [("s", "2024-01-15", "2024-03-01", 1.0), ("s", "2024-03-01", None, 2.0), ("q", "2023-01-01", "2023-02-01", 9.0)],
        "sku string, f string, t string, price double").select("sku", F.col("f").cast("timestamp").alias("f"), F.col("t").cast("timestamp").alias("t"), "price")
    uses = spark.createDataFrame(
        [(1, "s", "2024-01-14"), (2, "s", "2024-01-15"), (3, "s", "2024-02-29"), (4, "s", "2024-03-01"), (5, "s", "2030-01-01"), (6, "z", "2024-02-01"), (7, None, "2024-02-01")],
        "id int, sku string, d string").select("id", "sku", F.col("d").cast("timestamp").alias("at"))
    got = {r["id"]: r["price"] for r in interval_left_join(uses, prices, ["sku"], "at", "f", "t", small).collect()}
    assert got == {1: None, 2: 1.0, 3: 1.0, 4: 2.0, 5: 2.0, 6: None, 7: None}


TARGET = "region string, entity string, h0 double, h1 double"


def test_upsert_rules(spark):
    target = spark.createDataFrame([("r", "a", 1.0, 5.0), ("r", "b", 2.0, 6.0), (None, "c", 3.0, 7.0)], TARGET)
    source = spark.createDataFrame([("r", "a", None), ("r", "z", 9.0), (None, "c", 8.0)], "region string, entity string, h0 double")
    keys = ["region", "entity"]
    got = upsert(target, source, keys, {"h0": "h0"}, ["region", "entity", "h0"])
    want = {("r", "a", None, 5.0), ("r", "b", 2.0, 6.0), (None, "c", 3.0, 7.0), ("r", "z", 9.0, None), (None, "c", 8.0, None)}
    assert {tuple(r) for r in got.collect()} == want and got.schema.names == target.schema.names
    only = upsert(target, source, keys, {"h0": "h0"})
    assert {tuple(r) for r in only.collect()} == {("r", "a", None, 5.0), ("r", "b", 2.0, 6.0), (None, "c", 3.0, 7.0)}
    twice = source.unionByName(source.where("entity = 'a'"))
    with pytest.raises(Exception, match="duplicate merge source key: r,a"):
        upsert(target, twice, keys, {"h0": "h0"}).collect()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("partitions", [1, 17])
def test_samples_ignore_partitioning(spark, partitions):
    df = spark.range(200).select(F.lit("r").alias("region"), (F.col("id") % 40).cast("string").alias("entity"), F.lit(1).alias("year"), F.col("id").alias("window_id"))
    other = df.repartition(partitions)
    assert rows(sample_entities(df, 7, 3)) == rows(sample_entities(other, 7, 3))
    assert rows(sample_entities(df, 7, 3)) != rows(sample_entities(df, 7, 4))
    assert rows_of_sample(df, sample_entities(df, 7, 3)).count() == 35
    drawn = sample_windows(df, 2, 5)
    assert rows(drawn) == rows(sample_windows(other, 2, 5)) and drawn.count() == 80
    assert rows(fold_assignment(df, 5, 1)) == rows(fold_assignment(other, 5, 1))
    digest = list_digest(df, ["entity", "window_id"]).head()
    assert digest == list_digest(other, ["entity", "window_id"]).head()
    assert digest["digest"] != list_digest(df.limit(199), ["entity", "window_id"]).head()["digest"]


def test_split_chain_and_strata(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("entity"), F.when(F.col("id") < 700, "big").otherwise("small").alias("region"))
    split = {(r["region"], r["is_test"]): r["count"] for r in frozen_split(df, ["region"], 0.2, 1).groupBy("region", "is_test").count().collect()}
    assert split == {("big", True): 140, ("big", False): 560, ("small", True): 60, ("small", False): 240}
    chain = nested_chains(df, [10, 50], 3, 1, ["entity"]).where("first_level is not null")
    sizes = {(r["repetition"], r["first_level"]): r["count"] for r in chain.groupBy("repetition", "first_level").count().collect()}
    assert sizes == {(r, n): c for r in (1, 2, 3) for n, c in ((10, 10), (50, 40))}
    assert stratified_sample(df, ["region"], 100, 1, ["entity"]).groupBy("region").count().orderBy("region").collect() == [("big", 70), ("small", 30)]


def test_contamination_keeps_shape_and_is_seeded(spark):
    config = PeakConfig(noise=0.0, replicas=3, plateau_probability=1.0, spike_probability=0.0)
    windows = spark.range(200).select(F.lit("r").alias("region"), F.lit("e").alias("entity"), F.lit(1).alias("year"), F.col("id").alias("window_id"),
                                      F.array_repeat(F.lit(0.0), 144).alias("values"))
    got = contaminated_copies(windows, config).collect()
    x = np.array([r["contaminated"] for r in got])
    assert x.shape == (600, 144) and {r["replica"] for r in got} == {1, 2, 3}
    heights = np.abs(x).max(axis=1)
    assert heights.min() >= 1.0 and heights.max() <= 3.0 and (x.max(axis=1) > 0).mean() > 0.4
    assert all(len(set(np.round(np.abs(row[row != 0]), 9))) == 1 for row in x)  # one level per plateau
    held = (x != 0).sum(axis=1)
    assert held.max() < 144 + 1 and (held >= 1).all()
    spikes = contaminated_copies(windows, config.with_(plateau_probability=0.0, spike_probability=1.0)).collect()
    n = np.array([(np.array(r["contaminated"]) != 0).sum() for r in spikes])
    assert n.min() >= 1 and n.max() <= 3
    quiet = contaminated_copies(windows, config.with_(plateau_probability=0.0, noise=0.05)).collect()
    assert abs(np.std([r["contaminated"] for r in quiet]) - 0.05) < 0.002
    again = contaminated_copies(windows.repartition(9), config).orderBy("window_id", "replica").collect()
    assert sorted(again) == sorted(got)


def test_durable_keeps_rows(spark):
    from structpeak.session import durable

    df = spark.range(100).withColumn("x", F.col("id") * 2)
    kept = durable(df)
    assert rows(kept) == rows(df) and "Range" not in kept._jdf.queryExecution().executedPlan().toString()
