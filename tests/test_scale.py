"""What grows with the tables: exchanges, passes and repeated work of the queries measured at size."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from structpeak import session
from structpeak.operators import changes, contamination, hotkeys, series
from structpeak.operators.baselines import daily_medians
from structpeak.operators.changes import change_points
from structpeak.operators.model import block_mean_denoiser, fit_denoiser
from structpeak.operators.pooled import pooled_codes
from structpeak.operators.series import series_windows
from structpeak.plans.scoring import raw_window_peaks
from structpeak.queries import base


@pytest.fixture
def no_guess(spark):
    """A session whose optimiser broadcasts nothing by itself, as with large tables."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, was)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_stay_where_they_are_read(no_guess, sf):
    assert "Exchange hashpartitioning(l_suppkey" not in plan(base.readings(no_guess, sf))
    assert "Exchange hashpartitioning(l_suppkey" not in plan(base.label_log(no_guess, sf))


def test_many_suppliers_are_not_sent(no_guess, sf, monkeypatch):
    want = sorted(map(str, base.readings(no_guess, sf).collect()))
    monkeypatch.setattr(base, "MOST_SENT", 3)
    found = base.readings(no_guess, sf)
    assert "Exchange hashpartitioning(l_suppkey" in plan(found) and sorted(map(str, found.collect())) == want


def days(spark):
    rows = [("r", "a", 2020, f"2020-01-0{1 + i % 5} 00:00:00", float(v)) for i, v in enumerate([3, 1, 2, 9, 4, 5, 6, 7, 8, 2, 11])]
    rows += [("r", "b", 2020, "2020-02-01 00:00:00", None), ("r", None, 2020, "2020-02-01 00:00:00", 1.0), ("r", "c", 2020, None, 1.0)]
    return spark.createDataFrame(rows, "region string, entity string, year int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))


def test_daily_medians_and_segments_share_one_exchange(no_guess, tmp_path):
    days(no_guess).write.parquet(str(tmp_path / "r"))
    medians = daily_medians(no_guess.read.parquet(str(tmp_path / "r")))
    assert plan(change_points(medians)).count("Exchange hashpartitioning") == 1
    got = {(r["entity"], r["day"].day): (r["day_max"], r["day_median"]) for r in medians.collect()}
    assert got == {("a", 1): (11.0, 5.0), ("a", 2): (6.0, 3.5), ("a", 3): (7.0, 4.5), ("a", 4): (9.0, 8.5), ("a", 5): (4.0, 3.0)}


def test_change_points_take_many_series_at_once(spark, monkeypatch):
    assert "MapInArrow" in plan(change_points(daily_medians(days(spark))))
    draw = np.random.default_rng(3)
    rows = [("r", f"s{e}", 2020, dt.date(2020, 1, 1) + dt.timedelta(int(i)), float(draw.normal(5 * (i > 20), 1))) for e in range(60) for i in range(30 + e % 3)]
    df = spark.createDataFrame(rows, "region string, entity string, year int, day date, day_median double")
    want = sorted(map(tuple, change_points(df, 0.5).collect()))
    monkeypatch.setattr(changes, "CELLS", 40)
    assert sorted(map(tuple, change_points(df, 0.5).collect())) == want and len(want) >= 120


def test_codes_of_a_series_take_one_pass(spark, sf):
    windows = spark.createDataFrame([("r", "a", 2020, [float(i + k) for i in range(24)]) for k in (0, 5, 9)], "region string, entity string, year int, values array<double>")
    model = block_mean_denoiser(base.CONFIG.with_(channels=("value",)), 6)
    found = pooled_codes(windows, model)
    assert plan(found).count("ArrowEvalPython") == 1 and "Generate" not in plan(found)
    codes = np.array([[1.5 + 4 * b + k for b in range(6)] for k in (0, 5, 9)])
    want = np.stack([codes.mean(axis=0), *np.quantile(codes, [0.1, 0.5, 0.9], axis=0)], axis=1).ravel()
    assert np.allclose(found.head()["summary"], want)
    hot = pooled_codes(windows, model, spread="few")
    assert np.allclose(hot.head()["summary"], want)


def test_draws_are_made_once_a_fit(spark, monkeypatch):
    """Kept copies are read by every round; those of the caller are taken as they are."""
    made = []
    monkeypatch.setattr(contamination, "contaminate", lambda values, seed, config, old=contamination.contaminate: made.append(1) or old(values, seed, config))
    config = base.CONFIG.with_(channels=("value",), replicas=2)
    windows = spark.range(40).select(F.lit("r").alias("region"), F.lit("a").alias("entity"), F.lit(2020).alias("year"), F.col("id").alias("window_id"),
                                     F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.sin(i + F.col("id"))).alias("values"))
    first = fit_denoiser(windows, config)
    assert len(made) == 2
    kept = contamination.with_copies(windows, config)
    second = fit_denoiser(kept, config)
    assert len(made) == 4 and np.allclose(first.encode @ first.decode, second.encode @ second.decode) and np.allclose(first.center, second.center)
    direct = {(r["window_id"], r["replica"]): r["contaminated"] for r in contamination.contaminated_copies(windows, config).collect()}
    assert direct == {(r["window_id"], r["replica"]): r["contaminated"] for r in contamination.contaminated_copies(kept, config).collect()}


def test_spread_readings_move_without_what_nobody_reads(spark):
    """Numbering and slots read one exchange of keys as a struct; unwanted window times don't move."""
    windows = series_windows(days(spark), 3, spread="many", times=False)
    assert "times" not in windows.columns and "times" in series_windows(days(spark), 3, spread="many").columns
    moved = [line for line in plan(windows).splitlines() if "Exchange hashpartitioning(_key" in line]
    assert moved and not any("hashpartitioning(region" in line for line in moved)


def test_short_series_take_wide_slots(spark, monkeypatch):
    """Of many series only those that a task could not hold are cut by the hour; both kinds give the positions and values of one sort."""
    rows = [("r", e, 2020, dt.datetime(2020, 1 + i % 12, 1 + i % 5, i % 24), None if i % 7 == 3 else float(i * 37 % 101), i) for e, n in (("long", 90), ("short", 30), (None, 25)) for i in range(n)]
    rows += [("r", "short", 2020, None, 5.0, 99)]
    df = spark.createDataFrame(rows, "region string, entity string, year int, ts timestamp, value double, i int")
    keys = ["region", "entity", "year"]
    want = sorted(map(str, series.fill_gaps(df, keys, tie=["i"]).select(*keys, "i", "pos", F.round("filled", 9)).collect()))
    slots = {}
    for most in (1_000, 50, 1):
        monkeypatch.setattr(hotkeys, "TASK_ROWS", most)
        got = series.fill_gaps(df, keys, tie=["i"], spread="many").select(*keys, "i", "pos", F.round("filled", 9))
        assert sorted(map(str, got.collect())) == want
        slots[most] = {r["entity"]: r["n"] for r in series._slot_start(df, keys, "ts", "many").groupBy("entity").agg(F.countDistinct("_slot").alias("n")).collect()}
    assert slots[1_000] == {"long": 4, "short": 4, None: 4}
    assert slots[50]["long"] > 50 and slots[50]["short"] == 4 and slots[1]["short"] > 20


def test_spread_steps_release_their_disk(spark, monkeypatch):
    """The quantile of the spread form reads stored points: nothing that filling, scaling or cutting moved is held by then."""
    monkeypatch.setattr(hotkeys, "LISTED_KEYS", 1)  # with task_rows=0 every series takes the spread form
    found = raw_window_peaks(days(spark), 3, 0.999, task_rows=0)
    assert "_slot" not in plan(found) and "window_id" not in plan(found) and "released" in plan(found)
    peaks = lambda df: sorted(map(str, df.withColumn("peak", F.round("peak", 9)).collect()))
    want = peaks(raw_window_peaks(days(spark), 3, 0.999, task_rows=100))
    assert peaks(found) == want
    kept = spark.range(3)
    monkeypatch.setattr(session, "shared_folder", lambda *a: (_ for _ in ()).throw(RuntimeError("no folder")))
    assert session.released(kept) is kept
    assert peaks(raw_window_peaks(days(spark), 3, 0.999, task_rows=0)) == want
