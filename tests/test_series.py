import numpy as np
import pytest
from pyspark.sql import functions as F

from structpeak.operators import series as S
from structpeak.operators.baselines import hampel_filter, sustained_level
from structpeak.operators.hotkeys import FEW, MANY, by_group_size, split_hot
from structpeak.plans.scoring import raw_window_peaks

KEY = ["region", "entity", "year"]


def frame(spark, groups, partitions=None):
    """``groups``: name -> list of values, ten minutes apart."""
    rows = [("r", g, 2024, i, v) for g, values in groups.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "region string, entity string, year int, i int, value double")
    df = df.withColumn("ts", F.timestamp_add("MINUTE", F.col("i") * 10, F.lit("2024-01-01").cast("timestamp")))
    return df.repartition(partitions) if partitions else df


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(0)
    holes = [None if rng.random() < 0.3 else float(x) for x in rng.normal(10, 2, 500)]
    groups = {
        "full": [float(x) for x in rng.normal(5, 1, 300)], "holes": holes, "short": [1.0, None, 4.0],
        "flat": [3.0] * 60, "empty": [None] * 50, "edges": [None, None, 2.0, None, 6.0, None],
        "late": [None] * 200 + [7.0] + [None] * 100,
    }
    return groups, frame(spark, groups)


def numpy_fill(values):
    x = np.array([np.nan if v is None else v for v in values])
    good = np.isfinite(x)
    return np.interp(np.arange(len(x)), np.flatnonzero(good), x[good]) if good.any() else np.zeros(len(x))


@pytest.mark.parametrize("spread", [False, FEW, MANY])
def test_gap_fill(mixed, spread):
    groups, df = mixed
    got = S.fill_gaps(df, KEY, tie=["i"], spread=spread).orderBy("entity", "pos").collect()
    for name, values in groups.items():
        mine = [r for r in got if r["entity"] == name]
        assert [r["pos"] for r in mine] == list(range(1, len(values) + 1))
        assert [r["i"] for r in mine] == list(range(len(values)))
        assert np.allclose([r["filled"] for r in mine], numpy_fill(values))


def numpy_scale(values):
    x = np.array([v for v in values if v is not None])
    if not len(x):
        return 0.0, 1.0
    lo, hi = np.percentile(x, [25, 75])
    return float(np.median(x)), hi - lo if hi - lo > 1e-9 else (float(np.std(x)) or 1.0)


@pytest.mark.parametrize("spread", [False, FEW, MANY])
def test_robust_scaler(mixed, spread):
    groups, df = mixed
    got = {r["entity"]: (r["median"], r["scale"]) for r in S.robust_scaler(df, KEY, spread=spread).collect()}
    assert set(got) == set(groups)
    for name, values in groups.items():
        assert np.allclose(got[name], numpy_scale(values)), name
    wide = {r["entity"]: (r["median"], r["scale"]) for r in S.with_scaler(df, KEY, spread=spread).collect()}
    assert all(np.allclose(wide[n], got[n]) for n in groups)


def test_tiny_scaler_round_trip(spark):
    df = frame(spark, {"a": [1.0, 2.0, 3.0, 4.0, 100.0]})
    r = S.robust_scaler(df, KEY).head()
    assert (r["median"], r["scale"]) == (3.0, 2.0)
    back = spark.range(1).select(S.unscaled(S.scaled(F.lit(3.0), F.lit(3.0), F.lit(2.0)), F.lit(3.0), F.lit(2.0))).head()[0]
    assert abs(back - 3.0) < 1e-6


def numpy_windows(values, length, stride):
    s = numpy_fill(values)
    if len(s) < length:
        return [list(s) + [s[-1]] * (length - len(s))]
    return [list(s[i * stride : i * stride + length]) for i in range(1 + (len(s) - length) // stride)]


@pytest.mark.parametrize("spread", [False, FEW, MANY])
@pytest.mark.parametrize("length,stride", [(144, 144), (24, 24), (24, 10), (24, 30), (24, 1)])
def test_windows(mixed, spread, length, stride):
    groups, df = mixed
    filled = S.fill_gaps(df, KEY, tie=["i"], spread=spread)
    got = S.fixed_windows(filled, length, stride, KEY).orderBy("entity", "window_id").collect()
    for name, values in groups.items():
        mine = [r for r in got if r["entity"] == name]
        want = numpy_windows(values, length, stride)
        assert [r["window_id"] for r in mine] == list(range(len(want))), name
        assert np.allclose([r["filled"] for r in mine], want)


def test_short_series_can_be_left_out(mixed):
    _, df = mixed
    got = S.series_windows(df, 144, tie=["i"], pad_short=False).select("entity").distinct().collect()
    assert {r[0] for r in got} == {"full", "holes", "late"}


def test_window_of_300_points(spark):
    df = frame(spark, {"a": [float(i) for i in range(300)]})
    got = S.fixed_windows(S.fill_gaps(df, KEY), 144).orderBy("window_id").collect()
    assert [len(r["filled"]) for r in got] == [144, 144]


def test_hot_series_takes_the_spread_form(mixed):
    """Routing by size gives the same peaks as one form for all, and as numpy."""
    groups, df = mixed
    ordinary, hot, spread = split_hot(df, KEY, 250)
    assert spread == FEW
    assert {r[0] for r in hot.select("entity").distinct().collect()} == {"full", "holes", "late"}
    assert ordinary.count() + hot.count() == df.count()
    split = raw_window_peaks(df, 24, 0.99, ["i"], task_rows=250).collect()
    whole = raw_window_peaks(df, 24, 0.99, ["i"]).collect()
    a, b = ({r["entity"]: r["peak"] for r in rows} for rows in (split, whole))
    for name, values in groups.items():
        want = np.quantile(np.concatenate(numpy_windows(values, 24, 24)), 0.99)
        assert abs(a[name] - want) < 1e-9 and abs(b[name] - want) < 1e-9


def test_null_key_parts_form_a_group(spark):
    df = frame(spark, {"a": [1.0, 2.0, 3.0] * 20}).withColumn("entity", F.lit(None).cast("string"))
    for limit in (10, 1000):
        rows = by_group_size(df, KEY, lambda p, spread: S.fill_gaps(p, KEY, tie=["i"], spread=spread), limit).collect()
        assert sorted(r["pos"] for r in rows) == list(range(1, 61))


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_partitioning_does_not_matter(spark, mixed, partitions):
    groups, df = mixed
    base = S.series_windows(df, 24, tie=["i"]).orderBy("entity", "window_id").collect()
    other = S.series_windows(frame(spark, groups, partitions), 24, tie=["i"]).orderBy("entity", "window_id").collect()
    assert base == other


def test_full_groups(mixed):
    _, df = mixed
    kept = {r[0] for r in S.full_groups(df, KEY, 60).select("entity").distinct().collect()}
    assert kept == {"full", "holes", "flat", "late"}


@pytest.mark.parametrize("spread,chunk", [(False, 1), (FEW, 37), (MANY, 2)])
def test_hampel_and_sustained_by_chunks(mixed, spread, chunk):
    groups, df = mixed
    cleaned = hampel_filter(df, 3, 3.0, KEY, ["i"], spread, chunk).orderBy("entity", "pos").collect()
    held = sustained_level(df, 5, KEY, ["i"], spread, chunk).orderBy("entity", "pos").collect()
    for name, values in groups.items():
        got = [r["cleaned"] for r in cleaned if r["entity"] == name]
        want = []
        for i, v in enumerate(values):
            near = np.array([x for x in values[max(0, i - 3) : i + 4] if x is not None])
            if v is None:
                want.append(None)
                continue
            mid = np.median(near)
            want.append(mid if abs(v - mid) > 3.0 * 1.4826 * np.median(np.abs(near - mid)) else v)
        assert len(got) == len(want) and all(a == b or abs(a - b) < 1e-9 for a, b in zip(got, want))
        filled = numpy_fill(values)
        low = [r["held"] for r in held if r["entity"] == name]
        assert all(x is None for x in low[:4])
        assert np.allclose(low[4:], [filled[i - 4 : i + 1].min() for i in range(4, len(values))])


def exchanges(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_one_exchange_serves_the_series_chain(mixed):
    _, df = mixed
    plan = exchanges(S.series_windows(df.repartition(3), 24, tie=["i"]))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan
