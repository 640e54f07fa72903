"""Change points, rule weights and small-sample statistics against plain Python."""

import datetime as dt
import itertools
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from structpeak.operators.changes import change_points, learn_rules
from structpeak.operators.sampling import nested_chains, split_frozen, stratified_sample
from structpeak.operators.statistics import accelerated_interval, adjacent_differences, cluster_bootstrap, exact_signed_rank, normal_quantile, normal_share, pair_deviation

KEY = "region string, entity string, year int"


def cheapest_cut(x, charge):
    cost, back = [-charge], []
    for t in range(1, len(x) + 1):
        trials = [cost[s] + float(((x[s:t] - x[s:t].mean()) ** 2).sum()) + charge for s in range(t)]
        back.append(int(np.argmin(trials)))
        cost.append(min(trials))
    out, at = [len(x)], len(x)
    while at:
        at = back[at - 1]
        out.insert(0, at)
    return out


def test_change_points_equal_the_unpruned_programme(spark):
    draw = np.random.default_rng(6)
    series = {f"s{k}": np.concatenate([draw.normal(m, 1, draw.integers(1, 40)) for m in draw.choice([0, 3, 10, -6], draw.integers(1, 7))]) for k in range(25)}
    series |= {"same": np.full(50, 2.0), "one": np.array([5.0]), "two": np.array([1.0, 9.0])}
    rows = [("r", e, 2020, dt.date(2020, 1, 1) + dt.timedelta(2 * i), float(v)) for e, x in series.items() for i, v in enumerate(x)] + [("r", "gone", 2020, dt.date(2020, 1, 1), None)]
    df = spark.createDataFrame(rows, KEY + ", day date, day_median double").repartition(4)
    for penalty in (0.05, 1.0):
        got = {}
        for r in change_points(df, penalty).orderBy("entity", "segment").collect():
            got.setdefault(r["entity"], []).append(r)
        assert set(got) == set(series)
        for e, x in series.items():
            cut = cheapest_cut(x, penalty * x.var() * math.log(len(x)))
            if e != "same":  # any cut of a constant series without charge costs nothing
                assert [r["n_days"] for r in got[e]] == np.diff(cut).tolist()
            assert [r["segment"] for r in got[e]] == list(range(len(got[e]))) and sum(r["n_days"] for r in got[e]) == len(x)
            assert got[e][0]["first_day"] == dt.date(2020, 1, 1) and got[e][-1]["last_day"] == dt.date(2020, 1, 1) + dt.timedelta(2 * (len(x) - 1))
    assert change_points(df.limit(0)).count() == 0


def test_a_plateau_is_one_segment(spark):
    x = np.r_[np.zeros(100), np.full(40, 9.0), np.zeros(100)] + np.random.default_rng(1).normal(0, 0.3, 240)
    rows = [("r", "a", 2020, dt.date(2020, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(x)]
    got = change_points(spark.createDataFrame(rows, KEY + ", day date, day_median double"), 0.1).orderBy("segment").collect()
    assert [r["n_days"] for r in got] == [100, 40, 100] and abs(got[1]["segment_level"] - 9) < 0.2


def test_rule_weights_are_recovered(spark):
    """Three independent rules on rows whose class nobody tells."""
    draw = np.random.default_rng(8)
    true = draw.random(20000) < 0.3
    share = np.where(true[:, None], [0.9, 0.8, 0.7], [0.1, 0.2, 0.05])
    votes = draw.random(share.shape) < share
    rows = [(int(i), *map(bool, v), bool(t)) for i, (v, t) in enumerate(zip(votes, true))] + [(-1, None, True, True, True)]
    df = spark.createDataFrame(rows, "id int, a boolean, b boolean, c boolean, truth boolean")
    model = learn_rules(df, ["a", "b", "c"], 200)
    assert np.allclose([model.prior, *model.if_true, *model.if_false], [0.3, 0.9, 0.8, 0.7, 0.1, 0.2, 0.05], atol=0.03)
    scored = df.withColumn("p", model.probability())
    right = scored.where("id >= 0").agg(F.avg(((F.col("p") > 0.5) == F.col("truth")).cast("double"))).head()[0]
    assert right > 0.92 and scored.where("id = -1").head()["p"] > 0.5
    with pytest.raises(ValueError, match="no row"):
        learn_rules(df.limit(0), ["a"])


def brute_signed_rank(d):
    d = [x for x in d if x]
    size = sorted(map(abs, d))
    rank = [(size.index(abs(x)) + 1 + len(size) - size[::-1].index(abs(x))) / 2 for x in d]
    plus = sum(r for r, x in zip(rank, d) if x > 0)
    sums = [sum(r for r, s in zip(rank, signs) if s) for signs in itertools.product([0, 1], repeat=len(d))]
    return plus, min(1.0, 2 * min(sum(x <= plus for x in sums), sum(x >= plus for x in sums)) / len(sums))


def test_exact_signed_ranks_equal_enumeration(spark):
    draw = np.random.default_rng(9)
    sets = {f"g{k}": draw.integers(-4, 7, k).astype(float) for k in range(1, 13)} | {"big": draw.normal(size=40), "zeros": np.zeros(3), None: np.array([1.0, -2.0, 3.0])}
    df = spark.createDataFrame([(g, float(v)) for g, x in sets.items() for v in x] + [("g5", None)], "g string, d double")
    got = {r["g"]: r for r in exact_signed_rank(df, "d", ["g"]).collect()}
    for g, x in sets.items():
        if not (x != 0).any():
            assert g not in got
        elif len(x) > 25:
            assert got[g]["n"] == 40 and got[g]["p_value"] is None
        else:
            plus, p = brute_signed_rank(x.tolist())
            assert (got[g]["w_plus"], got[g]["n"]) == (plus, int((x != 0).sum())) and got[g]["p_value"] == pytest.approx(p)


def test_normal_quantile_and_share(spark):
    ps = [1e-6, 0.001, 0.02, 0.025, 0.3, 0.5, 0.7, 0.976, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("z"))
    for r in df.withColumn("back", normal_share(F.col("z"))).collect():
        assert r["z"] == pytest.approx(statistics.NormalDist().inv_cdf(r["p"]), abs=1e-6) and r["back"] == pytest.approx(r["p"], abs=1e-6)


def test_accelerated_interval_equals_plain_python(spark):
    draw = np.random.default_rng(10)
    rows = [("x" if i % 2 else None, f"e{i}", float(draw.gamma(0.5)), float(draw.integers(1, 5))) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, entity string, num double, den double")
    normal = statistics.NormalDist()
    per = cluster_bootstrap(df, "num", "den", "entity", 300, 5, ["g"]).collect()
    from structpeak.operators.statistics import _draw_estimates

    sums = df.groupBy("g", "entity").agg(F.sum("num").alias("_num"), F.sum("den").alias("_den"))
    draws = {}
    for r in _draw_estimates(sums, "entity", 300, 5, ["g"]).collect():
        draws.setdefault(r["g"], []).append(r["_est"])
    assert len(per) == 2
    for r in accelerated_interval(df, "num", "den", "entity", 300, 5, ["g"]).collect():
        own = [x for x in rows if x[0] == r["g"]]
        n, d = sum(x[2] for x in own), sum(x[3] for x in own)
        est = n / d
        left = np.array([(n - x[2]) / (d - x[3]) for x in own])
        u = left.mean() - left
        a = (u**3).sum() / (6 * (u**2).sum() ** 1.5)
        found = np.sort(draws[r["g"]])
        z0 = normal.inv_cdf(((found < est).sum() + 0.5 * (found == est).sum()) / len(found))
        ends = [np.quantile(found, normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (-1.959963984540054, 1.959963984540054)]
        assert [r["estimate"], r["bias"], r["acceleration"], r["lower"], r["upper"]] == pytest.approx([est, z0, a, *ends], abs=1e-5)


def test_every_pair_of_annotators(spark):
    df = spark.createDataFrame([("k", "c", 3.0), ("k", "a", 1.0), ("k", "b", 2.5), ("one", "a", 1.0), ("two", "b", 4.0), ("two", "a", 1.0), ("two", "c", None)], "k string, who string, v double")
    got = {(r["k"], r["first_annotator"], r["second_annotator"]): r["deviation"] for r in pair_deviation(df, ["k"], "who", "v").collect()}
    assert got == {("k", "a", "b"): 1.5, ("k", "a", "c"): 2.0, ("k", "b", "c"): 0.5, ("two", "a", "b"): 3.0}


def test_samples_keep_the_columns_of_the_input(spark):
    df = spark.createDataFrame([("r" if i % 3 else "s", f"e{i % 40}", i, "mine") for i in range(120)], "region string, entity string, n int, total string")
    chained = nested_chains(df, [10, 50], 2, 1, ["entity", "n"])
    assert {r["total"] for r in chained.collect()} == {"mine"} and chained.count() == 240
    assert {r["total"] for r in stratified_sample(df, ["region"], 30, 1, ["entity", "n"]).collect()} == {"mine"}
    for bad in (nested_chains, lambda d, *a: stratified_sample(d, ["region"], 5, 1, ["entity"])):
        with pytest.raises(ValueError, match="position"):
            bad(df.withColumn("position", F.lit(1)), [10], 2, 1, ["entity"])
    pool, test = split_frozen(df, ["region"], 0.2, 11)
    assert pool.count() + test.count() == 120 and pool.columns == df.columns
    assert not {(r["region"], r["entity"]) for r in pool.collect()} & {(r["region"], r["entity"]) for r in test.collect()}


def test_differences_to_the_next_smaller_level(spark):
    runs = spark.createDataFrame([(1, 10, 5.0), (1, 25, 4.0), (1, 50, 4.5), (2, 10, 1.0), (2, 50, 0.5)], "rep int, level int, mae double")
    got = sorted((r["rep"], r["smaller"], r["level"], r["diff"]) for r in adjacent_differences(runs, "level", "rep", "mae").collect())
    assert got == [(1, 10, 25, -1.0), (1, 25, 50, 0.5), (2, 10, 50, -0.5)]
