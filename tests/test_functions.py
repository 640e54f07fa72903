import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from structpeak.functions import central_difference, finite, guarded_ratio, like_class, minutes_between, pad_to, rolling_spread, uniform, version_text
from structpeak.functions.draws import gaussian
from structpeak.operators.model import feature_matrix
from structpeak.operators.statistics import upper_tail


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


def test_finite_makes_null(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(finite("x")).collect()] == [1.5, None, None, None, None]


def test_guarded_ratio(spark):
    got = one(spark, guarded_ratio(F.lit(1.0), F.lit(3.0)), guarded_ratio(F.lit(1.0), F.lit(0.0)), guarded_ratio(F.lit(1.0), F.lit(None).cast("double")))
    assert list(got) == [0.3333, None, None]


def test_like_class_order(spark):
    rules = (("%JOBS_SERVERLESS%", "serverless"), ("%JOBS%", "job"))
    got = one(spark, *[like_class(F.lit(t), rules) for t in ("X_JOBS_SERVERLESS_Y", "X_JOBS_Y", "OTHER")])
    assert list(got) == ["serverless", "job", "OTHER"]


def test_minutes_and_version(spark):
    a, b = (F.lit(t).cast("timestamp") for t in ("2024-01-01 00:00:00.9", "2024-01-01 01:30:30.1"))
    got = one(spark, minutes_between(a, b), version_text("h0", b), minutes_between(a.cast("timestamp_ntz"), b.cast("timestamp_ntz"), True))
    assert got[0] == got[2] == 90.5 and got[1] == "h0_20240101_0130"


def test_wall_clock_minutes_ignore_the_zone(spark):
    """A day without a zone has 24 hours even where the session's zone changes its clock."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        a, b = (F.lit(t).cast("timestamp_ntz") for t in ("2024-03-10 00:00:00", "2024-03-11 00:00:00"))
        got = one(spark, minutes_between(a, b, True), minutes_between(a.cast("timestamp"), b.cast("timestamp")))
        assert list(got) == [1440.0, 1380.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("length,width", [(2, 7), (24, 7), (24, 4), (5, 1)])
def test_channels_match_numpy(spark, length, width):
    x = np.random.default_rng(length * width).normal(size=length)
    w = F.array(*[F.lit(float(v)) for v in x])
    got = one(spark, central_difference(w), rolling_spread(w, width))
    assert np.allclose(got[0], np.gradient(x))
    pad = np.pad(x, width // 2, mode="edge")
    want = [pad[i : i + width].std() for i in range(length)]
    assert np.allclose(got[1], want, atol=1e-7)
    batch = feature_matrix(x[None, :], None, None, ("value", "derivative", "spread", "level", "level_delta"), width)[0]
    assert np.allclose(batch, np.concatenate([x, got[0], got[1], np.zeros(2 * length)]), atol=1e-7)


def test_pad_to(spark):
    assert one(spark, pad_to(F.array(F.lit(1.0), F.lit(2.0)), 4))[0] == [1.0, 2.0, 2.0, 2.0]
    assert one(spark, pad_to(F.array(F.lit(1.0), F.lit(2.0)), 2))[0] == [1.0, 2.0]


def test_draws_look_random(spark):
    df = spark.range(20000).select(uniform(F.col("id"), 1).alias("u"), uniform(F.col("id"), 2).alias("v"), gaussian(F.lit(5).cast("bigint"), (F.col("id") * 2).cast("int")).alias("g"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.corr("u", "v"), F.avg("g"), F.stddev("g")).head()
    assert abs(r[0] - 0.5) < 0.02 and r[1] > 0 and r[2] < 1 and abs(r[3]) < 0.05
    assert abs(r[4]) < 0.05 and abs(r[5] - 1) < 0.05


def test_upper_tail(spark):
    for z in (0.0, 0.5, 1.96, 4.0):
        assert abs(one(spark, upper_tail(F.lit(z)))[0] - 0.5 * math.erfc(z / math.sqrt(2))) < 1e-6
