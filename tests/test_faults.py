"""Inputs that once stopped a job or gave doubled rows."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from structpeak.config import PeakConfig
from structpeak.functions.scalars import relative_error
from structpeak.operators.joins import interval_left_join
from structpeak.operators.registry import registry_months
from structpeak.operators.statistics import intraclass_correlation
from structpeak.plans.training import refit_on_labels, train, training_windows
from synthetic import series


def test_zero_label_is_an_infinite_relative_error(spark):
    df = spark.createDataFrame([(3.0, 0.0), (0.0, 0.0), (3.0, 2.0), (3.0, None)], "p double, a double")
    got = [r[0] for r in df.select(relative_error(F.col("p"), F.col("a"))).collect()]
    assert got == [math.inf, math.inf, 0.5, None]


def test_one_row_a_month_after_trimming(spark):
    raw = spark.createDataFrame([("n", "c1", 2020, 1, 202001, 5.0), ("n", "c1 ", 2020, 1, 202001, 7.0), ("n", "c1", 2020, 2, 202002, 6.0)], "region string, entity string, year int, month int, period int, level double")
    rows = registry_months(raw).collect()
    assert sorted((r["month"], r["level"]) for r in rows) == [(1, 7.0), (2, 6.0)]


@pytest.mark.parametrize("small", [True, False])
def test_far_interval_ends(spark, small):
    left = spark.createDataFrame([("a", dt.datetime(2024, 1, 5)), ("b", dt.datetime(2024, 3, 1))], "k string, at timestamp")
    right = spark.createDataFrame([("a", dt.datetime(1900, 1, 1), dt.datetime(9999, 12, 31), 4.0), ("b", dt.datetime(2030, 1, 1), None, 9.0)], "k string, f timestamp, t timestamp, price double")
    got = {r["k"]: r["price"] for r in interval_left_join(left, right, ["k"], "at", "f", "t", small=small).collect()}
    assert got == {"a": 4.0, "b": None}


def test_single_opinions_have_no_correlation(spark):
    one = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    assert intraclass_correlation(one, ["k"], "v").collect()[0]["icc"] is None


def test_labels_of_the_models_measure_only(spark):
    base = series(spark, ["a"])
    config = PeakConfig(measure="MVA", channels=("value",), latent=4, replicas=1, reweight_rounds=0)
    assert training_windows(base, config).count() == 365
    model = train(base, config)
    keys = base.select("region", "entity", "year").distinct()
    label = keys.select("*", F.lit("MVA").alias("measure"), F.lit(15.0).alias("label")).union(keys.select("*", F.lit("IMAX"), F.lit(900.0)))
    assert refit_on_labels(base, label, model, grid=(math.inf, 1.0)).kappa in (math.inf, 1.0)
    with pytest.raises(PySparkException):
        refit_on_labels(base, label.drop("measure"), model, grid=(math.inf, 1.0))


def test_workers_get_the_package(tmp_path):
    """A driver in another folder, with the package on its own path only, runs Python stages once the source is shipped."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    program = f"""
import sys
sys.path.insert(0, {str(root)!r})
from structpeak.session import local_session, ship_package
spark = local_session(2, "elsewhere")
from structpeak.operators import mixed

def run(batches):
    from structpeak.functions import arrays  # imported by the worker
    yield from batches

if sys.argv[1] == "ship":
    ship_package(spark)
    ship_package(spark)
print("rows", spark.range(5).mapInArrow(run, "id long").count())
"""
    (tmp_path / "program.py").write_text(program)
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = {
        how: subprocess.run([sys.executable, "program.py", how], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=180)
        for how in ("ship", "bare")
    }
    assert "rows 5" in got["ship"].stdout, got["ship"].stderr[-2000:]
    assert "rows 5" not in got["bare"].stdout and "ModuleNotFoundError" in got["bare"].stderr
