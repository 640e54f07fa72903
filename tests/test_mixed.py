"""Mixed models against dense covariance matrices, and the promises about odd rows."""

import numpy as np
import pytest

from structpeak.operators.mixed import RATIOS, cluster_moments, effect_rows, mixed_model, mixed_profile

REPETITIONS = [1, 2, 3, 4]


def _rows(seed=5, spread=2.0, shift=1.0):
    rng = np.random.default_rng(seed)
    out = []
    effect = rng.normal(size=4) * shift
    for e in range(40):
        own = rng.normal() * spread
        for k in range(int(rng.integers(1, 7))):
            x, repetition = float(rng.normal()), 1 + (e + k) % 4
            out.append((f"e{e}", repetition, 1.0, x, float(3 + 2 * x + own + effect[repetition - 1] + rng.normal())))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "entity string, repetition int, one double, x double, y double")


def _dense(rows, ratio, penalty):
    """Estimates, their errors and the restricted deviance from the whole covariance matrix."""
    entity, repetition = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x, y = np.array([r[2:4] for r in rows]), np.array([r[4] for r in rows])
    v = np.eye(len(rows)) + ratio * (entity[:, None] == entity) + penalty * (repetition[:, None] == repetition)
    solved = np.linalg.solve(v, np.column_stack((x, y)))
    xx, xy = x.T @ solved[:, :2], x.T @ solved[:, 2]
    b = np.linalg.solve(xx, xy)
    residual = (y @ solved[:, 2] - xy @ b) / (len(rows) - 2)
    deviance = (len(rows) - 2) * np.log(residual) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1]
    return b, np.sqrt(residual * np.diag(np.linalg.inv(xx))), residual, deviance


def test_fit_equals_dense_likelihood(spark):
    rows = _rows()
    fit = mixed_model(_frame(spark, rows), "y", ["one", "x"], "entity", "repetition", REPETITIONS)
    penalty = fit.repetition / fit.residual
    b, errors, residual, deviance = _dense(rows, fit.ratio, penalty)
    assert np.allclose(fit.estimates, b) and np.allclose(fit.errors, errors) and np.isclose(fit.residual, residual)
    assert np.isclose(fit.deviance, deviance) and np.isclose(fit.entity, fit.ratio * residual)
    others = [_dense(rows, fit.ratio * f, penalty * g)[3] for f in (0.2, 0.8, 0.97, 1, 1.03, 1.25, 5) for g in (0.2, 0.8, 0.97, 1, 1.03, 1.25, 5)]
    others += [_dense(rows, r, q)[3] for r in RATIOS for q in RATIOS]
    assert deviance <= min(others) + 1e-4
    assert abs(fit.estimates[1] - 2) < 4 * fit.errors[1] and 1 < np.sqrt(fit.entity) < 3


def test_profile_equals_dense_likelihood(spark):
    rows = _rows(seed=6)
    for fit in mixed_profile(_frame(spark, rows), "y", ["one", "x"], "entity", [0.0, 0.3, 4.0]):
        b, errors, residual, deviance = _dense(rows, fit.ratio, 0.0)
        assert np.allclose(fit.estimates, b) and np.allclose(fit.errors, errors) and np.isclose(fit.deviance, deviance)


def test_errors_of_dependent_rows_are_wider(spark):
    """Copies of rows add no knowledge: an intercept is as sure as its entities are many."""
    rng = np.random.default_rng(1)
    own = rng.normal(size=30)
    rows = [(f"e{e}", 1, 1.0, 0.0, float(own[e] + 0.01 * rng.normal())) for e in range(30) for _ in range(20)]
    fit = mixed_model(_frame(spark, rows), "y", ["one"], "entity")
    assert np.isclose(fit.errors[0], own.std(ddof=1) / np.sqrt(30), rtol=0.02)
    plain = mixed_profile(_frame(spark, rows), "y", ["one"], "entity", [0.0])[0]
    assert plain.errors[0] < fit.errors[0] / 4


def test_odd_rows(spark):
    rows = _rows(seed=7)
    want = mixed_model(_frame(spark, rows), "y", ["one", "x"], "entity", "repetition", REPETITIONS)
    odd = [("e1", 1, 1.0, None, 5.0), ("e2", 2, 1.0, 1.0, None), ("e99", 3, 1.0, float("nan"), 1.0)]
    table = _frame(spark, rows + odd)
    got = mixed_model(table, "y", ["one", "x"], "entity", "repetition", REPETITIONS)
    assert got.rows == len(rows) and np.allclose(got.estimates, want.estimates)
    never = mixed_model(table.selectExpr("*", "0.0D AS never"), "y", ["one", "never", "x"], "entity", "repetition", REPETITIONS)
    assert np.isnan(never.estimates[1]) and np.allclose(never.estimates[[0, 2]], want.estimates)
    assert effect_rows(never)[1] == ("never", None, None, None, None)
    for frame, design in ((table.limit(0), ["one"]), (table.selectExpr("*", "2 * x AS twice"), ["one", "x", "twice"])):
        with pytest.raises(ValueError):
            mixed_model(frame, "y", design, "entity")


def test_one_row_for_each_size(spark):
    rows = _rows()
    table = cluster_moments(_frame(spark, rows), ["one", "x", "y"], "entity").collect()
    sizes = [sum(r[0] == e for r in rows) for e in {r[0] for r in rows}]
    assert sorted((r["size"], r["entities"]) for r in table) == sorted((n, sizes.count(n)) for n in set(sizes))
