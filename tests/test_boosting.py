"""Boosted trees against a plain implementation, and the promises about labels and odd rows."""

import numpy as np
import pytest

from structpeak.operators.boosting import Boosting, boosted_out_of_fold

CONFIG = Boosting(rounds=2, depth=2, bins=6, rate=0.4, smallest=2)
SCHEMA = "entity string, year int, x array<double>, label double"


def _rows(n=90, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    y = np.where(x[:, 0] > 0.3, 5.0, -1.0) + 2 * x[:, 2] + rng.normal(size=n) * 0.1
    return [(f"e{i // 2}", i % 2, x[i].tolist(), float(y[i]) if i % 5 else None) for i in range(n)]


def _grow(bins, rest, config, depth):
    """Function from bins to value, fitted by trying every split."""
    mean = rest.mean()
    best = (0.0, None, None)
    squares = (rest**2).sum()
    for f in range(bins.shape[1]):
        for b in sorted(set(bins[:, f].tolist())):
            left = bins[:, f] <= b
            if min(left.sum(), (~left).sum()) < config.smallest or squares <= 0:
                continue
            gain = rest[left].sum() ** 2 / left.sum() + rest[~left].sum() ** 2 / (~left).sum() - rest.sum() ** 2 / len(rest)
            if round(gain / squares, 9) > best[0]:
                best = (round(gain / squares, 9), f, b)
    if best[1] is None or depth == 0:
        return lambda z: mean
    _, f, b = best
    left = bins[:, f] <= b
    one, two = _grow(bins[left], rest[left], config, depth - 1), _grow(bins[~left], rest[~left], config, depth - 1)
    return lambda z: one(z) if z[f] <= b else two(z)


def _expected(rows, folds, config):
    x = np.array([r[2] for r in rows])
    known = np.array([r[3] is not None for r in rows])
    y = np.array([r[3] if r[3] is not None else np.nan for r in rows])
    edges = [np.quantile(x[known, f], np.arange(1, config.bins) / config.bins) for f in range(x.shape[1])]
    bins = np.stack([(edges[f][None, :] < x[:, f][:, None]).sum(axis=1) for f in range(x.shape[1])], axis=1)
    out = np.zeros(len(rows))
    for fold in {*folds}:
        mine = np.array([f == fold for f in folds])
        learn = known & ~mine if fold is not None else known
        pred = np.full(len(rows), y[learn].mean())
        for _ in range(config.rounds):
            tree = _grow(bins[learn], (y - pred)[learn], config, config.depth)
            pred = pred + config.rate * np.array([tree(z) for z in bins])
        out[mine] = pred[mine]
    return out


def _run(spark, rows, config=CONFIG, folds=3):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r["entity"], r["year"]): (r["fold"], r["predicted"]) for r in boosted_out_of_fold(df, "x", "label", folds, 7, config).collect()}


def test_equals_plain_trees(spark):
    rows = _rows()
    got = _run(spark, rows)
    assert len(got) == len(rows)
    folds = [got[r[:2]][0] for r in rows]
    assert [f is None for f in folds] == [r[3] is None for r in rows] and {0, 1, 2} <= set(folds)
    assert all(len({f for r, f in zip(rows, folds) if r[0] == e and f is not None}) <= 1 for e in {r[0] for r in rows})
    assert np.allclose([got[r[:2]][1] for r in rows], _expected(rows, folds, CONFIG), atol=1e-9)


def test_own_entity_is_never_learned_from(spark):
    rows = _rows(60)
    changed = [(*r[:3], r[3] + 1000.0 if r[0] == "e3" and r[3] is not None else r[3]) for r in rows]
    one, two = _run(spark, rows), _run(spark, changed)
    assert all(one[k] == two[k] for k in one if k[0] == "e3" and one[k][0] is not None)
    assert any(one[k] != two[k] for k in one if k[0] != "e3")


def test_better_than_the_mean(spark):
    rows = _rows(200, 8)
    got = _run(spark, rows, Boosting(rounds=3, depth=2, bins=8, rate=0.7, smallest=3), 3)
    y = np.array([r[3] for r in rows if r[3] is not None])
    p = np.array([got[r[:2]][1] for r in rows if r[3] is not None])
    assert np.abs(p - y).mean() < 0.5 * np.abs(y - y.mean()).mean()


def test_odd_rows(spark):
    nan = float("nan")
    rows = [*_rows(40), ("n", 1, None, 3.0), ("m", 1, [None, nan, 0.0, 0.0], None), (None, 1, [0.0] * 4, 2.0), ("p", 1, [0.0] * 4, nan)]
    got = _run(spark, rows)
    assert got["n", 1][0] is None and got["p", 1][0] is None and got[None, 1][0] is not None
    assert all(p is not None and np.isfinite(p) for _, p in got.values())
    same = [("a", 1, [1.0], 2.0)] * 3 + [("b", 1, [1.0], 2.0)] * 2
    df = boosted_out_of_fold(spark.createDataFrame(same, SCHEMA), "x", "label", 2, 7, CONFIG)
    assert [r["predicted"] for r in df.collect()] == [2.0] * 5


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([("a", 1, [1.0], None)], SCHEMA)
    assert [r["predicted"] for r in boosted_out_of_fold(none, "x", "label", 2, 7, CONFIG).collect()] == [None]
    assert boosted_out_of_fold(none.limit(0), "x", "label", 2, 7, CONFIG).count() == 0
    with pytest.raises(ValueError):
        boosted_out_of_fold(none.withColumnRenamed("year", "fold"), "x", "label", 2, 7, CONFIG)
    with pytest.raises(ValueError):
        Boosting(bins=1)
