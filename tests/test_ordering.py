import numpy as np
import pytest
from pyspark.sql import functions as F

from structpeak.functions.draws import order_digest
from structpeak.operators.hotkeys import FEW, MANY
from structpeak.operators.ordering import cumulative_histogram, digest_rank, exact_quantiles, near_equal_part


@pytest.mark.parametrize("n,k", [(12, 5), (3, 5), (5000, 7), (10, 10)])
def test_digest_rank_and_parts(spark, n, k):
    df = spark.range(n).withColumn("digest", order_digest(1, F.col("id")))
    ranked = digest_rank(df, "digest")
    got = ranked.withColumn("part", near_equal_part(F.col("position"), F.col("total"), k)).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, n + 1))
    assert [r["digest"] for r in got] == sorted(r["digest"] for r in got)
    sizes = np.bincount([r["part"] for r in got], minlength=k)
    assert list(sizes) == [len(p) for p in np.array_split(np.arange(n), k)]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and one value most rows of another group."""
    rng = np.random.default_rng(3)
    groups = {"big": rng.lognormal(0, 3, 4000), "ties": np.r_[np.full(900, 2.0), rng.normal(size=50)], "tiny": np.array([1.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None)] * 3 + [("big", None)] * 5
    return groups, spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize("levels,cuts", [(1, 4), (2, 4), (2, 64)])
def test_cumulative_histogram(skewed, levels, cuts):
    groups, df = skewed
    got = cumulative_histogram(df, ["g"], "v", levels, cuts).collect()
    for g, vs in groups.items():
        values, counts = np.unique(vs, return_counts=True)
        mine = sorted((r["v"], r["rows"], r["below"], r["total"]) for r in got if r["g"] == g)
        assert mine == [(v, c, b, len(vs)) for v, c, b in zip(values, counts, np.cumsum(counts) - counts)]


@pytest.mark.parametrize("spread", [False, FEW, MANY])
def test_exact_quantiles(skewed, spread):
    groups, df = skewed
    qs = {"lo": 0.0, "a": 0.25, "m": 0.5, "h": 0.999, "hi": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", qs, spread).collect()}
    for g, vs in groups.items():
        assert np.allclose([got[g][n] for n in qs], np.quantile(vs, list(qs.values())), rtol=1e-12)
    assert got["none"]["m"] is None
    whole = exact_quantiles(df, [], "v", qs, spread).head()
    assert np.allclose([whole[n] for n in qs], np.quantile(np.concatenate(list(groups.values())), list(qs.values())), rtol=1e-12)
