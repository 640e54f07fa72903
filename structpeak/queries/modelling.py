"""Model application and fitting.

With fixed block-mean weights everything is checkable in SQL, the refit included. The fit is checked through its
sums and through the equations it solves; queries with fitted weights carry no SQL.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import functions as F

from structpeak.operators.boosting import Boosting, boosted_out_of_fold
from structpeak.operators.hotkeys import by_group_size
from structpeak.operators.model import (
    block_mean_denoiser, cross_products, fit_denoiser, fit_residual, limit_codes, reconstruct, solve_products, summed_products, training_examples, window_codes,
)
from structpeak.operators.contamination import COPIES, contaminated_copies, with_copies
from structpeak.operators.pooled import pooled_codes, regress_on_codes
from structpeak.operators.refit import kappa_losses, labelled_examples, refit
from structpeak.operators.series import series_windows
from structpeak.plans.scoring import annual_peaks
from structpeak.operators.registry import align_windows, registry_stats
from structpeak.plans.training import config_with_stats, refit_on_labels, train, training_windows
from structpeak.queries.base import CONFIG, KEY, LENGTH, MEASURE, TIE, labels, months, query, readings, results, rounded, sql
from structpeak.queries.labelling import _FOLDS
from structpeak.queries.series import _ALIGNED, _CHANNELS, _DIRTY, _DIRTY_LISTS, _windows

PLAIN = replace(CONFIG, channels=("value",))
FIXED = block_mean_denoiser(PLAIN, 6)
GRID = (float("inf"), 2.0, 1.0, 0.5)

_BLOCKS = """SELECT region, entity, year, window_id, i // 4 AS block, avg(z) AS code, any_value(median) AS median, any_value(scale) AS scale
             FROM zpoints GROUP BY region, entity, year, window_id, i // 4"""


@query("reconstructed_windows", sql(("zpoints",), """
    SELECT p.region, p.entity, p.year, p.window_id, p.i, round(p.z, 6) AS z, round(b.code, 6) AS structural
    FROM zpoints p JOIN blocks b ON p.region = b.region AND p.entity = b.entity AND p.year = b.year
      AND p.window_id = b.window_id AND p.i // 4 = b.block""", blocks=_BLOCKS))
def reconstructed_windows(spark, sf):
    """Batched matrix product on the workers, here with block-mean weights."""
    df = reconstruct(_windows(spark, sf), FIXED)
    out = df.select(*KEY, "window_id", F.posexplode_outer(F.arrays_zip(F.col("values").alias("z"), "structural")).alias("i", "p"))
    return rounded(out.select(*KEY, "window_id", "i", "p.z", "p.structural"), 6, "z", "structural")


@query("structural_peak_fixed_weights", sql(("zpoints",), """
    SELECT region, entity, year, round(quantile_cont(v, 0.999), 6) AS peak
    FROM (SELECT region, entity, year, unnest([x, x, x, x]) AS v FROM (SELECT *, code * scale + median AS x FROM blocks))
    GROUP BY region, entity, year""", blocks=_BLOCKS))
def structural_peak_fixed_weights(spark, sf):
    return rounded(annual_peaks(readings(spark, sf), FIXED, MEASURE, tie=TIE), 6, "peak")


def _labelled_windows(spark, sf):
    """Windows of labelled series only, with the label in scaled units."""
    known = labels(spark, sf).where(F.col("label").isNotNull()).select(*KEY, "label")
    base = readings(spark, sf).join(known.select(*KEY), list(KEY), "left_semi")
    windows = by_group_size(base, KEY, lambda p, spread: series_windows(p, LENGTH, tie=TIE, spread=spread))
    return labelled_examples(windows, known, KEY)


@query("labelled_examples", sql(("zlists", "labels"), """
    SELECT z.region, z.entity, z.year, z.window_id, round(zw[1], 6) AS first_z, round((l.label - z.median) / z.scale, 6) AS label_scaled
    FROM zlists z JOIN labels l ON z.region = l.region AND z.entity = l.entity AND z.year = l.year WHERE l.label IS NOT NULL"""))
def labelled_examples_query(spark, sf):
    out = _labelled_windows(spark, sf).select(*KEY, "window_id", F.col("values")[0].alias("first_z"), "label_scaled")
    return rounded(out, 6, "first_z", "label_scaled")


_LIMITED = "CASE WHEN kappa = 'inf'::DOUBLE THEN code ELSE least(greatest(code, -kappa), kappa) END"
_KAPPAS = "SELECT unnest(['inf'::DOUBLE, 2.0, 1.0, 0.5]) AS kappa"


_LOSSES = f"""
    SELECT p.kappa, pool_loss, label_loss, n_labelled, pool_loss + 8.0 * label_loss AS loss
    FROM (SELECT kappa, avg(l1) AS pool_loss FROM (
            SELECT kappa, d.region, d.entity, d.year, d.window_id, d.replica, avg(abs({_LIMITED} - d.z)) AS l1
            FROM dirty d JOIN dirty_blocks b ON d.region = b.region AND d.entity = b.entity AND d.year = b.year AND d.window_id = b.window_id
              AND d.replica = b.replica AND d.i // 4 = b.block, ({_KAPPAS}) GROUP BY ALL) GROUP BY kappa) p
    JOIN (SELECT kappa, avg(abs(soft - label_scaled)) AS label_loss, count(*) AS n_labelled FROM (
            SELECT kappa, region, entity, year, any_value(label_scaled) AS label_scaled,
                   sum(exp((x - top) / 0.05) * x) / sum(exp((x - top) / 0.05)) AS soft
            FROM (SELECT *, max(x) OVER (PARTITION BY kappa, region, entity, year) AS top FROM (
                    SELECT kappa, b.region, b.entity, b.year, {_LIMITED} AS x, (l.label - b.median) / b.scale AS label_scaled
                    FROM blocks b JOIN labels l ON b.region = l.region AND b.entity = l.entity AND b.year = l.year, ({_KAPPAS})
                    WHERE l.label IS NOT NULL)) GROUP BY kappa, region, entity, year) GROUP BY kappa) q ON p.kappa = q.kappa"""
_LOSS_CTES = {
    "blocks": _BLOCKS, **_DIRTY, "dirty_blocks": """
        SELECT region, entity, year, window_id, replica, i // 4 AS block, avg(x) AS code
        FROM dirty GROUP BY region, entity, year, window_id, replica, i // 4""", "losses": _LOSSES,
}


@query("code_limit_losses", sql(("zlists", "zpoints", "labels"), """
    SELECT kappa, round(pool_loss, 5) AS pool_loss, round(label_loss, 5) AS label_loss, n_labelled, round(loss, 4) AS loss FROM losses""", **_LOSS_CTES))
def code_limit_losses(spark, sf):
    """Pool and label loss of every candidate limit, all candidates in one pass."""
    pool = contaminated_copies(_windows(spark, sf), CONFIG, KEY)
    out = kappa_losses(_labelled_windows(spark, sf), pool, FIXED, GRID, 8.0, KEY, "contaminated")
    return rounded(rounded(out, 5, "pool_loss", "label_loss"), 4, "loss")


@query("refitted_fixed_weights_peak", sql(("zlists", "zpoints", "labels"), f"""
    SELECT region, entity, year, kappa, round(quantile_cont(v, 0.999), 6) AS peak
    FROM (SELECT region, entity, year, kappa, unnest([x, x, x, x]) AS v
          FROM (SELECT *, {_LIMITED} * scale + median AS x FROM blocks, (SELECT kappa FROM losses ORDER BY loss, kappa DESC LIMIT 1)))
    GROUP BY region, entity, year, kappa""", **_LOSS_CTES))
def refitted_fixed_weights_peak(spark, sf):
    """The limit chosen on the labels, then every series scored again under it."""
    pool = contaminated_copies(_windows(spark, sf), CONFIG, KEY)
    second = refit(_labelled_windows(spark, sf), pool, FIXED, GRID, "h1", keys=KEY, pool_input="contaminated")
    peaks = annual_peaks(readings(spark, sf), second, MEASURE, tie=TIE)
    return rounded(peaks.withColumn("kappa", F.lit(float(second.kappa))), 6, "peak")


@query("fit_cross_products", sql(("zlists", "zpoints"), """
    SELECT a.i AS row, b.i AS "column", round(sum(a.x * b.x), 3) AS total FROM wide a JOIN wide b USING (region, entity, year, window_id, replica) GROUP BY 1, 2
    UNION ALL
    SELECT a.i, 25 + d.i, round(sum(a.x * d.z), 3) FROM wide a JOIN dirty d USING (region, entity, year, window_id, replica) GROUP BY 1, 2
    UNION ALL
    SELECT i, 49, count(*) FROM wide GROUP BY 1""", **_DIRTY, wide="""
    SELECT region, entity, year, window_id, replica, i, x FROM dirty UNION ALL
    SELECT DISTINCT region, entity, year, window_id, replica, 24, 1.0 FROM dirty"""))
def fit_cross_products(spark, sf):
    """The sums that the fit solves: contaminated windows and the intercept against themselves, the clean windows and the weights."""
    found = cross_products(training_examples(_windows(spark, sf), PLAIN, KEY), PLAIN)
    return rounded(found.select("row", F.posexplode_outer("sums").alias("column", "total")), 3, "total")


@query("fit_optimality", """
    SELECT part, i AS row, 0.0 AS residual FROM (SELECT unnest(['plain', 'reweighted']) AS part), (SELECT unnest(range(25)) AS i)""")
def fit_optimality(spark, sf):
    """Largest residual of the penalised normal equations in every row, before and after a round of re-weighting: all zero at the optimum."""
    examples = training_examples(_windows(spark, sf), PLAIN, KEY)
    out, coefficients = None, None
    for part in ("plain", "reweighted"):
        sums = summed_products(examples, coefficients, PLAIN)
        coefficients = solve_products(sums, PLAIN.length, PLAIN.ridge)
        left = np.abs(fit_residual(sums, coefficients, PLAIN.length, PLAIN.ridge)).max(axis=1)
        rows = [F.struct(F.lit(part).alias("part"), F.lit(i).alias("row"), F.round(F.lit(float(r)), 6).alias("residual")) for i, r in enumerate(left)]
        found = spark.range(1).select(F.inline(F.array(*rows)))
        out = found if out is None else out.unionByName(found)
    return out


@query("limited_reconstruction", sql(("zpoints",), """
    SELECT region, entity, year, window_id, block, round(code, 6) AS code, round(least(greatest(code, -0.75), 0.75), 6) AS limited FROM blocks""", blocks=_BLOCKS))
def limited_reconstruction(spark, sf):
    """Codes before and after the limit."""
    coded = window_codes(_windows(spark, sf), FIXED).withColumn("limited", limit_codes(F.col("codes"), FIXED, 0.75))
    packed = F.arrays_zip(F.col("codes").alias("code"), "limited")
    out = coded.select(*KEY, "window_id", F.posexplode_outer(packed).alias("block", "p")).select(*KEY, "window_id", "block", "p.*")
    return rounded(out, 6, "code", "limited")


@query("fitted_structural_peak")
def fitted_structural_peak(spark, sf):
    """Fit on all windows, then score every series (value channel only)."""
    base = readings(spark, sf)
    return annual_peaks(base, train(base, PLAIN, tie=TIE, version="h0"), MEASURE, tie=TIE)


@query("fitted_multichannel_peak")
def fitted_multichannel_peak(spark, sf):
    """The same with five channels and the monthly registry."""
    base, found = readings(spark, sf), months(spark, sf)
    return annual_peaks(base, train(base, CONFIG, found, TIE, "h0"), MEASURE, found, TIE)


@query("refitted_peak_h1")
def refitted_peak_h1(spark, sf):
    """Refit of the code limit on labels, then all series scored again."""
    base = readings(spark, sf)
    first = train(base, PLAIN, tie=TIE, version="h0")
    known = labels(spark, sf).where(F.col("label").isNotNull()).select(*KEY, "label")
    second = refit_on_labels(base, known, first, tie=TIE, version="h1")
    return annual_peaks(base, second, MEASURE, tie=TIE).withColumn("kappa", F.lit(float(second.kappa)))


SHARES = {"value": 1.0, "derivative": 0.2, "spread": -0.1, "level": 0.05, "level_delta": 0.1}
_SEEN = "avg(c.z + 0.2 * c.derivative - 0.1 * c.spread {registry}) AS code"
_REGISTRY = "+ 0.05 * a.level + 0.1 * a.level_delta"
_POINT = "x.region, x.entity, x.year, x.window_id, x.i"
_CHANNEL_CTES = {"channels": _CHANNELS.format(base="zlists"), "aligned": _ALIGNED.format(base="zpoints", key=_POINT)}


@query("multichannel_peak_fixed_weights", sql(("zlists", "zpoints", "stats"), f"""
    SELECT region, entity, year, round(quantile_cont(v, 0.999), 6) AS peak FROM (
      SELECT region, entity, year, unnest([x, x, x, x]) AS v FROM (
        SELECT region, entity, year, code * any_value(scale) + any_value(median) AS x FROM (
          SELECT region, entity, year, window_id, c.i // 4 AS block, {_SEEN.format(registry=_REGISTRY)}
          FROM channels c JOIN aligned a USING (region, entity, year, window_id, i) GROUP BY ALL)
        JOIN zlists USING (region, entity, year, window_id) GROUP BY region, entity, year, window_id, block, code))
    GROUP BY region, entity, year""", **_CHANNEL_CTES))
def multichannel_peak_fixed_weights(spark, sf):
    """Five channels with the monthly registry under fixed weights."""
    found = months(spark, sf)
    model = block_mean_denoiser(config_with_stats(CONFIG, found), 6, shares=SHARES)
    return rounded(annual_peaks(readings(spark, sf), model, MEASURE, found, TIE), 6, "peak")


def _reconstruction_error(windows, model, name):
    """Mean absolute error of the contaminated copies' reconstruction against the clean windows."""
    seen = reconstruct(contaminated_copies(windows, model.config, KEY), model, "contaminated")
    gap = F.aggregate(F.zip_with("structural", "values", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, g: a + g) / LENGTH
    return seen.agg(F.avg(gap).alias("l1"), F.count("*").alias("n_windows")).select(F.lit(name).alias("variant"), "l1", "n_windows")


_DIRTY_CHANNELS = _CHANNELS.format(base="dirty_lists").replace("window_id, i,", "window_id, replica, i,", 1)
_ABLATED = f"""
    SELECT '{{name}}' AS variant, round(avg(abs(b.code - d.z)), 5) AS l1, CAST(count(*) / 24 AS BIGINT) AS n_windows
    FROM (SELECT region, entity, year, window_id, replica, c.i // 4 AS block, {_SEEN}
          FROM channels c JOIN aligned a USING (region, entity, year, window_id, i) GROUP BY ALL) b
    JOIN dirty d ON b.region = d.region AND b.entity = d.entity AND b.year = d.year AND b.window_id = d.window_id AND b.replica = d.replica AND d.i // 4 = b.block"""


@query("channel_ablation_fixed_weights", sql(
    ("zlists", "zpoints", "stats"), _ABLATED.format(name="with_registry", registry=_REGISTRY) + " UNION ALL " + _ABLATED.format(name="without_registry", registry=""),
    **_DIRTY, dirty_lists=_DIRTY_LISTS, channels=_DIRTY_CHANNELS, aligned=_ALIGNED.format(base="zpoints", key=_POINT)))
def channel_ablation_fixed_weights(spark, sf):
    """The same fixed weights with and without the registry channels, on the same contaminated windows."""
    found = months(spark, sf)
    config = config_with_stats(CONFIG, found)
    windows = align_windows(_windows(spark, sf), found, registry_stats(found))
    without = {k: v for k, v in SHARES.items() if k not in ("level", "level_delta")}
    rows = [_reconstruction_error(windows, block_mean_denoiser(config, 6, shares=s), n) for n, s in (("with_registry", SHARES), ("without_registry", without))]
    return rounded(rows[0].unionByName(rows[1]), 5, "l1")


@query("channel_ablation")
def channel_ablation(spark, sf):
    """Reconstruction error of fitted models with and without the registry channels, over all windows."""
    found = months(spark, sf)
    config = config_with_stats(CONFIG, found)
    # channels say what a model sees, not what the windows and their copies are: both fits and both errors read the same
    windows = with_copies(training_windows(readings(spark, sf), config, found, TIE), config, KEY)
    windows = windows.select(*KEY, "window_id", "values", "level", "level_delta", COPIES).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = []
        for name, channels in (("with_registry", CONFIG.channels), ("without_registry", CONFIG.channels[:3])):
            model = fit_denoiser(windows, replace(config, channels=channels), KEY, name)
            rows.append(_reconstruction_error(windows, model, name).head())
    finally:
        windows.unpersist()
    return spark.createDataFrame(rows, "variant string not null, l1 double, n_windows bigint not null")


@query("pooled_code_summaries", sql(("zpoints",), """
    SELECT region, entity, year, block AS component, round(avg(code), 6) AS mean, round(quantile_cont(code, 0.1), 6) AS q10,
           round(quantile_cont(code, 0.5), 6) AS q50, round(quantile_cont(code, 0.9), 6) AS q90
    FROM blocks GROUP BY region, entity, year, block""", blocks=_BLOCKS))
def pooled_code_summaries(spark, sf):
    pooled = by_group_size(
        readings(spark, sf), KEY,
        lambda p, spread: pooled_codes(series_windows(p, LENGTH, tie=TIE, spread=spread), FIXED, KEY, spread))
    steps = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda c: F.slice("summary", c * 4 + 1, F.lit(4)))
    out = pooled.select(*KEY, F.posexplode_outer(steps).alias("component", "s")).select(
        *KEY, "component", *[F.col("s")[i].alias(n) for i, n in enumerate(("mean", "q10", "q50", "q90"))])
    return rounded(out, 6, "mean", "q10", "q50", "q90")


@query("code_regression")
def code_regression(spark, sf):
    """Label predicted from pooled codes and the raw maximum by a shallow regressor."""
    pooled = by_group_size(
        readings(spark, sf), KEY,
        lambda p, spread: pooled_codes(series_windows(p, LENGTH, tie=TIE, spread=spread), FIXED, KEY, spread))
    return regress_on_codes(pooled, results(spark, sf), labels(spark, sf), "peak_h0", "label", KEY)


BOOSTING = Boosting(rounds=2, depth=2, bins=8, rate=0.5, smallest=3)
_N_FOLDS, _N_FEATURES = 5, 25
_UNSEEN = f"label IS NOT NULL AND coalesce(fold, {_N_FOLDS + 1}) <> model"


def _boosted_sql() -> tuple[str, dict[str, str]]:
    """Last state and the steps to it: histogram, split and descent of every level of every round."""
    steps = {
        "folds": _FOLDS, "blocks": _BLOCKS,
        "summaries": """
            SELECT region, entity, year, flatten(list([round(m, 6), round(a, 6), round(b, 6), round(c, 6)] ORDER BY block)) AS x FROM (
              SELECT region, entity, year, block, avg(code) AS m, quantile_cont(code, 0.1) AS a, quantile_cont(code, 0.5) AS b, quantile_cont(code, 0.9) AS c
              FROM blocks GROUP BY region, entity, year, block) GROUP BY region, entity, year""",
        "featured": """
            SELECT s.region, s.entity, s.year, list_append(x, CAST(peak_h0 AS DOUBLE)) AS x, label, fold
            FROM summaries s JOIN results r ON s.region = r.region AND s.entity = r.entity AND s.year = r.year
            LEFT JOIN labels l ON s.region = l.region AND s.entity = l.entity AND s.year = l.year
            LEFT JOIN folds f ON s.entity = f.entity AND label IS NOT NULL WHERE peak_h0 IS NOT NULL""",
        "featured_long": f"SELECT * EXCLUDE (x), unnest(x) AS v, unnest(range({_N_FEATURES})) AS feature FROM featured",
        "edges": f"""
            SELECT feature, quantile_cont(v, {[i / BOOSTING.bins for i in range(1, BOOSTING.bins)]}) AS e
            FROM featured_long WHERE label IS NOT NULL GROUP BY feature""",
        "cut": """
            SELECT region, entity, year, label, fold, list(len([t FOR t IN e IF t < v]) ORDER BY feature) AS b
            FROM featured_long JOIN edges USING (feature) GROUP BY region, entity, year, label, fold""",
        "state_0": f"""
            SELECT cut.*, model, 1 AS node, avg(CASE WHEN {_UNSEEN} THEN label END) OVER (PARTITION BY model) AS pred
            FROM cut, (SELECT unnest(range({_N_FOLDS + 1})) AS model)""",
    }
    state, smallest = "state_0", BOOSTING.smallest
    for step in range(BOOSTING.rounds * BOOSTING.depth):
        last = (step + 1) % BOOSTING.depth == 0
        steps[f"hist_{step}"] = f"""
            SELECT model, node, feature, bin, count(*) AS n, sum(rest) AS s, sum(rest * rest) AS q
            FROM (SELECT model, node, label - pred AS rest, unnest(b) AS bin, unnest(range({_N_FEATURES})) AS feature FROM {state} WHERE {_UNSEEN}) GROUP BY ALL"""
        steps[f"split_{step}"] = f"""
            SELECT model, node, feature, CASE WHEN share > 0 THEN bin ELSE {BOOSTING.bins} END AS edge,
                   CASE WHEN share > 0 THEN sl / nl ELSE s / n END AS on_left, CASE WHEN share > 0 THEN (s - sl) / (n - nl) ELSE s / n END AS on_right
            FROM (SELECT *, CASE WHEN nl >= {smallest} AND n - nl >= {smallest} AND q > 0
                                 THEN round((sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n) / q, 9) ELSE -1 END AS share
                  FROM (SELECT model, node, feature, bin, sum(n) OVER upto AS nl, sum(s) OVER upto AS sl, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q
                        FROM hist_{step} WINDOW w AS (PARTITION BY model, node, feature),
                          upto AS (PARTITION BY model, node, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
            QUALIFY row_number() OVER (PARTITION BY model, node ORDER BY share DESC, feature, bin) = 1"""
        right = "b[feature + 1] > edge"
        steps[f"state_{step + 1}"] = f"""
            SELECT a.* EXCLUDE (node, pred), {"1" if last else f"node * 2 + CASE WHEN {right} THEN 1 ELSE 0 END"} AS node,
                   {f"pred + {BOOSTING.rate} * CASE WHEN {right} THEN on_right ELSE on_left END" if last else "pred"} AS pred
            FROM {state} a JOIN split_{step} USING (model, node)"""
        state = f"state_{step + 1}"
    return f"""
        SELECT region, entity, year, fold, round(pred, 4) AS predicted FROM {state} WHERE model = coalesce(fold, {_N_FOLDS})""", steps


_LAST, _STEPS = _boosted_sql()


@query("boosted_code_regression", sql(("zpoints", "pairs"), _LAST, **_STEPS))
def boosted_code_regression(spark, sf):
    """Label predicted from pooled codes and the raw maximum by boosted trees that never saw the entity."""
    pooled = by_group_size(
        readings(spark, sf), KEY,
        lambda p, spread: pooled_codes(series_windows(p, LENGTH, tie=TIE, spread=spread), FIXED, KEY, spread))
    start = results(spark, sf).where(F.col("peak_h0").isNotNull()).select(*KEY, "peak_h0")
    known = labels(spark, sf).where(F.col("label").isNotNull()).select(*KEY, "label")
    x = F.concat(F.transform("summary", lambda v: F.round(v, 6)), F.array(F.col("peak_h0").cast("double")))
    rows = pooled.join(start, list(KEY)).join(known, list(KEY), "left").select(*KEY, "label", x.alias("x"))
    out = boosted_out_of_fold(rows, "x", "label", _N_FOLDS, 42, BOOSTING)
    return rounded(out.select(*KEY, "fold", "predicted"), 4, "predicted")
