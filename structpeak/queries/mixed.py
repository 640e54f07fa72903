"""Mixed-effects models of the errors behind the learning curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from structpeak.operators.mixed import effect_rows, mixed_model, mixed_profile
from structpeak.operators.sampling import split_frozen
from structpeak.operators.statistics import learning_errors
from structpeak.queries.base import pairs, query, rounded, sql, suppliers
from structpeak.queries.evaluation import GRID
from structpeak.queries.testing import _RUN_CTES, _RUNS

REPETITIONS = 5
RATIOS = (0.0, 0.01, 0.1, 0.5, 1.0, 4.0, 20.0)
_ERRORS = _RUNS.replace(
    "SELECT r.repetition, r.level, avg(abs(a * t.peak_h0 + b - t.label)) AS mae, count(*) AS n_test",
    "SELECT r.repetition, t.region, t.entity, ln(r.level) AS x, abs(a * t.peak_h0 + b - t.label) AS y",
).replace("GROUP BY r.repetition, r.level", "")


def _errors(spark, sf):
    """Errors of every test row, level and repetition, with the columns of a design."""
    keys = ["region", "entity", "year"]
    pool, test = split_frozen(pairs(spark, sf).select(*keys, "peak_h0", "label"), [], 0.4, 11)
    errors = learning_errors(pool, test, "peak_h0", "label", GRID, REPETITIONS, 13, keys)
    return errors.withColumns({"one": F.lit(1.0), "log_level": F.log("level")})


@query("mixed_error_profile", sql(("pairs",), f"""
    SELECT ratio, n AS n_rows, round(b0, 3) AS intercept, round(b1, 3) AS slope, round(sqrt(s2), 3) AS residual_sd, round(sqrt(ratio * s2), 3) AS entity_sd,
           round((n - 2) * ln(s2) + d + ln(det), 4) AS deviance
    FROM (SELECT *, (yy - b0 * oy - b1 * xy) / (n - 2) AS s2 FROM (
      SELECT *, (oy * xx - xy * ox) / det AS b0, (oo * xy - ox * oy) / det AS b1 FROM (SELECT *, oo * xx - ox * ox AS det FROM weighted)))""",
    **_RUN_CTES, errors=_ERRORS,
    per="SELECT entity, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS qxx, sum(x * y) AS qxy, sum(y * y) AS qyy FROM errors GROUP BY entity",
    weighted=f"""SELECT ratio, CAST(sum(n) AS BIGINT) AS n, sum(ln(1 + ratio * n)) AS d, sum(n - w * n * n) AS oo, sum(sx - w * n * sx) AS ox, sum(qxx - w * sx * sx) AS xx,
                        sum(sy - w * n * sy) AS oy, sum(qxy - w * sx * sy) AS xy, sum(qyy - w * sy * sy) AS yy
                 FROM (SELECT *, ratio / (1 + ratio * n) AS w FROM per, (SELECT unnest([{", ".join(f"{r!r}::DOUBLE" for r in RATIOS)}]) AS ratio)) GROUP BY ratio"""))
def mixed_error_profile(spark, sf):
    """Errors against the logarithm of the label-set size, at set ratios of the entity variance."""
    fits = mixed_profile(_errors(spark, sf), "miss", ["one", "log_level"], "entity", RATIOS)
    rows = [(f.ratio, f.rows, *f.estimates.tolist(), f.residual**0.5, f.entity**0.5, f.deviance) for f in fits]
    out = spark.createDataFrame(rows, "ratio double, n_rows long, intercept double, slope double, residual_sd double, entity_sd double, deviance double")
    return rounded(rounded(out, 4, "deviance"), 3, "intercept", "slope", "residual_sd", "entity_sd")


@query("mixed_error_model")
def mixed_error_model(spark, sf):
    """Errors on the label-set size and the region, with random intercepts of entities and repetitions."""
    regions = sorted(r[0] for r in suppliers(spark, sf).select("region").distinct().collect())  # one row a region
    errors = _errors(spark, sf).withColumns({f"region {r}": (F.col("region") == r).cast("double") for r in regions})
    # every region has its own level, so there is no column of ones
    fit = mixed_model(errors, "miss", ["log_level", *[f"region {r}" for r in regions]], "entity", "repetition", range(1, REPETITIONS + 1))
    return spark.createDataFrame(effect_rows(fit), "term string, estimate double, std_error double, lower double, upper double")
