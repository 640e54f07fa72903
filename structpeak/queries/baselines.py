"""Peak baselines without a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from structpeak.operators.baselines import (
    daily_medians, hampel_filter, hampel_maximum, level_segments, normal_segment_maximum, raw_maximum, raw_quantiles, segment_features,
    sustained_maximum, vote_segments,
)
from structpeak.operators.changes import change_points, learn_rules
from structpeak.operators.hotkeys import FEW, MANY
from structpeak.operators.ordering import exact_quantiles, radix_quantiles
from structpeak.operators.refit import soft_peak
from structpeak.plans.scoring import raw_window_peaks
from structpeak.session import durable
from structpeak.queries.base import KEY, LENGTH, TIE, months, query, readings, rounded, sql


_HAMPEL = """
    SELECT region, entity, year, round(max(CASE WHEN abs(value - mid) > 3.0 * 1.4826 * list_median(list_transform(near, lambda x: abs(x - mid)))
                                     THEN mid ELSE value END), 6) AS hampel_max
    FROM (SELECT *, list_median(near) AS mid FROM
           (SELECT *, list_filter(list(value) OVER (PARTITION BY region, entity, year ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),
                                  lambda x: x IS NOT NULL) AS near FROM indexed))
    GROUP BY region, entity, year"""


@query("raw_maximum", sql(("readings",), "SELECT region, entity, year, max(value) AS raw_max FROM readings GROUP BY region, entity, year"))
def raw_maximum_query(spark, sf):
    return raw_maximum(readings(spark, sf), KEY)


@query("raw_quantiles", sql(("readings",), """
    SELECT region, entity, year, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.995), 6) AS p995,
           round(quantile_cont(value, 0.999), 6) AS p999 FROM readings GROUP BY region, entity, year"""))
def raw_quantiles_query(spark, sf):
    qs = {"p99": 0.99, "p995": 0.995, "p999": 0.999}
    return rounded(raw_quantiles(readings(spark, sf), qs, KEY), 6, *qs)


@query("raw_quantiles_spread", sql(("readings",), """
    SELECT region, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.999), 6) AS p999 FROM readings GROUP BY region"""))
def raw_quantiles_spread(spark, sf):
    """Few large groups by radix selection: counts of leading bits, refined twice."""
    return rounded(radix_quantiles(readings(spark, sf), ["region"], "value", {"p50": 0.5, "p999": 0.999}, FEW), 6, "p50", "p999")


@query("bucketed_quantiles", sql(("readings",), """
    SELECT region, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.999), 6) AS p999 FROM readings GROUP BY region"""))
def bucketed_quantiles(spark, sf):
    """The same, their order statistics read off ordered buckets."""
    return rounded(exact_quantiles(readings(spark, sf), ["region"], "value", {"p50": 0.5, "p999": 0.999}, FEW), 6, "p50", "p999")


@query("hampel_maximum_spread", sql(("indexed",), _HAMPEL))
def hampel_maximum_spread(spark, sf):
    """The filter on position chunks of forty readings with repeated borders."""
    cleaned = hampel_filter(readings(spark, sf), 3, 3.0, KEY, TIE, MANY, chunk=40)
    return rounded(cleaned.groupBy(*KEY).agg(F.max("cleaned").alias("hampel_max")), 6, "hampel_max")


@query("soft_peak", sql(("readings",), """
    SELECT r.region, r.entity, r.year, round(sum(exp((value - top) / 500.0) * value) / sum(exp((value - top) / 500.0)), 4) AS soft_peak
    FROM readings r JOIN (SELECT region, entity, year, max(value) AS top FROM readings GROUP BY region, entity, year) t
      ON r.region = t.region AND r.entity = t.entity AND r.year = t.year GROUP BY r.region, r.entity, r.year"""))
def soft_peak_query(spark, sf):
    return rounded(soft_peak(readings(spark, sf), KEY, "value", 500.0), 4, "soft_peak")


@query("hampel_maximum", sql(("indexed",), _HAMPEL))
def hampel_maximum_query(spark, sf):
    return rounded(hampel_maximum(readings(spark, sf), 3, 3.0, KEY, TIE), 6, "hampel_max")


@query("sustained_maximum", sql(("filled",), """
    SELECT region, entity, year, round(max(CASE WHEN pos >= 4 THEN held END), 6) AS sustained_max
    FROM (SELECT *, min(filled) OVER (PARTITION BY region, entity, year ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS held FROM filled)
    GROUP BY region, entity, year"""))
def sustained_maximum_query(spark, sf):
    """Largest level held over four consecutive readings."""
    return rounded(sustained_maximum(readings(spark, sf), 4, KEY, TIE), 6, "sustained_max")


_DAYS = """SELECT region, entity, year, CAST(ts AS DATE) AS day, max(value) AS day_max, quantile_cont(value, 0.5) AS day_median
           FROM readings GROUP BY 1, 2, 3, 4 HAVING count(value) > 0"""
_SHIFTED = """
    SELECT d.*, quantile_cont(day_median, 0.5) OVER (PARTITION BY d.region, d.entity, d.year ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS lft,
           quantile_cont(day_median, 0.5) OVER (PARTITION BY d.region, d.entity, d.year ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS rgt,
           s.rng
    FROM days d JOIN (SELECT region, entity, year, quantile_cont(day_median, 0.75) - quantile_cont(day_median, 0.25) AS rng FROM days GROUP BY 1, 2, 3) s
      ON d.region = s.region AND d.entity = s.entity AND d.year = s.year"""
_SEGMENTED = """
    SELECT *, sum(CASE WHEN over_limit AND NOT before_over THEN 1 ELSE 0 END) OVER (PARTITION BY region, entity, year ORDER BY day
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment
    FROM (SELECT *, coalesce(lag(over_limit) OVER (PARTITION BY region, entity, year ORDER BY day), FALSE) AS before_over
          FROM (SELECT *, coalesce(abs(rgt - lft) > 0.8 * rng, FALSE) AS over_limit FROM shifted))"""
_FEATURES = """
    SELECT *, date_diff('day', first_day, last_day) + 1 AS span_days, quarter(first_day) AS season,
           coalesce(abs(lead(segment_level) OVER w - lag(segment_level) OVER w) <= series_range, FALSE) AS returns
    FROM (SELECT s.region, s.entity, s.year, segment, quantile_cont(day_median, 0.5) AS segment_level, max(day_max) AS segment_max,
                 min(day) AS first_day, max(day) AS last_day, count(*) AS n_days, max(rng) AS series_range,
                 coalesce(max(abs(m.level_delta)), 0.0) AS network_change
          FROM segmented s LEFT JOIN months m ON s.region = m.region AND s.entity = m.entity AND year(s.day) = m.year AND month(s.day) = m.month
          GROUP BY 1, 2, 3, 4)
    WINDOW w AS (PARTITION BY region, entity, year ORDER BY segment)"""
_VOTED = """
    SELECT *, CASE WHEN returns AND span_days < 60 THEN 1 ELSE 0 END - CASE WHEN network_change > 4000 THEN 1 ELSE 0 END AS votes FROM features"""
_SEGMENT_CTES = {"days": _DAYS, "shifted": _SHIFTED, "segmented": _SEGMENTED, "features": _FEATURES, "voted": _VOTED}


def _features(spark, sf):
    segments = level_segments(daily_medians(readings(spark, sf), KEY), 7, 0.8, KEY)
    return segment_features(segments, KEY, months(spark, sf))


@query("level_segments", sql(("readings", "months"), """
    SELECT region, entity, year, CAST(segment AS BIGINT) AS segment, round(segment_level, 6) AS segment_level, segment_max, first_day, last_day,
           n_days, span_days, season, returns, round(network_change, 6) AS network_change FROM features""", **_SEGMENT_CTES))
def level_segments_query(spark, sf):
    df = _features(spark, sf).select(*KEY, F.col("segment").cast("bigint").alias("segment"), "segment_level", "segment_max", "first_day",
                                     "last_day", "n_days", "span_days", "season", "returns", "network_change")
    return rounded(df, 6, "segment_level", "network_change")


@query("segment_votes", sql(("readings", "months"), """
    SELECT region, entity, year, max(CASE WHEN votes <= 0 THEN segment_max END) AS segment_peak, count(*) AS n_segments,
           CAST(sum(CASE WHEN votes > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_excluded FROM voted GROUP BY region, entity, year""", **_SEGMENT_CTES))
def segment_votes(spark, sf):
    return normal_segment_maximum(vote_segments(_features(spark, sf), 60, 4000.0), KEY)


_SPREAD = "(squares[t + 2] - squares[s + 1]) - (sums[t + 2] - sums[s + 1]) * (sums[t + 2] - sums[s + 1]) / (t + 1 - s)"
_CUTS = {
    "days": _DAYS,
    "listed": """SELECT region, entity, year, list(day_median ORDER BY day) AS x, list(day ORDER BY day) AS d, count(*) AS n, 1.0 * var_pop(day_median) * ln(count(*)) AS charge
                 FROM days GROUP BY 1, 2, 3""",
    "summed": """SELECT *, list_transform(range(n + 1), lambda i: coalesce(list_sum(x[1:i]), 0.0)) AS sums,
                        list_transform(range(n + 1), lambda i: coalesce(list_sum(list_transform(x[1:i], lambda v: v * v)), 0.0)) AS squares FROM listed""",
    # one row a series and end: all starts are tried
    "fold": f"""SELECT region, entity, year, 0 AS t, [-charge] AS cost, []::BIGINT[] AS back, n, charge, sums, squares FROM summed
                UNION ALL
                SELECT region, entity, year, t + 1, list_append(cost, list_min(trials)), list_append(back, list_position(trials, list_min(trials)) - 1), n, charge, sums, squares
                FROM (SELECT *, list_transform(range(t + 1), lambda s: cost[s + 1] + {_SPREAD} + charge) AS trials FROM fold WHERE t < n)""",
    "traced": """SELECT region, entity, year, back, n AS hi, back[n] AS lo FROM fold WHERE t = n
                 UNION ALL SELECT region, entity, year, back, lo, back[lo] FROM traced WHERE lo > 0""",
}


@query("change_points", sql(("readings",), """
    SELECT region, entity, year, row_number() OVER (PARTITION BY region, entity, year ORDER BY lo) - 1 AS segment, d[lo + 1] AS first_day, d[hi] AS last_day,
           hi - lo AS n_days, round((sums[hi + 1] - sums[lo + 1]) / (hi - lo), 6) AS segment_level
    FROM traced JOIN summed USING (region, entity, year)""", **_CUTS).replace("WITH ", "WITH RECURSIVE ", 1))
def change_points_query(spark, sf):
    """Penalised change points of the daily medians of every series."""
    return rounded(change_points(daily_medians(readings(spark, sf), KEY), 1.0, KEY), 6, "segment_level")


_RULES = ("returns_soon", "is_short", "no_network_change")
_ROUNDS = 8


def _rounds_sql():
    """Rounds of expectation and maximisation, one pair of CTEs each."""
    clip = lambda e: f"least(greatest({e}, 1e-6), 1 - 1e-6)"
    ctes = {
        "rules": "SELECT *, returns AS returns_soon, span_days < 60 AS is_short, network_change <= 4000 AS no_network_change FROM features",
        "patterns": "SELECT returns_soon::INT AS v0, is_short::INT AS v1, no_network_change::INT AS v2, count(*)::DOUBLE AS n FROM rules GROUP BY 1, 2, 3",
        "q0": "SELECT *, (v0 + v1 + v2) / 3.0 AS q FROM patterns",
    }
    for k in range(1, _ROUNDS + 1):
        shares = ", ".join(f"{clip(f'sum(n * q * v{j}) / greatest(sum(n * q), 1e-6)')} AS a{j}, {clip(f'sum(n * (1 - q) * v{j}) / greatest(sum(n * (1 - q)), 1e-6)')} AS b{j}" for j in range(3))
        ctes[f"m{k}"] = f"SELECT {clip('sum(n * q) / sum(n)')} AS prior, {shares} FROM q{k - 1}"
        yes, no = (" * ".join(f"CASE WHEN v{j} = 1 THEN {c}{j} ELSE 1 - {c}{j} END" for j in range(3)) for c in "ab")
        ctes[f"q{k}"] = f"SELECT v0, v1, v2, n, prior * {yes} / (prior * {yes} + (1 - prior) * {no}) AS q FROM patterns, m{k}"
    return ctes


def _ruled(spark, sf):
    return _features(spark, sf).withColumns({
        "returns_soon": F.col("returns"), "is_short": F.col("span_days") < 60, "no_network_change": F.col("network_change") <= 4000.0})


@query("rule_weights", sql(("readings", "months"), f"""
    SELECT unnest({list(_RULES)}) AS rule, round(prior, 6) AS prior, round(unnest([a0, a1, a2]), 6) AS if_true, round(unnest([b0, b1, b2]), 6) AS if_false FROM m{_ROUNDS}""",
    **_SEGMENT_CTES, **_rounds_sql()))
def rule_weights(spark, sf):
    """How often each rule votes for a manoeuvre when it is one and when it isn't, learned without labels."""
    model = learn_rules(_ruled(spark, sf), _RULES, _ROUNDS)
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(model.prior).alias("prior"), F.lit(a).alias("if_true"), F.lit(b).alias("if_false"))
            for r, a, b in zip(model.votes, model.if_true, model.if_false, strict=True)]
    return rounded(spark.range(1).select(F.inline(F.array(*rows))), 6, "prior", "if_true", "if_false")


@query("segment_posteriors", sql(("readings", "months"), f"""
    SELECT region, entity, year, CAST(segment AS BIGINT) AS segment, round(q, 5) AS manoeuvre
    FROM rules JOIN q{_ROUNDS} ON returns_soon::INT = v0 AND is_short::INT = v1 AND no_network_change::INT = v2""", **_SEGMENT_CTES, **_rounds_sql()))
def segment_posteriors(spark, sf):
    """Probability that a segment is a manoeuvre, under the learned rule weights."""
    ruled = durable(_ruled(spark, sf).select(*KEY, "segment", *_RULES))  # learned from and then judged
    out = ruled.withColumn("manoeuvre", learn_rules(ruled, _RULES, _ROUNDS).probability())
    return rounded(out.select(*KEY, F.col("segment").cast("bigint").alias("segment"), "manoeuvre"), 5, "manoeuvre")


@query("raw_against_window_peak", sql(("readings", "points"), """
    SELECT r.region, r.entity, r.year, r.raw_max, round(p.peak, 6) AS peak, round(r.raw_max - p.peak, 6) AS gap
    FROM (SELECT region, entity, year, max(value) AS raw_max FROM readings GROUP BY 1, 2, 3) r
    JOIN (SELECT region, entity, year, quantile_cont(v, 0.999) AS peak FROM points GROUP BY 1, 2, 3) p
      ON r.region = p.region AND r.entity = p.entity AND r.year = p.year"""))
def raw_against_window_peak(spark, sf):
    """Raw maximum beside the window quantile of the same series."""
    base = readings(spark, sf)
    both = raw_maximum(base, KEY).join(raw_window_peaks(base, LENGTH, 0.999, TIE), list(KEY))
    return rounded(both.withColumn("gap", F.col("raw_max") - F.col("peak")), 6, "peak", "gap")
