"""Statistical comparisons: intervals, rank tests, equivalence, agreement, learning curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from structpeak.functions.scalars import relative_error
from structpeak.operators.ordering import cumulative_histogram
from structpeak.operators.sampling import split_frozen
from structpeak.operators.statistics import (
    POISSON_1, QUANTILE_A, QUANTILE_B, QUANTILE_C, QUANTILE_D, accelerated_interval, adjacent_differences, average_ranks, cliffs_delta, cluster_bootstrap, equivalence,
    exact_signed_rank, fit_learning_curve, holm, intraclass_correlation, learning_runs, pair_deviation, signed_rank, smallest_equivalent, success_test,
)
from structpeak.queries.base import pairs, query, readings, rounded, seed_sql, sql, table, uniform_sql
from structpeak.queries.evaluation import _CHAIN, _LEVEL, GRID, _oof
from structpeak.queries.labelling import _OOF

DRAWS = 200
_WEIGHT = "CASE " + " ".join(f"WHEN u <= {p!r} THEN {k}" for k, p in enumerate(POISSON_1)) + f" ELSE {len(POISSON_1)} END"


def _hits(spark, sf):
    rel = relative_error(F.col("predicted"), F.col("label"))
    return _oof(spark, sf).withColumns({"hit": (rel <= 0.1).cast("double"), "one": F.lit(1.0)})


@query("bootstrap_hit_rate", sql(("pairs",), f"""
    SELECT region, round(quantile_cont(est, 0.025), 6) AS lower, round(quantile_cont(est, 0.5), 6) AS middle,
           round(quantile_cont(est, 0.975), 6) AS upper, count(*) AS draws, quantile_cont(est, 0.025) > 0.3 AS passed
    FROM (SELECT region, draw, sum(w * hits) / sum(w * n) AS est
          FROM (SELECT *, {_WEIGHT} AS w FROM (SELECT *, {uniform_sql("s", 1)} AS u FROM (
                  SELECT *, {seed_sql("'5'", "draw", "entity")} AS s
                  FROM (SELECT region, entity, sum(CASE WHEN abs(predicted - label) / abs(label) <= 0.1 THEN 1.0 ELSE 0.0 END) AS hits,
                               count(*) AS n FROM oof GROUP BY region, entity), (SELECT unnest(range(1, {DRAWS} + 1)) AS draw))))
          GROUP BY region, draw HAVING sum(w * n) > 0)
    GROUP BY region""", **_OOF))
def bootstrap_hit_rate(spark, sf):
    """Interval of the hit rate resampling whole entities, and the preset success rule."""
    out = success_test(cluster_bootstrap(_hits(spark, sf), "hit", "one", "entity", DRAWS, 5, ["region"]), 0.3)
    return rounded(out, 6, "lower", "middle", "upper")


def _poly(coefficients, x):
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _quantile_sql(p):
    def tail(share):
        x = f"sqrt(-2.0 * ln({share}))"
        return f"({_poly(QUANTILE_C, x)} / {_poly((*QUANTILE_D, 1.0), x)})"

    middle, square = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    inner = f"({_poly(QUANTILE_A, square)} * {middle} / {_poly((*QUANTILE_B, 1.0), square)})"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} > 0.97575 THEN -{tail(f'(1 - {p})')} ELSE {inner} END"


def _share_sql(z):
    t = f"(1.0 / (1.0 + 0.2316419 * abs({z})))"
    tail = (f"(0.3989422804014327 * exp(-({z}) * ({z}) / 2) * (0.319381530 * {t} - 0.356563782 * pow({t}, 2) + 1.781477937 * pow({t}, 3)"
            f" - 1.821255978 * pow({t}, 4) + 1.330274429 * pow({t}, 5)))")
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END"


_BCA = {
    **_OOF,
    "per_entity": """SELECT region, entity, sum(CASE WHEN abs(predicted - label) / abs(label) <= 0.1 THEN 1.0 ELSE 0.0 END) AS num, count(*) AS den
                     FROM oof GROUP BY region, entity""",
    "whole": "SELECT region, sum(num) AS n, sum(den) AS d, sum(num) / sum(den) AS estimate FROM per_entity GROUP BY region",
    "without": """SELECT e.region, (w.n - e.num) / nullif(w.d - e.den, 0) - w.estimate AS u FROM per_entity e JOIN whole w ON e.region = w.region""",
    "bend": """SELECT region, coalesce(CASE WHEN sum((m - u) * (m - u)) > 0 THEN sum((m - u) * (m - u) * (m - u)) / (6 * pow(sum((m - u) * (m - u)), 1.5)) END, 0.0) AS acceleration
               FROM (SELECT region, u, avg(u) OVER (PARTITION BY region) AS m FROM without) GROUP BY region""",
    "drawn": f"""SELECT region, draw, sum(w * num) / sum(w * den) AS est
                 FROM (SELECT *, {_WEIGHT} AS w FROM (SELECT *, {uniform_sql("s", 1)} AS u FROM (
                   SELECT *, {seed_sql("'5'", "draw", "entity")} AS s FROM per_entity, (SELECT unnest(range(1, {DRAWS} + 1)) AS draw))))
                 GROUP BY region, draw HAVING sum(w * den) > 0""",
    "bias": f"""SELECT *, {_quantile_sql("least(greatest(below, 0.5 / draws), 1 - 0.5 / draws)")} AS bias
                FROM (SELECT d.region, any_value(estimate) AS estimate, count(*) AS draws, list(est ORDER BY est) AS sorted,
                             avg(CASE WHEN est < estimate THEN 1.0 WHEN est = estimate THEN 0.5 ELSE 0.0 END) AS below
                      FROM drawn d JOIN whole w ON d.region = w.region GROUP BY d.region)""",
    "ends": f"""SELECT *, {_share_sql("(bias + (bias - 1.959963984540054) / (1 - acceleration * (bias - 1.959963984540054)))")} * (draws - 1) AS lo,
                       {_share_sql("(bias + (bias + 1.959963984540054) / (1 - acceleration * (bias + 1.959963984540054)))")} * (draws - 1) AS hi
                FROM bias JOIN bend USING (region)""",
}
_AT = "sorted[CAST(floor({p}) AS INTEGER) + 1] + (sorted[CAST(ceil({p}) AS INTEGER) + 1] - sorted[CAST(floor({p}) AS INTEGER) + 1]) * ({p} - floor({p}))"


@query("accelerated_hit_rate", sql(("pairs",), f"""
    SELECT region, round(estimate, 6) AS estimate, round(bias, 5) AS bias, round(acceleration, 5) AS acceleration,
           round({_AT.format(p="lo")}, 5) AS lower, round({_AT.format(p="hi")}, 5) AS upper, draws FROM ends""", **_BCA))
def accelerated_hit_rate(spark, sf):
    """Bias-corrected accelerated interval of the hit rate, resampling whole entities."""
    out = accelerated_interval(_hits(spark, sf), "hit", "one", "entity", DRAWS, 5, ["region"])
    return rounded(rounded(out, 5, "bias", "acceleration", "lower", "upper"), 6, "estimate")


_RUNS = f"""
    SELECT r.repetition, r.level, avg(abs(a * t.peak_h0 + b - t.label)) AS mae, count(*) AS n_test
    FROM (SELECT repetition, level, CASE WHEN ok THEN s ELSE 1.0 END AS a, CASE WHEN ok THEN c ELSE 0.0 END AS b FROM (
            SELECT repetition, level, regr_slope(label, peak_h0) AS s, regr_intercept(label, peak_h0) AS c,
                   count(*) >= 2 AND regr_sxx(label, peak_h0) > 0 AS ok
            FROM (SELECT *, {_LEVEL} AS first_level FROM chain) JOIN (SELECT unnest([10, 25, 50, 100, 250]) AS level) ON first_level <= level
            GROUP BY repetition, level)) r, test_pairs t
    GROUP BY r.repetition, r.level"""
_RUN_CTES = {
    "own_split": """SELECT entity, row_number() OVER (ORDER BY md5(concat_ws(':', '11', entity))) <= floor(count(*) OVER () * 0.4) AS is_test
                    FROM (SELECT DISTINCT entity FROM pairs)""",
    "test_pairs": "SELECT p.* FROM pairs p JOIN own_split s ON p.entity = s.entity WHERE is_test",
    "pool_pairs": "SELECT p.* FROM pairs p JOIN own_split s ON p.entity = s.entity WHERE NOT is_test",
    "chain": _CHAIN.replace("FROM pairs,", "FROM pool_pairs,"), "runs": _RUNS,
}
_KEYS = ["region", "entity", "year"]


def _runs(spark, sf):
    """Errors on the rows of entities that no label set draws from."""
    base = pairs(spark, sf).select(*_KEYS, "peak_h0", "label")
    pool, test = split_frozen(base, [], 0.4, 11)
    return learning_runs(pool, test, "peak_h0", "label", GRID, 5, 13, _KEYS)


@query("learning_runs", sql(("pairs",), "SELECT repetition, level, round(mae, 4) AS mae, n_test FROM runs", **_RUN_CTES))
def learning_runs_query(spark, sf):
    return rounded(_runs(spark, sf), 4, "mae")


_TOST = """SELECT r.level, avg(r.mae - m.mae) AS mean_diff, stddev_samp(r.mae - m.mae) AS sd_diff, count(*) AS n
           FROM runs r JOIN runs m ON r.repetition = m.repetition AND m.level = 250 WHERE r.level < 250 GROUP BY r.level"""


def _differences(spark, sf):
    runs = _runs(spark, sf)
    top = runs.where(F.col("level") == 250).select("repetition", F.col("mae").alias("top_mae"))
    return runs.where(F.col("level") < 250).join(top, "repetition").withColumn("diff", F.col("mae") - F.col("top_mae"))


@query("equivalence_test", sql(("pairs",), """
    SELECT level, round(mean_diff, 4) AS mean_diff, round(sd_diff, 4) AS sd_diff, n,
           round(mean_diff - 1.6448536269514722 * sd_diff / sqrt(n), 4) AS lower, round(mean_diff + 1.6448536269514722 * sd_diff / sqrt(n), 4) AS upper,
           mean_diff - 1.6448536269514722 * sd_diff / sqrt(n) > -300 AND mean_diff + 1.6448536269514722 * sd_diff / sqrt(n) < 300 AS equivalent
    FROM tost""", **_RUN_CTES, tost=_TOST))
def equivalence_test(spark, sf):
    return rounded(equivalence(_differences(spark, sf), "diff", "level", 300.0), 4, "mean_diff", "sd_diff", "lower", "upper")


@query("smallest_equivalent_level", sql(("pairs",), """
    SELECT min(CASE WHEN mean_diff - 1.6448536269514722 * sd_diff / sqrt(n) > -300 AND mean_diff + 1.6448536269514722 * sd_diff / sqrt(n) < 300
               THEN level END) AS smallest_level FROM tost""", **_RUN_CTES, tost=_TOST))
def smallest_equivalent_level(spark, sf):
    return smallest_equivalent(equivalence(_differences(spark, sf), "diff", "level", 300.0), "level")


_DOUBLED = """
    SELECT *, CAST(2 * rank() OVER (PARTITION BY grp ORDER BY abs(d)) + count(*) OVER (PARTITION BY grp, abs(d)) - 1 AS INTEGER) AS twice,
           count(*) OVER (PARTITION BY grp) AS n FROM signed_diffs WHERE d <> 0"""
_COUNTED = """
    SELECT grp, any_value(n) AS n, CAST(sum(CASE WHEN d > 0 THEN twice ELSE 0 END) AS INTEGER) AS plus,
           list_reduce(list_concat([list_transform(range(CAST(sum(twice) AS INTEGER) + 1), lambda k: CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0 END)], list([CAST(twice AS DOUBLE)])),
             lambda acc, r: list_transform(range(len(acc)), lambda k: acc[k + 1] + CASE WHEN k >= r[1] THEN acc[CAST(k + 1 - r[1] AS INTEGER)] ELSE 0.0 END)) AS counts
    FROM doubled WHERE n <= 25 GROUP BY grp"""
_EXACT = """SELECT grp, n, plus / 2.0 AS w_plus, least(1.0, 2 * least(list_sum(counts[1:plus + 1]), list_sum(counts[plus + 1:])) / pow(2.0, n)) AS p_value FROM counted
            UNION ALL SELECT DISTINCT grp, n, NULL, NULL FROM doubled WHERE n > 25"""
_EXACT_CTES = {"doubled": _DOUBLED, "counted": _COUNTED, "exact": _EXACT}


@query("exact_signed_rank_test", sql(("pairs",), """
    SELECT grp.region AS region, grp.year AS year, n, w_plus, round(p_value, 8) AS p_value FROM exact""",
    signed_diffs="SELECT {'region': region, 'year': year} AS grp, round((label - peak_h0) / 5000) AS d FROM pairs", **_EXACT_CTES))
def exact_signed_rank_test(spark, sf):
    """Small sets of pairs, one a region and year, by enumeration of the signed ranks."""
    coarse = pairs(spark, sf).withColumn("d", F.round((F.col("label") - F.col("peak_h0")) / 5000))
    return rounded(exact_signed_rank(coarse, "d", ["region", "year"]), 8, "p_value")


@query("adjacent_level_test", sql(("pairs",), """
    SELECT grp AS level, n, w_plus, round(p_value, 8) AS p_value,
           round(max(least(1.0, (m - i + 1) * p_value)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS adjusted_p
    FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, grp) AS i FROM (
      SELECT * FROM exact UNION ALL SELECT DISTINCT grp, 0, 0.0, 1.0 FROM signed_diffs WHERE grp NOT IN (SELECT grp FROM doubled)))""", **_RUN_CTES,
    signed_diffs="""SELECT level AS grp, d FROM (SELECT level, round(mae - lag(mae) OVER (PARTITION BY repetition ORDER BY level), 6) AS d FROM runs) WHERE d IS NOT NULL""", **_EXACT_CTES))
def adjacent_level_test(spark, sf):
    """Errors of each label-set size against the next smaller one over the repetitions, adjusted for the number of tests.

    A size whose errors never differ from those of the smaller one, since the pool is used up, has no pairs and p = 1.
    """
    steps = adjacent_differences(_runs(spark, sf), "level", "repetition", "mae").withColumn("diff", F.round("diff", 6))
    found = steps.select("level").distinct().join(exact_signed_rank(steps, "diff", ["level"]), "level", "left")
    idle = F.col("n").isNull()
    found = found.select("level", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.when(idle, 0.0).otherwise(F.col("w_plus")).alias("w_plus"), F.when(idle, 1.0).otherwise(F.col("p_value")).alias("p_value"))
    out = holm(found, "p_value", (), ("level",))
    return rounded(out.select("level", "n", "w_plus", "p_value", "adjusted_p"), 8, "p_value", "adjusted_p")


_SIGNED = """
    SELECT year, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus, count(*) AS n, sum(tied * tied - 1) AS ties
    FROM (SELECT year, d, rank() OVER (PARTITION BY year ORDER BY abs(d)) + (count(*) OVER (PARTITION BY year, abs(d)) - 1) / 2.0 AS rk,
                 count(*) OVER (PARTITION BY year, abs(d)) AS tied
          FROM (SELECT year, round((label - peak_h0) / 5000) AS d FROM pairs) WHERE d <> 0) GROUP BY year"""
_Z = "(w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)"
_T = "(1.0 / (1.0 + 0.2316419 * abs(z)))"
_TAIL = (f"0.3989422804014327 * exp(-z * z / 2) * (0.319381530 * {_T} - 0.356563782 * pow({_T}, 2) + 1.781477937 * pow({_T}, 3)"
         f" - 1.821255978 * pow({_T}, 4) + 1.330274429 * pow({_T}, 5))")
_TESTS = f"SELECT *, least(1.0, 2 * {_TAIL}) AS p_value FROM (SELECT *, {_Z} AS z FROM signed)"


def _signed(spark, sf):
    coarse = pairs(spark, sf).withColumn("d", F.round((F.col("label") - F.col("peak_h0")) / 5000))
    return signed_rank(coarse, "d", ["year"])


@query("signed_rank_test", sql(("pairs",), """
    SELECT year, round(w_plus, 2) AS w_plus, n, round(z, 6) AS z, round(p_value, 6) AS p_value FROM tests""", signed=_SIGNED, tests=_TESTS))
def signed_rank_test(spark, sf):
    return rounded(rounded(_signed(spark, sf), 6, "z", "p_value"), 2, "w_plus").withColumn("n", F.col("n").cast("bigint"))


@query("holm_adjustment", sql(("pairs",), """
    SELECT year, round(p_value, 6) AS p_value, round(max(least(1.0, (m - i + 1) * p_value)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS adjusted_p
    FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, year) AS i FROM tests)""", signed=_SIGNED, tests=_TESTS))
def holm_adjustment(spark, sf):
    out = holm(_signed(spark, sf), "p_value", (), ("year",))
    return rounded(out.select("year", "p_value", "adjusted_p"), 6, "p_value", "adjusted_p")


@query("cliffs_delta", """
    SELECT event_type, CAST(sum(f) AS BIGINT) AS n_first, count(*) - CAST(sum(f) AS BIGINT) AS n_second,
           round(2 * (sum(CASE WHEN f = 1 THEN rk ELSE 0 END) - sum(f) * (sum(f) + 1) / 2.0) / (sum(f) * (count(*) - sum(f))) - 1, 6) AS delta
    FROM (SELECT event_type, f, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rk
          FROM (SELECT event_type, value, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END AS f FROM events)) GROUP BY event_type""")
def cliffs_delta_query(spark, sf):
    """Values of the first half of the month against the second, per event type."""
    first = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return rounded(cliffs_delta(table(spark, sf, "events"), "value", first, ["event_type"]), 6, "delta")


@query("value_ranks", """
    SELECT l_returnflag, l_quantity, count(*) AS rows, sum(count(*)) OVER w - count(*) AS below, sum(count(*)) OVER (PARTITION BY l_returnflag) AS total
    FROM lineitem GROUP BY l_returnflag, l_quantity WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)""")
def value_ranks(spark, sf):
    """Cumulative histogram of few groups with heavy ties."""
    out = cumulative_histogram(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", levels=2)
    return out.select("l_returnflag", "l_quantity", *[F.col(c).cast("bigint").alias(c) for c in ("rows", "below", "total")])


@query("global_price_ranks", """
    SELECT round(l_extendedprice, -2) AS price, count(*) AS rows, sum(count(*)) OVER (ORDER BY round(l_extendedprice, -2)) - count(*) AS below,
           sum(count(*)) OVER () AS total FROM lineitem GROUP BY round(l_extendedprice, -2)""")
def global_price_ranks(spark, sf):
    """The same over everything as one group."""
    df = table(spark, sf, "lineitem").select(F.round("l_extendedprice", -2).alias("price"))
    return cumulative_histogram(df, [], "price", levels=2).select(
        "price", *[F.col(c).cast("bigint").alias(c) for c in ("rows", "below", "total")])


@query("average_method_ranks", sql(("readings",), """
    SELECT method, round(avg(rk), 6) AS mean_rank, count(*) AS n_sets FROM (
      SELECT region, year, method, rank() OVER (PARTITION BY region, year ORDER BY score) + (count(*) OVER (PARTITION BY region, year, score) - 1) / 2.0 AS rk
      FROM (SELECT region, year, unnest(['max', 'p999', 'p99']) AS method,
                   unnest([round(max(value), -3), round(quantile_cont(value, 0.999), -3), round(quantile_cont(value, 0.99), -3)]) AS score
            FROM readings GROUP BY region, year)) GROUP BY method"""))
def average_method_ranks(spark, sf):
    """Methods ranked inside every (region, year) and averaged."""
    from structpeak.operators.hotkeys import by_group_size
    from structpeak.operators.ordering import exact_quantiles

    base = readings(spark, sf)
    by = ["region", "year"]
    tops = base.groupBy(*by).agg(F.max("value").alias("max"))
    qs = by_group_size(base, by, lambda p, spread: exact_quantiles(p, by, "value", {"p999": 0.999, "p99": 0.99}, spread))
    wide = tops.join(qs, by).withColumn("dataset", F.concat_ws("|", *by))
    long = wide.unpivot(["dataset"], ["max", "p999", "p99"], "method", "score").withColumn("score", F.round("score", -3))
    return rounded(average_ranks(long, "dataset", "method", "score"), 6, "mean_rank")


_OPINIONS = """SELECT user_id, CAST(ts AS DATE) AS day, event_type, arg_max(value, (ts, event_id)) AS v FROM events
               WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3"""


def _opinions(spark, sf):
    events = table(spark, sf, "events").where(F.col("event_type").isin("click", "view")).withColumn("day", F.to_date("ts"))
    return events.groupBy("user_id", "day", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))


@query("annotator_deviation", sql((), """
    SELECT user_id, day, round(a, 4) AS first_value, round(b, 4) AS second_value, round(abs(a - b), 4) AS deviation
    FROM (SELECT user_id, day, max(CASE WHEN event_type = 'click' THEN v END) AS a, max(CASE WHEN event_type = 'view' THEN v END) AS b
          FROM opinions GROUP BY user_id, day HAVING count(*) = 2)""", opinions=_OPINIONS))
def annotator_deviation(spark, sf):
    """Two event types of a user's day as two opinions on it."""
    out = pair_deviation(_opinions(spark, sf), ["user_id", "day"], "event_type", "v").drop("first_annotator", "second_annotator")
    return rounded(out, 4, "first_value", "second_value", "deviation")


_THREE = """SELECT user_id, CAST(ts AS DATE) AS day, event_type, arg_max(value, (ts, event_id)) AS v FROM events
            WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2, 3"""


@query("annotator_pairs", sql((), """
    SELECT a.user_id, a.day, a.event_type AS first_annotator, b.event_type AS second_annotator, round(a.v, 4) AS first_value, round(b.v, 4) AS second_value,
           round(abs(a.v - b.v), 4) AS deviation
    FROM three a JOIN three b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type < b.event_type WHERE a.v IS NOT NULL AND b.v IS NOT NULL""", three=_THREE))
def annotator_pairs(spark, sf):
    """Three event types of a user's day as up to three opinions on it, every pair of them."""
    events = table(spark, sf, "events").where(F.col("event_type").isin("click", "view", "purchase")).withColumn("day", F.to_date("ts"))
    three = events.groupBy("user_id", "day", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return rounded(pair_deviation(three, ["user_id", "day"], "event_type", "v"), 4, "first_value", "second_value", "deviation")


@query("annotator_agreement", sql((), """
    SELECT n AS n_keys, round(msb, 4) AS ms_between, round(msw, 4) AS ms_within, round((msb - msw) / (msb + (k0 - 1) * msw), 6) AS icc
    FROM (SELECT n, ssb / (n - 1) AS msb, ssw / (total - n) AS msw, (total - k2 / total) / (n - 1) AS k0
          FROM (SELECT count(*) AS n, sum(k) AS total, sum(k * k) AS k2, sum(ssw) AS ssw, sum(k * (m - grand) * (m - grand)) AS ssb
                FROM (SELECT count(v) AS k, avg(v) AS m, var_pop(v) * count(v) AS ssw FROM opinions GROUP BY user_id, day),
                     (SELECT avg(v) AS grand FROM opinions)))""", opinions=_OPINIONS))
def annotator_agreement(spark, sf):
    return rounded(rounded(intraclass_correlation(_opinions(spark, sf), ["user_id", "day"], "v"), 6, "icc"), 4, "ms_between", "ms_within")


_CURVE = "SELECT level, avg(mae) AS e FROM runs GROUP BY level"


@query("learning_curve_fit", sql(("pairs",), """
    SELECT best.* FROM (SELECT 1) LEFT JOIN (
    SELECT round(floor, 2) AS floor, round(exp(i), 3) AS a, round(-s, 5) AS b, round(sse, 2) AS sse, round(pow(exp(i) / 150.0, 1 / -s), 2) AS n_star
    FROM (SELECT f.floor, f.s, f.i, sum((c.e - f.floor - exp(f.i) * pow(c.level, f.s)) * (c.e - f.floor - exp(f.i) * pow(c.level, f.s))) AS sse
          FROM fits f JOIN curve c ON c.e > f.floor GROUP BY 1, 2, 3) ORDER BY sse, floor LIMIT 1) best ON TRUE""",
    **_RUN_CTES, curve=_CURVE,
    fits="""SELECT floor, regr_slope(ln(e - floor), ln(level)) AS s, regr_intercept(ln(e - floor), ln(level)) AS i
            FROM curve, (SELECT CAST(unnest(range(0, 30000, 500)) AS DOUBLE) AS floor) WHERE e > floor
            GROUP BY floor HAVING count(*) >= 3 AND regr_slope(ln(e - floor), ln(level)) < 0"""))
def learning_curve_fit(spark, sf):
    """Power law through the mean test error of every label-set size."""
    curve = _runs(spark, sf).groupBy("level").agg(F.avg("mae").alias("e"))
    out = fit_learning_curve(curve, "level", "e", [float(f) for f in range(0, 30000, 500)], 300.0)
    return rounded(rounded(rounded(out, 2, "floor", "sse", "n_star"), 3, "a"), 5, "b")
