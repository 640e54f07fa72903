"""Series operators: positions, gaps, scaling, windows, channels, registry alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from structpeak.operators.contamination import contaminated_copies, with_channels
from structpeak.operators.hotkeys import MANY, by_group_size
from structpeak.operators.ordering import exact_quantiles
from structpeak.operators.registry import align_registry, align_windows, registry_months, registry_stats
from structpeak.operators.sampling import rows_of_sample, sample_entities, sample_windows
from structpeak.operators.series import (
    fill_gaps, fixed_windows, full_groups, position_index, robust_scaler, series_windows, unscaled, with_scaler,
)
from structpeak.plans.scoring import raw_window_peaks
from structpeak.queries.base import (
    CONFIG, KEY, LENGTH, SEED, TIE, months, query, raw_registry, readings, rounded, seed_sql, sql, table, uniform_sql,
)


def _windows(spark, sf, length=LENGTH, **options):
    return by_group_size(
        readings(spark, sf), KEY, lambda part, spread: series_windows(part, length, tie=TIE, spread=spread, **options)
    )


def _registry_windows(spark, sf):
    found = months(spark, sf)
    return align_windows(_windows(spark, sf), found, registry_stats(found))


@query("annual_window_peak", sql(("points",), """
    SELECT region, entity, year, round(quantile_cont(v, 0.999), 6) AS peak FROM points GROUP BY region, entity, year"""))
def annual_window_peak(spark, sf):
    """Flagship chain: fill, scale, cut, unscale, high quantile."""
    return rounded(raw_window_peaks(readings(spark, sf), LENGTH, 0.999, TIE), 6, "peak")


@query("annual_window_peak_spread", sql(("points",), """
    SELECT region, entity, year, round(quantile_cont(v, 0.999), 6) AS peak FROM points GROUP BY region, entity, year"""))
def annual_window_peak_spread(spark, sf):
    """The same chain with series above 60 readings treated as too long for one task."""
    return rounded(raw_window_peaks(readings(spark, sf), LENGTH, 0.999, TIE, task_rows=60), 6, "peak")


@query("gap_fill_spread", sql(("filled",), """
    SELECT region, entity, year, pos, round(value, 6) AS value, round(filled, 6) AS filled FROM filled"""))
def gap_fill_spread(spark, sf):
    """Gaps filled across time slots, every series in the spread form."""
    filled = fill_gaps(readings(spark, sf), KEY, tie=TIE, spread=MANY)
    return rounded(filled.select(*KEY, "pos", "value", "filled"), 6, "value", "filled")


@query("position_index", sql(("indexed",), """
    SELECT region, entity, year, l_orderkey, l_linenumber, l_partkey, tie_price, pos FROM indexed"""))
def position_index_query(spark, sf):
    numbered = by_group_size(readings(spark, sf), KEY, lambda p, spread: position_index(p, KEY, tie=TIE, spread=spread))
    return numbered.select(*KEY, "l_orderkey", "l_linenumber", "l_partkey", "tie_price", "pos")


@query("gap_fill", sql(("filled",), """
    SELECT region, entity, year, pos, round(value, 6) AS value, round(filled, 6) AS filled FROM filled"""))
def gap_fill(spark, sf):
    filled = by_group_size(readings(spark, sf), KEY, lambda p, spread: fill_gaps(p, KEY, tie=TIE, spread=spread))
    return rounded(filled.select(*KEY, "pos", "value", "filled"), 6, "value", "filled")


_USER = """
    SELECT user_id, ts, event_id, nullif(value, CASE WHEN event_type = 'error' THEN value END) AS value,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events"""
_USER_NEAR = """
    SELECT *, last_value(value IGNORE NULLS) OVER b AS pv,
      last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
      first_value(value IGNORE NULLS) OVER f AS nv,
      first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS np
    FROM marked
    WINDOW b AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           f AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@query("event_gap_fill", sql((), """
    SELECT user_id, event_id, pos,
      round(CASE WHEN value IS NOT NULL THEN value
           WHEN pp IS NOT NULL AND np IS NOT NULL THEN pv + (nv - pv) * (CAST(pos - pp AS DOUBLE) / (np - pp))
           ELSE coalesce(pv, nv, 0.0) END, 6) AS filled FROM near""", marked=_USER, near=_USER_NEAR))
def event_gap_fill(spark, sf):
    """Irregular short series: a user's readings, error events counting as missing."""
    events = table(spark, sf, "events").select(
        "user_id", "ts", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )
    filled = by_group_size(
        events, ["user_id"], lambda p, spread: fill_gaps(p, ["user_id"], tie=["event_id"], spread=spread)
    )
    return rounded(filled.select("user_id", "event_id", "pos", "filled"), 6, "filled")


@query("robust_scaler", sql(("scalers",), """
    SELECT region, entity, year, n_good, round(median, 6) AS median, round(scale, 6) AS scale FROM scalers"""))
def robust_scaler_query(spark, sf):
    scaler = by_group_size(readings(spark, sf), KEY, lambda p, spread: robust_scaler(p, KEY, spread=spread))
    return rounded(scaler, 6, "median", "scale")


@query("scaled_readings", sql(("readings", "scalers"), """
    SELECT r.region, r.entity, r.year, r.l_orderkey, r.l_linenumber, r.l_partkey, r.tie_price,
           round((r.value - s.median) / s.scale, 6) AS z, round(((r.value - s.median) / s.scale) * s.scale + s.median, 6) AS back
    FROM readings r JOIN scalers s ON r.region = s.region AND r.entity = s.entity AND r.year = s.year"""))
def scaled_readings(spark, sf):
    df = by_group_size(readings(spark, sf), KEY, lambda p, spread: with_scaler(p, KEY, spread=spread))
    z = (F.col("value") - F.col("median")) / F.col("scale")
    out = df.withColumn("z", z).withColumn("back", unscaled(F.col("z"), F.col("median"), F.col("scale")))
    return rounded(out.select(*KEY, "l_orderkey", "l_linenumber", "l_partkey", "tie_price", "z", "back"), 6, "z", "back")


@query("annual_quantile", sql(("readings",), """
    SELECT region, entity, year, round(quantile_cont(value, 0.999), 6) AS q999, round(quantile_cont(value, 0.5), 6) AS q500
    FROM readings GROUP BY region, entity, year"""))
def annual_quantile_query(spark, sf):
    qs = {"q999": 0.999, "q500": 0.5}
    out = by_group_size(readings(spark, sf), KEY, lambda p, spread: exact_quantiles(p, KEY, "value", qs, spread))
    return rounded(out, 6, "q999", "q500")


def _points(df, array="filled"):
    return df.select(*KEY, "window_id", F.posexplode_outer(array).alias("i", "v"))


def _filled_windows(spark, sf, length, stride=None):
    def build(part, spread):
        return fixed_windows(fill_gaps(part, KEY, tie=TIE, spread=spread), length, stride, KEY)

    return by_group_size(readings(spark, sf), KEY, build)


@query("fixed_windows", sql(("points",), """
    SELECT region, entity, year, window_id, i, round(v, 6) AS v FROM points"""))
def fixed_windows_query(spark, sf):
    return rounded(_points(_filled_windows(spark, sf, LENGTH)), 6, "v")


@query("overlapping_windows", sql(("filled",), """
    SELECT f.region, f.entity, f.year, g.window_id, f.pos - 1 - g.window_id * 10 AS i, round(f.filled, 6) AS v
    FROM filled f JOIN groups g ON f.region = g.region AND f.entity = g.entity AND f.year = g.year
     AND f.pos - 1 >= g.window_id * 10 AND f.pos - 1 < g.window_id * 10 + 24
    WHERE g.n >= 24
    UNION ALL
    SELECT s.region, s.entity, s.year, 0 AS window_id, i, round(w[least(i + 1, n)], 6) AS v
    FROM (SELECT region, entity, year, count(*) AS n, list(filled ORDER BY pos) AS w FROM filled
          GROUP BY region, entity, year HAVING count(*) < 24) s, (SELECT unnest(range(24)) AS i)""",
    groups="""SELECT region, entity, year, n, unnest(range(1 + greatest(0, (n - 24) // 10))) AS window_id
              FROM (SELECT region, entity, year, count(*) AS n FROM filled GROUP BY region, entity, year)"""))
def overlapping_windows(spark, sf):
    return rounded(_points(_filled_windows(spark, sf, LENGTH, 10)), 6, "v")


@query("padded_windows", sql(("filled",), """
    SELECT region, entity, year, n AS size, 0 AS window_id, i, round(w[least(i + 1, n)], 6) AS v
    FROM (SELECT region, entity, year, count(*) AS n, list(filled ORDER BY pos) AS w FROM filled GROUP BY region, entity, year) s,
         (SELECT unnest(range(144)) AS i)"""))
def padded_windows(spark, sf):
    """Series shorter than one window of 144: extended with the last value."""
    df = _filled_windows(spark, sf, 144)
    return rounded(df.select(*KEY, "size", "window_id", F.posexplode_outer("filled").alias("i", "v")), 6, "v")


@query("full_groups", sql(("readings",), """
    SELECT region, entity, year, l_orderkey, l_linenumber, l_partkey, tie_price
    FROM (SELECT *, count(*) OVER (PARTITION BY region, entity, year) AS n FROM readings) WHERE n >= 80"""))
def full_groups_query(spark, sf):
    return full_groups(readings(spark, sf), KEY, 80).select(*KEY, "l_orderkey", "l_linenumber", "l_partkey", "tie_price")


@query("registry_months", sql(("months",), """
    SELECT region, entity, year, month, round(level, 6) AS level, round(level_delta, 6) AS level_delta FROM months"""))
def registry_months_query(spark, sf):
    return rounded(registry_months(raw_registry(spark, sf)).drop("period"), 6, "level", "level_delta")


@query("registry_stats", sql(("stats",), """
    SELECT round(level_mean, 6) AS level_mean, round(level_std, 6) AS level_std, round(delta_std, 6) AS delta_std FROM stats"""))
def registry_stats_query(spark, sf):
    return rounded(registry_stats(months(spark, sf)), 6, "level_mean", "level_std", "delta_std")


_ALIGNED = """
    SELECT {key}, coalesce((m.level - level_mean) / level_std, 0.0) AS level, coalesce(m.level_delta / delta_std, 0.0) AS level_delta
    FROM {base} x LEFT JOIN months m ON x.region = m.region AND x.entity = m.entity
      AND year(x.ts) = m.year AND month(x.ts) = m.month, stats"""


@query("registry_alignment", sql(("readings", "stats"), """
    SELECT region, entity, year, l_orderkey, l_linenumber, l_partkey, tie_price, round(level, 6) AS level,
           round(level_delta, 6) AS level_delta FROM aligned""",
    aligned=_ALIGNED.format(base="readings", key="x.region, x.entity, x.year, l_orderkey, l_linenumber, l_partkey, tie_price")))
def registry_alignment(spark, sf):
    found = months(spark, sf)
    out = align_registry(readings(spark, sf), found, registry_stats(found))
    return rounded(out.select(*KEY, "l_orderkey", "l_linenumber", "l_partkey", "tie_price", "level", "level_delta"), 6, "level", "level_delta")


@query("window_alignment", sql(("zpoints", "stats"), """
    SELECT region, entity, year, window_id, i, round(z, 6) AS z, round(level, 6) AS level, round(level_delta, 6) AS level_delta FROM aligned""",
    aligned=_ALIGNED.format(base="zpoints", key="x.region, x.entity, x.year, x.window_id, x.i, x.z")))
def window_alignment(spark, sf):
    """Scaled windows of every series with the registry looked up per point."""
    packed = F.arrays_zip(F.col("values").alias("z"), "level", "level_delta")
    out = _registry_windows(spark, sf).select(*KEY, "window_id", F.posexplode_outer(packed).alias("i", "p"))
    return rounded(out.select(*KEY, "window_id", "i", "p.z", "p.level", "p.level_delta"), 6, "z", "level", "level_delta")


@query("sampled_group_windows", sql(("zlists",), """
    SELECT region, entity, year, window_id, draw, round(zw[1], 6) AS first_z, round(zw[24], 6) AS last_z
    FROM (SELECT *, row_number() OVER (PARTITION BY region, entity, year
            ORDER BY md5(concat_ws(':', '7', region, entity, CAST(year AS VARCHAR), CAST(window_id AS VARCHAR))), window_id) AS draw
          FROM zlists WHERE size = 24) WHERE draw <= 2"""))
def sampled_group_windows(spark, sf):
    """At most two windows per series by seeded draw; series shorter than a window left out."""
    df = sample_windows(_windows(spark, sf, pad_short=False), 2, SEED, KEY)
    out = df.select(*KEY, "window_id", "draw", F.col("values")[0].alias("first_z"), F.col("values")[LENGTH - 1].alias("last_z"))
    return rounded(out, 6, "first_z", "last_z")


def _near(j: int, width: int = 24) -> str:
    return f"zw[least(greatest(i + 1 + {j}, 1), {width})]"


_SPREAD_MEAN = "(" + " + ".join(_near(j) for j in range(-3, 4)) + ") / 7"
_SPREAD_SQ = "(" + " + ".join(f"{_near(j)} * {_near(j)}" for j in range(-3, 4)) + ") / 7"
_CHANNELS = f"""
    SELECT region, entity, year, window_id, i, zw[i + 1] AS z,
      CASE WHEN i = 0 THEN zw[2] - zw[1] WHEN i = {LENGTH - 1} THEN zw[{LENGTH}] - zw[{LENGTH - 1}]
           ELSE (zw[i + 2] - zw[i]) / 2 END AS derivative,
      sqrt(greatest({_SPREAD_SQ} - ({_SPREAD_MEAN}) * ({_SPREAD_MEAN}), 0.0)) AS spread
    FROM {{base}}, (SELECT unnest(range({LENGTH})) AS i)"""


@query("window_channels", sql(("zlists",), """
    SELECT region, entity, year, window_id, i, round(z, 5) AS z, round(derivative, 5) AS derivative, round(spread, 5) AS spread
    FROM channels""", channels=_CHANNELS.format(base="zlists")))
def window_channels(spark, sf):
    df = with_channels(_windows(spark, sf), CONFIG)
    packed = F.arrays_zip(F.col("channels.value").alias("z"), F.col("channels.derivative").alias("derivative"),
                          F.col("channels.spread").alias("spread"))
    out = df.select(*KEY, "window_id", F.posexplode_outer(packed).alias("i", "p")).select(*KEY, "window_id", "i", "p.*")
    return rounded(out, 5, "z", "derivative", "spread")


def contaminated_sql(length: int, config) -> dict[str, str]:
    """Draws of every copy of a window, then its contaminated points."""
    def u(stream):
        return uniform_sql("s", stream)

    def sign(stream):
        return f"(CASE WHEN {u(stream)} < 0.5 THEN -1.0 ELSE 1.0 END)"

    def spike(j):
        place = f"CAST(floor({u(8 + j)} * {length}) AS BIGINT)"
        return f"{place} AS place{j}, {config.spike_amplitude} * {sign(11 + j)} * (0.5 + {u(14 + j)}) AS spike{j}"

    eighth = length // 8
    seeds = f"""SELECT *, {seed_sql(f"'{config.seed}'", "replica", "region", "entity", "year", "window_id")} AS s
                FROM zlists, (SELECT unnest(range(1, {config.replicas} + 1)) AS replica)"""
    draws = f"""
        SELECT *, CAST(floor({u(2)} * {length}) AS BIGINT) AS p0,
          least({length}, CAST(floor({u(2)} * {length}) AS BIGINT) + {eighth} + CAST(floor({u(3)} * {length - eighth}) AS BIGINT)) AS p1,
          CASE WHEN {u(1)} < {config.plateau_probability}
               THEN {config.plateau_amplitude} * {sign(4)} * (0.5 + {u(5)}) ELSE 0.0 END AS plateau,
          CASE WHEN {u(6)} < {config.spike_probability} THEN 1 + CAST(floor({u(7)} * 3) AS BIGINT) ELSE 0 END AS k,
          {spike(0)}, {spike(1)}, {spike(2)}
        FROM seeds"""
    a, b = uniform_sql("s", "(100 + 2 * i)"), uniform_sql("s", "(101 + 2 * i)")
    dirty = f"""
        SELECT region, entity, year, window_id, replica, i, zw[i + 1] AS z,
          zw[i + 1] + CASE WHEN i >= p0 AND i < p1 THEN plateau ELSE 0.0 END
          + CASE WHEN k >= 3 AND i = place2 THEN spike2 WHEN k >= 2 AND i = place1 THEN spike1
                 WHEN k >= 1 AND i = place0 THEN spike0 ELSE 0.0 END
          + {config.noise} * (sqrt(-2.0 * ln({a})) * cos(6.283185307179586 * {b})) AS x
        FROM draws, (SELECT unnest(range({length})) AS i)"""
    return {"seeds": seeds, "draws": draws, "dirty": dirty}


_DIRTY = contaminated_sql(LENGTH, CONFIG)
_DIRTY_LISTS = """SELECT region, entity, year, window_id, replica, list(x ORDER BY i) AS zw
                  FROM dirty GROUP BY region, entity, year, window_id, replica"""


@query("contaminated_windows", sql(("zlists",), """
    SELECT region, entity, year, window_id, replica, i, round(z, 5) AS z, round(x, 5) AS x FROM dirty""", **_DIRTY))
def contaminated_windows(spark, sf):
    df = contaminated_copies(_windows(spark, sf), CONFIG, KEY)
    packed = F.arrays_zip(F.col("values").alias("z"), F.col("contaminated").alias("x"))
    out = df.select(*KEY, "window_id", "replica", F.posexplode_outer(packed).alias("i", "p"))
    return rounded(out.select(*KEY, "window_id", "replica", "i", "p.z", "p.x"), 5, "z", "x")


@query("contaminated_channels", sql(("zlists",), """
    SELECT c.region, c.entity, c.year, c.window_id, c.replica, c.i, round(c.z, 5) AS x, round(c.derivative, 5) AS derivative,
           round(c.spread, 4) AS spread, round(d.z, 5) AS target
    FROM channels c JOIN dirty d ON c.region = d.region AND c.entity = d.entity AND c.year = d.year
      AND c.window_id = d.window_id AND c.replica = d.replica AND c.i = d.i""",
    **_DIRTY, dirty_lists=_DIRTY_LISTS, channels=_CHANNELS.format(base="dirty_lists").replace("window_id, i,", "window_id, replica, i,", 1)))
def contaminated_channels(spark, sf):
    """Channels rebuilt from the contaminated value, with the clean target beside."""
    df = with_channels(contaminated_copies(_windows(spark, sf), CONFIG, KEY), CONFIG, "contaminated")
    packed = F.arrays_zip(F.col("channels.value").alias("x"), F.col("channels.derivative").alias("derivative"),
                          F.col("channels.spread").alias("spread"), F.col("values").alias("target"))
    out = df.select(*KEY, "window_id", "replica", F.posexplode_outer(packed).alias("i", "p")).select(*KEY, "window_id", "replica", "i", "p.*")
    return rounded(rounded(out, 5, "x", "derivative", "target"), 4, "spread")


_SAMPLE = """SELECT entity FROM (SELECT DISTINCT entity FROM readings) ORDER BY md5(concat_ws(':', '7', entity)), entity LIMIT 30"""


@query("sampled_entities", sql(("readings",), "SELECT entity FROM chosen", chosen=_SAMPLE))
def sampled_entities(spark, sf):
    return sample_entities(readings(spark, sf), 30, SEED)


@query("sampled_entity_readings", sql(("readings",), """
    SELECT region, entity, year, count(*) AS n, round(sum(value), 2) AS total FROM readings
    WHERE entity IN (SELECT entity FROM chosen) GROUP BY region, entity, year""", chosen=_SAMPLE))
def sampled_entity_readings(spark, sf):
    base = readings(spark, sf)
    kept = rows_of_sample(base, sample_entities(base, 30, SEED))
    return kept.groupBy(*KEY).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("result_records", sql(("points",), f"""
    SELECT region, 'feeder' AS kind, entity, 'price' AS measure, year, round(quantile_cont(v, 0.999), 6) AS peak_h0,
           'identity' AS model_version FROM points GROUP BY region, entity, year"""))
def result_records(spark, sf):
    from structpeak.plans.results import h0_records

    peaks = raw_window_peaks(readings(spark, sf), LENGTH, 0.999, TIE)
    return rounded(h0_records(peaks, "price", "identity"), 6, "peak_h0")
