"""Binding of the operators to the given tables, and the same inputs as SQL.

Every input is derived from the whole tables. The files hold no missing values, so a reading
counts as missing where the line has no discount.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structpeak.config import PeakConfig
from structpeak.operators.registry import registry_months

KEY = ("region", "entity", "year")
TIE = ("l_orderkey", "l_linenumber", "l_partkey", "tie_price")
#: Suppliers sent to every task instead of moving the lines to them; about 100 bytes each.
MOST_SENT = 1_000_000
LENGTH = 24  # about three windows and a dropped tail per series of the given tables
MEASURE = "price"
SEED = 7
CONFIG = PeakConfig(measure=MEASURE, length=LENGTH, latent=6, seed=SEED, replicas=2)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL it must equal where there is one."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with their region name."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("r_name").alias("region"), F.col("s_suppkey").cast("string").alias("entity"), "s_nationkey", "s_acctbal"
    )


def sent_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """The same for a join with lines: the optimiser takes their size for a product of tables, so their number is counted."""
    found = suppliers(spark, sf)
    return F.broadcast(found) if table(spark, sf, "supplier").count() <= MOST_SENT else found


def readings(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    joined = lines.join(sent_suppliers(spark, sf), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        "region", "entity", F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("value"),
        F.year("l_shipdate").alias("year"),
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("tie_price"),
    )


def raw_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly level of each supplier: finished order value of its nation, in thousands."""
    sold = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    by_nation = sold.groupBy(
        "c_nationkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    ).agg((F.sum(done) / 1000).alias("level"))
    return by_nation.join(suppliers(spark, sf), F.col("c_nationkey") == F.col("s_nationkey")).select(
        "region", "entity", "year", "month", (F.col("year") * 100 + F.col("month")).alias("period"), "level"
    )


def months(spark: SparkSession, sf: str) -> DataFrame:
    return registry_months(raw_registry(spark, sf))


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier h0 results: the raw yearly maximum."""
    return readings(spark, sf).groupBy(*KEY).agg(F.max("value").alias("peak_h0")).withColumn("measure", F.lit(MEASURE))


def label_log(spark: SparkSession, sf: str) -> DataFrame:
    """One opinion per quarter on every series; those on poorly funded suppliers, and some others, are empty."""
    lines = table(spark, sf, "lineitem")
    known = sent_suppliers(spark, sf)
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        lines.join(known, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("region", "entity", F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"))
        .agg(F.max("l_shipdate").alias("labelled_at"), F.max(F.when((F.col("l_returnflag") == "R") & (F.col("s_acctbal") > 4000), net)).alias("label"))
        .withColumn("measure", F.lit(MEASURE))
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Latest opinion per series."""
    from structpeak.operators.labels import latest_per_key

    return latest_per_key(label_log(spark, sf), ("region", "entity", "measure", "year"), "label", "labelled_at", ("quarter",))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    from structpeak.operators.labels import with_labels

    return with_labels(results(spark, sf), labels(spark, sf)).dropna(subset=["peak_h0", "label"])


# ---------------------------------------------------------------- the same inputs as SQL

_ORDER = "ts, l_orderkey, l_linenumber, l_partkey, tie_price"
_P = 2147483647  # fixed value: modulus of the seeded draws


def residue_sql(seed: str, stream: str | int) -> str:
    s = f"CAST({stream} AS BIGINT)"
    x = f"(({seed} + {s} * 1000003) % {_P})"
    return f"((({x} * {x} + {s}) % {_P}) * 48271 + 11) % {_P}"


def uniform_sql(seed: str, stream: str | int) -> str:
    return f"((({residue_sql(seed, stream)}) + 0.5) / {_P}.0)"


def seed_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 7) AS BIGINT)"


CTES: dict[str, str] = {
    "suppliers": """
        SELECT s_suppkey, r_name AS region, CAST(s_suppkey AS VARCHAR) AS entity, s_nationkey, s_acctbal
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "readings": """
        SELECT region, entity, l_shipdate AS ts, CASE WHEN l_discount > 0 THEN l_extendedprice END AS value,
               CAST(year(l_shipdate) AS INTEGER) AS year, l_orderkey, l_linenumber, l_partkey,
               l_extendedprice AS tie_price
        FROM lineitem JOIN suppliers ON l_suppkey = s_suppkey""",
    "indexed": f"""
        SELECT *, row_number() OVER (PARTITION BY region, entity, year ORDER BY {_ORDER}) AS pos FROM readings""",
    "neighbours": """
        SELECT *,
          last_value(value IGNORE NULLS) OVER b AS pv,
          last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
          first_value(value IGNORE NULLS) OVER f AS nv,
          first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS np
        FROM indexed
        WINDOW b AS (PARTITION BY region, entity, year ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               f AS (PARTITION BY region, entity, year ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "filled": """
        SELECT region, entity, year, ts, pos, value, l_orderkey, l_linenumber, l_partkey, tie_price,
          CASE WHEN value IS NOT NULL THEN value
               WHEN pp IS NOT NULL AND np IS NOT NULL
                 THEN pv + (nv - pv) * (CAST(pos - pp AS DOUBLE) / CAST(np - pp AS DOUBLE))
               ELSE coalesce(pv, nv, 0.0) END AS filled
        FROM neighbours""",
    "scalers": """
        SELECT region, entity, year, n_good, coalesce(med, 0.0) AS median,
          coalesce(CASE WHEN hi - lo > 1e-9 THEN hi - lo WHEN sd <> 0 THEN sd ELSE 1.0 END, 1.0) AS scale
        FROM (SELECT region, entity, year, count(value) AS n_good, quantile_cont(value, 0.5) AS med,
                     quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi, stddev_pop(value) AS sd
              FROM readings GROUP BY region, entity, year)""",
    "lists": f"""
        SELECT region, entity, year, (pos - 1) // {LENGTH} AS window_id, count(*) AS size,
               list(filled ORDER BY pos) AS w, list(ts ORDER BY pos) AS t
        FROM filled GROUP BY region, entity, year, (pos - 1) // {LENGTH}
        HAVING count(*) = {LENGTH} OR (pos - 1) // {LENGTH} = 0""",
    "points": f"""
        SELECT region, entity, year, window_id, size, i, w[least(i + 1, size)] AS v, t[least(i + 1, size)] AS ts
        FROM lists, (SELECT unnest(range({LENGTH})) AS i)""",
    "zpoints": """
        SELECT p.region, p.entity, p.year, p.window_id, p.size, p.i, p.ts, p.v, s.median, s.scale,
               (p.v - s.median) / s.scale AS z
        FROM points p JOIN scalers s ON p.region = s.region AND p.entity = s.entity AND p.year = s.year""",
    "zlists": """
        SELECT region, entity, year, window_id, any_value(size) AS size, any_value(median) AS median,
               any_value(scale) AS scale, list(z ORDER BY i) AS zw
        FROM zpoints GROUP BY region, entity, year, window_id""",
    "raw_registry": """
        SELECT region, entity, m.year, m.month, m.year * 100 + m.month AS period, level
        FROM (SELECT c_nationkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
                     sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / 1000 AS level
              FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3) m
        JOIN suppliers ON m.c_nationkey = s_nationkey""",
    "months": """
        SELECT trim(region) AS region, trim(entity) AS entity, year, month, period, level,
               coalesce(level - lag(level) OVER (PARTITION BY region, entity ORDER BY period), 0.0) AS level_delta
        FROM raw_registry WHERE level IS NOT NULL""",
    "stats": """
        SELECT coalesce(avg(level), 0.0) AS level_mean,
               CASE WHEN stddev_pop(level) > 1e-9 THEN stddev_pop(level) ELSE 1.0 END AS level_std,
               CASE WHEN stddev_pop(level_delta) > 1e-9 THEN stddev_pop(level_delta) ELSE 1.0 END AS delta_std
        FROM months""",
    "results": f"""
        SELECT region, entity, year, max(value) AS peak_h0, '{MEASURE}' AS measure
        FROM readings GROUP BY region, entity, year""",
    "label_log": f"""
        SELECT region, entity, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(quarter(l_shipdate) AS INTEGER) AS quarter,
               max(l_shipdate) AS labelled_at,
               max(CASE WHEN l_returnflag = 'R' AND s_acctbal > 4000 THEN l_extendedprice * (1 - l_discount) END) AS label, '{MEASURE}' AS measure
        FROM lineitem JOIN suppliers ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4""",
    "labels": """
        SELECT region, entity, measure, year, arg_max(label, labelled_at) FILTER (WHERE label IS NOT NULL) AS label
        FROM label_log GROUP BY region, entity, measure, year""",
    "pairs": """
        SELECT r.region, r.entity, r.measure, r.year, r.peak_h0, l.label
        FROM results r JOIN labels l ON r.region = l.region AND r.entity = l.entity AND r.measure = l.measure AND r.year = l.year
        WHERE r.peak_h0 IS NOT NULL AND l.label IS NOT NULL""",
}

# What each input is built from.
NEEDS: dict[str, tuple[str, ...]] = {
    "readings": ("suppliers",), "indexed": ("readings",), "neighbours": ("indexed",), "filled": ("neighbours",),
    "scalers": ("readings",), "lists": ("filled",), "points": ("lists",), "zpoints": ("points", "scalers"),
    "zlists": ("zpoints",), "raw_registry": ("suppliers",), "months": ("raw_registry",), "stats": ("months",),
    "results": ("readings",), "label_log": ("suppliers",), "labels": ("label_log",), "pairs": ("results", "labels"),
}


def sql(inputs: tuple[str, ...], body: str, **local: str) -> str:
    """``WITH`` clause holding the inputs and everything they are built from, then the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS.get(name, ()):
            visit(n)
        if name not in order:
            order.append(name)

    for name in inputs:
        visit(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({text})" for n, text in local.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
