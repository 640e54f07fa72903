"""Year-long ten-minute series with a known structural curve, as column expressions."""

from pyspark.sql import functions as F

from structpeak.functions.draws import gaussian, key_seed, uniform

POINTS = 144 * 365


def series(spark, names, spikes=False, plateau=0.0):
    """Columns region, entity, year, ts, value, truth; one series per name."""
    rows = spark.range(0, POINTS * len(names), 1, 8).select(
        (F.col("id") % POINTS).alias("t"),
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor(F.col("id") / POINTS) + 1).cast("int")).alias("entity"),
    )
    t = F.col("t").cast("double")
    day = F.pmod(F.col("t"), F.lit(144)).cast("double")
    pi2 = 6.283185307179586
    truth = (10 + 8e-6 * t + 1.2 * F.sin(pi2 * t / POINTS)
             + 3.0 * F.greatest(F.sin(pi2 * (day - 30) / 144), F.lit(0.0)))
    seed = key_seed(F.lit("synthetic"), F.col("entity"), F.col("t"))
    value = F.col("truth") + 0.15 * gaussian(seed, 1)
    if spikes:
        value = value + F.when(uniform(seed, 3) < 0.012, 4 + 4 * uniform(seed, 4)).otherwise(0.0)
    if plateau:
        value = value + F.when((F.col("t") >= 144 * 180) & (F.col("t") < 144 * 250), F.lit(plateau)).otherwise(0.0)
    stamp = F.timestamp_add("MINUTE", (F.col("t") * 10).cast("int"), F.lit("2023-01-01 00:00:00").cast("timestamp"))
    return rows.withColumn("truth", truth).select(
        F.lit("r").alias("region"), "entity", F.lit(2023).alias("year"), stamp.alias("ts"), value.alias("value"), "truth")
