"""Published result rows and their schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structpeak.config import RESULT_KEY
from structpeak.operators.merge import upsert, upsert_partitions

RESULT_SCHEMA = T.StructType([
    T.StructField("region", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("entity", T.StringType()),
    T.StructField("measure", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("peak_h0", T.DoubleType()),
    T.StructField("peak_h1", T.DoubleType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("computed_at", T.TimestampType()),
])
STAGING_H0 = ("region", "kind", "entity", "measure", "year", "peak_h0", "model_version")
STAGING_H1 = ("region", "entity", "measure", "year", "peak_h1")


def h0_records(peaks: DataFrame, measure: str, version: str, kind: str = "feeder", peak: str = "peak") -> DataFrame:
    """Staging rows of a scoring run; a peak that is not finite is NULL."""
    value = F.when(~F.isnan(peak) & (F.abs(peak) < F.lit(float("inf"))), F.col(peak))
    return peaks.withColumn("kind", F.lit(kind)).withColumn("measure", F.lit(measure)).withColumn(
        "model_version", F.lit(version)
    ).withColumn("peak_h0", value).select(*[F.col(c).cast(RESULT_SCHEMA[c].dataType) for c in STAGING_H0])


def h1_records(peaks: DataFrame, measure: str, peak: str = "peak") -> DataFrame:
    return peaks.withColumn("measure", F.lit(measure)).withColumn("peak_h1", F.col(peak)).select(
        *[F.col(c).cast(RESULT_SCHEMA[c].dataType) for c in STAGING_H1]
    )


def publish_h0(target: DataFrame, staging: DataFrame, as_of: Column) -> DataFrame:
    """Upsert of h0: earlier h1 values stay; inserted rows have no time stamp yet."""
    return upsert(
        target, staging, RESULT_KEY,
        update={"peak_h0": "peak_h0", "model_version": "model_version", "computed_at": as_of},
        insert=STAGING_H0,
    )


def publish_h1(target: DataFrame, staging: DataFrame, as_of: Column) -> DataFrame:
    """Update-only merge of h1."""
    return upsert(target, staging, RESULT_KEY, update={"peak_h1": "peak_h1", "computed_at": as_of})


RESULT_PARTITIONS = ("region", "year")


def write_results(results: DataFrame, path: str) -> None:
    """Result rows as a table partitioned by region and year, as ``publish_h0_table`` expects it."""
    results.repartition(*RESULT_PARTITIONS).write.partitionBy(*RESULT_PARTITIONS).parquet(path)


def publish_h0_table(spark: SparkSession, path: str, staging: DataFrame, as_of: Column) -> None:
    """``publish_h0`` on a stored table: partitions that the staging rows don't name are neither read nor written."""
    upsert_partitions(
        spark, path, staging, RESULT_KEY, RESULT_PARTITIONS,
        update={"peak_h0": "peak_h0", "model_version": "model_version", "computed_at": as_of}, insert=STAGING_H0,
    )


def publish_h1_table(spark: SparkSession, path: str, staging: DataFrame, as_of: Column) -> None:
    """``publish_h1`` on a stored table."""
    upsert_partitions(spark, path, staging, RESULT_KEY, RESULT_PARTITIONS, update={"peak_h1": "peak_h1", "computed_at": as_of})
