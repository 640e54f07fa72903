"""Measurement tables: per-region scans, union by name and a uniform reading schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structpeak.config import SERIES_KEY
from structpeak.functions.scalars import finite


def read_region(spark: SparkSession, path: str, region: str) -> DataFrame:
    """Parquet scan of one region, tagged with its name."""
    return spark.read.parquet(path).withColumn("region", F.lit(region))


def union_regions(frames: Iterable[DataFrame]) -> DataFrame:
    """Append by column name; a column a region lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def as_readings(df: DataFrame, measure: str, names: Mapping[str, str], extra: Iterable[str] = ()) -> DataFrame:
    """Uniform readings: the chosen measure becomes ``value``, non-finite values NULL.

    ``names`` maps ``entity``, ``ts`` and ``year`` to source columns. The projection comes
    after the union, so a region without the measure contributes NULLs, and the scan still
    reads only these columns.
    """
    return df.select(
        F.col("region").cast("string").alias("region"),
        F.col(names["entity"]).cast("string").alias("entity"),
        F.col(names["ts"]).alias("ts"),
        finite(measure).alias("value"),
        F.col(names["year"]).cast("int").alias("year"),
        *extra,
    )


def read_measurements(
    spark: SparkSession, root: str, regions: Iterable[str], measure: str, names: Mapping[str, str], leaf: str = ""
) -> DataFrame:
    """Readings of several regions stored as ``root/region[/leaf]`` parquet folders."""
    parts = [read_region(spark, "/".join(p for p in (root, r, leaf) if p), r) for r in regions]
    return as_readings(union_regions(parts), measure, names)


def write_measurements(df: DataFrame, path: str) -> None:
    """Readings partitioned by region and year, so later scans prune folders."""
    df.repartition("region", "year", "entity").write.mode("overwrite").partitionBy("region", "year").parquet(path)


def catalog_table(spark: SparkSession, name: str) -> DataFrame:
    """Scan of a catalog table or view by its (multi-part) name."""
    return spark.table(name)


def save_series_table(
    df: DataFrame, name: str, buckets: int, keys: Sequence[str] = SERIES_KEY, order: Sequence[str] = ("ts",), path: str | None = None
) -> None:
    """Readings as a catalog table in buckets of the series key, sorted by key and time inside each file.

    Position, gap filling, scaling and windows of a table read by ``catalog_table`` need no exchange. Rows are dealt to
    the buckets before they are written, so a bucket is one file. ``path`` makes the table external.
    """
    dealt = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys, *order).format("parquet").mode("overwrite")
    (dealt.option("path", path) if path else dealt).saveAsTable(name)
