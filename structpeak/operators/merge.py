"""Upserts of result rows as snapshot rewrites, of whole tables or of the partitions that change.

Keys compare with plain equality, so a row with a NULL key part never matches. A salt, zero for
rows whose key is known, keeps such rows out of one reducer; each side is read once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Most partitions that are named one by one; a source that touches more rewrites the table.
NAMED_PARTITIONS = 10_000


def _salted(df: DataFrame, keys: Sequence[str], sign: int) -> DataFrame:
    """Adds ``_salt``: 0 where the key is known, else a hash of the row with the side's sign."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.withColumn("_salt", F.when(known, F.lit(0)).otherwise(F.lit(sign) * (F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30)).cast("int") + 1)))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` again, failing at run time when a fully known key occurs twice."""
    return _checked(_salted(df, keys, 1), keys).drop("_salt")


def _checked(salted: DataFrame, keys: Sequence[str]) -> DataFrame:
    text = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    failed = F.raise_error(F.concat(F.lit("duplicate merge source key: "), text)).cast("boolean")
    times = F.count("*").over(Window.partitionBy(*keys, "_salt"))
    counted = salted.withColumn("_times", times)
    return counted.where(F.when((F.col("_salt") == 0) & (F.col("_times") > 1), failed).otherwise(F.lit(True))).drop("_times")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Mapping[str, Column | str],
    insert: Sequence[str] = (),
) -> DataFrame:
    """The target after matching rows were updated and the others of the source inserted.

    ``update`` maps target columns to a source column name or an expression; a matched row
    takes it even when it is NULL. Target columns not named keep their value. ``insert``
    lists the source columns a new row takes (others are NULL); empty means update only.
    """
    keys = list(keys)
    s = _checked(_salted(source, keys, 1), keys)
    values = [c for c in source.columns if c not in keys]
    s = s.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_salt").alias("_k__salt"), F.struct(*values).alias("_s"))
    d = _salted(target, keys, -1).withColumn("_in_target", F.lit(True))
    equal = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in [*keys, "_salt"]])
    joined = d.join(s, equal, "full_outer" if insert else "left")
    matched = F.col("_in_target").isNotNull() & F.col("_s").isNotNull()
    fresh = F.col("_in_target").isNull()
    types = {f.name: f.dataType for f in target.schema.fields}

    def final(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(c), F.col(f"_k_{c}")).cast(types[c]).alias(c)
        out = F.col(c)
        if c in update:
            new = update[c]
            new = F.col("_s")[new] if isinstance(new, str) else new
            out = F.when(matched, new).otherwise(out)
        if c in insert:
            out = F.when(fresh, F.col("_s")[c]).otherwise(out)
        return out.cast(types[c]).alias(c)

    return joined.select(*[final(c) for c in target.columns])


def touched_partitions(source: DataFrame, columns: Sequence[str]) -> Column | None:
    """Predicate for the partitions the source has rows in; None where they are too many to name."""
    first, *rest = columns
    found = source.select(*columns).distinct().limit(NAMED_PARTITIONS + 1).collect()
    if len(found) > NAMED_PARTITIONS:
        return None
    by_first: dict = {}
    for r in found:
        by_first.setdefault(r[first], []).append(r)
    out = F.lit(False)
    for value, rows in by_first.items():
        inner = F.lit(not rest)
        if len(rest) == 1:
            values = [r[rest[0]] for r in rows]
            inner = F.col(rest[0]).isin([v for v in values if v is not None])
            inner = inner | F.col(rest[0]).isNull() if None in values else inner
        elif rest:
            inner = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c])) for c in rest]) for r in rows])
        out = out | (F.col(first).eqNullSafe(F.lit(value)) & inner)
    return out


def upsert_partitions(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: Sequence[str],
    partition_by: Sequence[str],
    update: Mapping[str, Column | str],
    insert: Sequence[str] = (),
) -> None:
    """Upsert into a parquet table partitioned by some of its keys: only partitions named by the source are read and written.

    Spark stages the new files beside the table and swaps whole partitions when the job has ended, so readers never see half a
    partition; running the same source again gives the same rows (those whose key is not fully known match nothing and come again). Partitions that only an update-only source names stay absent.
    """
    if not set(partition_by) <= set(keys):
        raise ValueError("partition columns must be keys, or a row could change its partition")
    target = spark.read.parquet(path)
    inferred = [c for c in partition_by if target.schema[c].dataType != source.schema[c].dataType]  # folder names tell no types
    target = target.withColumns({c: F.col(c).cast(source.schema[c].dataType) for c in inferred})
    named = touched_partitions(source, partition_by)
    part = target if named is None else target.where(named)
    merged = upsert(part, source, keys, update, insert)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
