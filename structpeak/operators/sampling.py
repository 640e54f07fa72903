"""Seeded, order-independent sampling of entities, windows and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structpeak.config import SERIES_KEY
from structpeak.functions.draws import key_seed, order_digest, uniform
from structpeak.operators.hotkeys import same_key
from structpeak.operators.ordering import digest_rank, near_equal_part


def sample_entities(df: DataFrame, n: int, seed: int, entity: str = "entity") -> DataFrame:
    """``n`` distinct entities in seeded random order (a bounded top-n, never a bare limit)."""
    ids = df.select(entity).distinct()
    return ids.orderBy(order_digest(seed, F.col(entity)), entity).limit(n)


def rows_of_sample(df: DataFrame, sample: DataFrame, entity: str = "entity") -> DataFrame:
    """Rows whose entity was sampled; an id present in several regions brings all of them."""
    return df.join(sample, same_key(df, sample, [entity]), "left_semi")


def rows_outside(df: DataFrame, sample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``sample``."""
    return df.join(sample, list(keys), "left_anti")


def sample_windows(windows: DataFrame, n: int, seed: int, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """At most ``n`` windows per series, chosen by a digest of (seed, key, window).

    A ranking limit of this form is cut to ``n`` rows per series before the shuffle.
    """
    digest = order_digest(seed, *[F.col(k) for k in keys], F.col("window_id"))
    by_draw = Window.partitionBy(*keys).orderBy(digest, "window_id")
    return windows.withColumn("draw", F.row_number().over(by_draw)).where(F.col("draw") <= n)


def step_batches(df: DataFrame, steps: int, share: float, seed: int, keys: Sequence[str]) -> DataFrame:
    """For every step, the rows its mini-batch draws (each row enters a step with ``share``)."""
    numbered = df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    draw = uniform(key_seed(F.lit(str(seed)), F.col("step"), *[F.col(k) for k in keys]), 1)
    return numbered.withColumn("draw", draw).where(F.col("draw") < share)


def fold_assignment(df: DataFrame, k: int, seed: int, entity: str = "entity") -> DataFrame:
    """0-based fold of each distinct entity: seeded order cut into ``k`` near-equal parts."""
    ids = df.select(entity).distinct().withColumn("digest", order_digest(seed, F.col(entity)))
    ranked = digest_rank(ids, "digest")
    return ranked.select(entity, near_equal_part(F.col("position"), F.col("total"), k).alias("fold"))


def frozen_split(df: DataFrame, strata: Sequence[str], share: float, seed: int, entity: str = "entity") -> DataFrame:
    """Flag a fixed share of the entities of every stratum as test, by seeded order."""
    ids = df.select(entity, *strata).distinct()
    return ranked_per_stratum(ids, strata, seed, [entity]).select(
        entity, *strata, (F.col("_position") <= F.floor(F.col("_total") * share)).alias("is_test")
    )


def split_frozen(df: DataFrame, strata: Sequence[str], share: float, seed: int, entity: str = "entity") -> tuple[DataFrame, DataFrame]:
    """``(pool, test)``: the rows of the entities outside and inside the frozen test set."""
    flags = frozen_split(df, strata, share, seed, entity).select(*[F.col(c).alias(f"_f_{c}") for c in [entity, *strata]], F.col("is_test").alias("_is_test"))
    match = F.lit(True)
    for c in [entity, *strata]:
        match = match & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
    flagged = df.join(flags, match).drop(*[f"_f_{c}" for c in [entity, *strata]])
    return flagged.where(~F.col("_is_test")).drop("_is_test"), flagged.where("_is_test").drop("_is_test")


def ranked_per_stratum(df: DataFrame, strata: Sequence[str], seed: int, keys: Sequence[str], *extra: Column) -> DataFrame:
    """Adds ``_position``, seeded, inside each stratum and ``_total``; cut by digest prefix so no stratum meets in one task."""
    strata = list(strata)
    tagged = df.withColumn("_digest", order_digest(seed, *extra, *[F.col(k) for k in keys])).withColumn(
        "_bucket", F.substring("_digest", 1, 2)
    )
    sizes = tagged.groupBy(*strata, "_bucket").agg(F.count("*").alias("_rows"))
    along = Window.partitionBy(*strata).orderBy("_bucket")
    sizes = sizes.select(
        *[F.col(s).alias(f"_r_{s}") for s in [*strata, "_bucket"]],
        F.coalesce(F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    match = F.lit(True)
    for s in [*strata, "_bucket"]:
        match = match & tagged[s].eqNullSafe(sizes[f"_r_{s}"])
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_digest", *keys)
    return (
        tagged.withColumn("_inside", F.row_number().over(inside))
        .join(sizes, match, "left")
        .withColumn("_position", F.col("_inside") + F.col("_before"))
        .drop("_inside", "_before", "_digest", "_bucket", *[f"_r_{s}" for s in [*strata, "_bucket"]])
    )


def stratified_sample(df: DataFrame, strata: Sequence[str], n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """About ``n`` rows in proportion to the strata, ``round(n * share)`` of each, with their ``position``; a column of that name is refused."""
    _refuse(df, "position")
    ranked = ranked_per_stratum(df, strata, seed, keys)
    everything = df.agg(F.count("*").alias("rows")).scalar()
    chosen = ranked.where(F.col("_position") <= F.round(F.lit(float(n)) * F.col("_total") / everything)).drop("_total")
    return chosen.withColumnRenamed("_position", "position")


def _refuse(df: DataFrame, *names: str) -> None:
    taken = [n for n in names if n in df.columns]
    if taken:
        raise ValueError(f"the result adds {taken}; rename the input's columns")


def nested_chains(df: DataFrame, grid: Sequence[int], repetitions: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """Label sets that grow along ``grid``: prefixes of one seeded permutation per repetition.

    A row appears once per repetition with ``first_level``, the smallest grid size whose
    prefix holds it; a set of size n is ``first_level <= n``. Rows beyond the grid have NULL. Columns
    named ``repetition``, ``position`` or ``first_level`` are refused, all others stay.
    """
    _refuse(df, "repetition", "position", "first_level")
    repeated = df.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    ranked = ranked_per_stratum(repeated, ["repetition"], seed, keys, F.col("repetition"))
    level = F.lit(None).cast("int")
    for n in sorted(grid, reverse=True):
        level = F.when(F.col("_position") <= n, F.lit(n)).otherwise(level)
    return ranked.withColumn("first_level", level).drop("_total").withColumnRenamed("_position", "position")


def list_digest(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Order-independent digest of a list of keys, summed in two parts so no list is collected.

    Each key is hashed; the sums of two hash halves and the count identify the set.
    """
    text = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))

    def half(start: int) -> Column:
        return F.conv(F.substring(text, start, 10), 16, 10).cast("decimal(38,0)")

    aggs = [F.count("*").alias("n"), F.sum(half(1)).alias("_a"), F.sum(half(11)).alias("_b")]
    out = (df.groupBy(*by) if by else df.groupBy()).agg(*aggs)
    parts = [F.col(c).cast("string") for c in ("n", "_a", "_b")]
    return out.select(*by, "n", F.md5(F.concat_ws("|", *parts)).alias("digest"))
