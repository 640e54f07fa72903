"""Analytic reports: network length by month and cost per job run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from structpeak.functions.scalars import guarded_ratio, like_class, minutes_between
from structpeak.operators.joins import interval_left_join

# Compute classes by name pattern, first match wins.
ALL_PURPOSE = "All-Purpose Compute"
SERVERLESS = "Serverless Jobs"
JOB = "Job Compute"
COMPUTE_RULES = (
    ("%ALL_PURPOSE%", ALL_PURPOSE),
    ("%JOBS_SERVERLESS%", SERVERLESS),
    ("%JOBS%", JOB),
)
RUN_KEY = ("job_id", "job_name", "job_owner", "job_run_id", "usage_date")


def network_by_month(parts: DataFrame, circuit: str = "circuit", year: str = "year", month: str = "month", length: str = "length") -> DataFrame:
    """Network length in thousands per circuit and month, ordered by month and circuit."""
    return parts.groupBy(circuit, year, month).agg((F.sum(length) / 1000).alias("km")).orderBy(year, month, circuit)


def latest_jobs(jobs: DataFrame, workspace: Column, owner: Column, tie: tuple[str, ...] = ()) -> DataFrame:
    """Newest version of every job of one workspace and owner."""
    newest = Window.partitionBy("workspace_id", "job_id").orderBy(F.col("change_time").desc(), *[F.col(t).desc() for t in tie])
    chosen = jobs.where((F.col("workspace_id") == workspace) & (F.col("creator_user_name") == owner))
    return (
        chosen.withColumn("_version", F.row_number().over(newest)).where(F.col("_version") == 1)
        .select("workspace_id", "job_id", F.col("name").alias("job_name"), F.col("creator_user_name").alias("job_owner"))
    )


def priced_usage(usage: DataFrame, prices: DataFrame, workspace: Column, start: Column, end: Column, small: bool | None = None) -> DataFrame:
    """Usage of jobs in the period with the unit price valid when it started."""
    wanted = usage.where(
        (F.col("workspace_id") == workspace) & F.col("usage_metadata.job_id").isNotNull()
        & F.col("usage_date").between(start, end)
    ).select(
        "workspace_id", "usage_date", "sku_name", "usage_unit", "usage_start_time", "usage_quantity",
        F.col("usage_metadata.job_id").alias("job_id"), F.col("usage_metadata.job_run_id").alias("job_run_id"),
    )
    listed = prices.select("sku_name", "usage_unit", "price_start_time", "price_end_time",
                           F.col("pricing").getField("default").alias("price_per_unit"))
    return interval_left_join(
        wanted, listed, ["sku_name", "usage_unit"], "usage_start_time", "price_start_time", "price_end_time", small
    ).drop("price_start_time", "price_end_time", "usage_start_time", "usage_unit")


def cost_by_compute(jobs: DataFrame, priced: DataFrame) -> DataFrame:
    """Cost of every run, day and compute class."""
    classed = priced.withColumn("compute_type", like_class(F.col("sku_name"), COMPUTE_RULES))
    per_run = classed.groupBy("workspace_id", "job_id", "job_run_id", "usage_date", "compute_type").agg(
        F.sum(F.col("usage_quantity") * F.col("price_per_unit")).alias("run_cost")
    )  # summed before the join: runs, not usage records, are shuffled
    return jobs.join(per_run, ["job_id", "workspace_id"], "inner").select(*RUN_KEY, "compute_type", "run_cost")


def cost_pivot(costs: DataFrame) -> DataFrame:
    """One row per run and day with a column per compute class and the total."""
    def of(name: str) -> Column:
        return F.sum(F.when(F.col("compute_type") == name, F.col("run_cost")).otherwise(F.lit(0.0)))

    return costs.groupBy(*RUN_KEY).agg(
        of(ALL_PURPOSE).alias("cost_all_purpose"), of(JOB).alias("cost_job_compute"),
        of(SERVERLESS).alias("cost_serverless"), F.sum("run_cost").alias("total_cost_run"),
    )


def predominant(costs: DataFrame) -> DataFrame:
    """Class with the largest cost; equal costs go to the class named first."""
    a, j, s = F.col("cost_all_purpose"), F.col("cost_job_compute"), F.col("cost_serverless")
    pick = F.when((a >= j) & (a >= s), ALL_PURPOSE).when((j >= a) & (j >= s), JOB).otherwise(SERVERLESS)
    return costs.withColumn("predominant_compute", pick)


def run_durations(timeline: DataFrame, workspace: Column) -> DataFrame:
    """Start, end and summed minutes of every run; open periods count zero."""
    wall_clock = isinstance(timeline.schema["period_start_time"].dataType, TimestampNTZType)
    minutes = minutes_between(F.col("period_start_time"), F.col("period_end_time"), wall_clock)
    return timeline.where(F.col("workspace_id") == workspace).groupBy("job_id", F.col("run_id").alias("job_run_id")).agg(
        F.min("period_start_time").alias("run_start_time"),
        F.max("period_end_time").alias("run_end_time"),
        F.sum(F.coalesce(minutes, F.lit(0.0))).alias("duration_minutes"),
    )


def with_compute_change(runs: DataFrame) -> DataFrame:
    """Previous predominant class of the job and whether it changed; a first run did not.

    Runs are compared inside a job's day and the last run of the earlier day is carried in,
    so a job with very many runs is spread over its days.
    """
    in_day = Window.partitionBy("job_id", "usage_date").orderBy("job_run_id")
    last = runs.groupBy(F.col("job_id").alias("_job"), F.col("usage_date").alias("_day")).agg(
        F.max_by("predominant_compute", "job_run_id").alias("_last")
    )
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy("_job").orderBy("_day"))).drop("_last")
    match = F.col("job_id").eqNullSafe(F.col("_job")) & F.col("usage_date").eqNullSafe(F.col("_day"))
    previous = F.when(F.col("_place") == 1, F.col("_carried")).otherwise(F.col("_previous"))
    return (
        runs.withColumn("_place", F.row_number().over(in_day))
        .withColumn("_previous", F.lag("predominant_compute").over(in_day))
        .join(carried, match, "left")
        .withColumn("previous_predominant_compute", previous)
        .withColumn("compute_type_changed", F.coalesce(
            F.col("predominant_compute") != F.col("previous_predominant_compute"), F.lit(False)))
        .drop("_place", "_previous", "_carried", "_job", "_day")
    )


def job_cost_report(
    jobs: DataFrame, usage: DataFrame, prices: DataFrame, timeline: DataFrame,
    workspace: Column, owner: Column, start: Column, end: Column, tie: tuple[str, ...] = (), small: bool | None = None,
) -> DataFrame:
    """Cost, duration and compute class of every job run of one owner, with class changes."""
    priced = priced_usage(usage, prices, workspace, start, end, small)
    costs = predominant(cost_pivot(cost_by_compute(latest_jobs(jobs, workspace, owner, tie), priced)))
    timed = costs.join(run_durations(timeline, workspace), ["job_id", "job_run_id"], "left").withColumn(
        "cost_per_minute", guarded_ratio(F.col("total_cost_run"), F.col("duration_minutes"))
    )
    return with_compute_change(timed).select(
        "job_id", "job_name", "job_owner", "job_run_id", "usage_date", "run_start_time", "run_end_time",
        "duration_minutes", "cost_all_purpose", "cost_job_compute", "cost_serverless", "total_cost_run",
        "cost_per_minute", "predominant_compute", "previous_predominant_compute", "compute_type_changed",
    ).orderBy("job_id", "usage_date", "job_run_id")
