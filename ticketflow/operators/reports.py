"""Volumes over time, their anomalies, and how a pipeline of analyses fares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stl import Spans, stl


def exact_quantile(column: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def daily(rows: DataFrame, at: str, group: str, value: str) -> DataFrame:
    """(day, group, n, mean, p50, p95) of a value by day and group."""
    day = F.date_trunc("day", at).alias("day")
    return rows.groupBy(day, group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), exact_quantile(value, 0.5).alias("p50"), exact_quantile(value, 0.95).alias("p95"))


def heatmap(rows: DataFrame, at: str) -> DataFrame:
    """(weekday from 1 for Sunday, hour, n)."""
    return rows.groupBy(F.dayofweek(at).alias("weekday"), F.hour(at).alias("hour")).agg(F.count("*").alias("n"))


def analysis_rates(analyses: DataFrame) -> DataFrame:
    """One row: n, the share that was escalated, the mean confidence, and latencies that half and 95 in 100 stay within."""
    escalated = F.coalesce(F.col("escalated_to_llm"), F.lit(False)).cast("double")
    return analyses.agg(
        F.count("*").alias("n"), F.avg(escalated).alias("escalation_rate"), F.avg(F.col("confidence").cast("double")).alias("mean_confidence"),
        exact_quantile("latency_ms", 0.5).cast("int").alias("p50_ms"), exact_quantile("latency_ms", 0.95).cast("int").alias("p95_ms"),
    )


def volumes(rows: DataFrame, at: str, group: str) -> DataFrame:
    """(group, day, n); a day without rows is absent."""
    return rows.groupBy(group, F.date_trunc("day", at).alias("day")).agg(F.count("*").cast("double").alias("n"))


def robust_z(rows: DataFrame, group: str, value: str) -> DataFrame:
    """rows with z, the distance from the group's median in scaled median deviations; NULL where those are 0."""
    x = rows.join(rows.groupBy(group).agg(F.median(value).alias("__median")), group).withColumn("__off", F.col(value) - F.col("__median"))
    spread = x.groupBy(group).agg(F.median(F.abs("__off")).alias("__mad"))
    z = F.try_divide(0.6745 * F.col("__off"), F.nullif("__mad", F.lit(0.0)))
    return x.join(spread, group).withColumn("z", z).drop("__median", "__off", "__mad")


def seasonal_anomaly(days: DataFrame, group: str, around: int = 3) -> DataFrame:
    """(group, day, n, trend, season, z) of daily volumes: z of what trend and weekday leave unexplained.

    The trend is the mean of the days at most so many before and after, by the calendar; the
    season is a weekday's median distance from it. days holds a row a group and day, so a
    group's window is as long as its calendar and not as its rows.
    """
    number = F.unix_date(F.col("day").cast("date"))
    near = Window.partitionBy(group).orderBy(number).rangeBetween(-around, around)
    detrended = days.withColumn("trend", F.avg("n").over(near)).withColumn("__weekday", F.dayofweek("day")).withColumn("__left", F.col("n") - F.col("trend"))
    season = detrended.groupBy(group, "__weekday").agg(F.median("__left").alias("season"))
    rest = detrended.join(season, [group, "__weekday"]).withColumn("__rest", F.col("__left") - F.col("season"))
    return robust_z(rest, group, "__rest").select(group, "day", "n", "trend", "season", "z")


def stl_anomaly(days: DataFrame, group: str, spans: Spans = Spans()) -> DataFrame:
    """(group, day, n, trend, season, rest, weight, z) of daily volumes: z of what the decomposition leaves. NULL groups are left out."""
    return robust_z(stl(days.where(F.col(group).isNotNull()), group, spans), group, "rest")
