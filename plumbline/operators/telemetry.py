"""Rollups over query, audit and health logs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def runtime_metrics(
    log_df: DataFrame, ts: str, duration_s: str, ok: str, window: int = 1000, ties: Sequence[str] = ()
) -> DataFrame:
    """Totals over the whole log, mean latency over its last ``window`` entries.

    The latest entries come from a top-k (each task keeps ``window`` rows), not from a sort.
    """
    latest = log_df.orderBy(F.desc(ts), *[F.desc(c) for c in ties]).limit(window)
    latency = latest.agg((F.floor(F.coalesce(F.avg(duration_s), F.lit(0.0)) * 1000)).cast("long"))
    errors = F.count_if(~F.col(ok))
    total = F.count(F.lit(1))
    return log_df.agg(
        total.alias("total_queries"),
        F.coalesce(F.round(errors * 100.0 / F.nullif(total, F.lit(0)), 4), F.lit(0.0)).alias("error_rate"),
        F.when(errors < total * 0.1, "HEALTHY").otherwise("DEGRADED").alias("status"),
    ).withColumn("avg_latency_ms", latency.scalar())


def audit_report(audit_df: DataFrame, ts: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Activity between two instants; compliant when nothing was denied."""
    period = audit_df.filter(F.col(ts).between(F.lit(start), F.lit(end)))
    denied = F.count_if(F.col("access_level") == "denied")
    return period.agg(
        F.count_if(F.col("action") == "query_executed").alias("total_queries"),
        F.count_if(F.col("access_level") == "masked").alias("pii_access_events"),
        denied.alias("violations"),
        F.when(denied == 0, "COMPLIANT").otherwise("NON_COMPLIANT").alias("status"),
    )


def uptime(health_df: DataFrame) -> DataFrame:
    """Checks, share of healthy ones and 95th latency percentile per connection."""
    return health_df.groupBy("connection_id").agg(
        F.count(F.lit(1)).alias("checks"),
        (F.count_if(F.col("status") == "healthy") * 100.0 / F.count(F.lit(1))).alias("uptime_pct"),
        F.percentile_approx("latency_ms", 0.95).alias("p95_ms"),
    )


def durations(df: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float] = (10, 50, 100, 500)) -> DataFrame:
    """Cumulative duration histogram per label set."""
    return df.groupBy(*labels).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("sum_value"),
        *[F.count_if(F.col(value) <= b).alias(f"le_{b:g}") for b in bounds],
        F.percentile_approx(value, 0.95).alias("p95"),
    )
