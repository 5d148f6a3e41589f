"""Changes between profile snapshots.

A table's history is folded with ``min_by`` / ``max_by`` and sums, never windowed, so a table
with very many snapshots costs one partial row per task.
"""

from __future__ import annotations

import datetime as dt
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.functions.text import short_number

COLUMNS = ["table_id", "column_name", "anomaly_type", "severity", "baseline_value", "current_value", "deviation_pct",
           "description", "suggested_action"]


def deviation_severity(pct: Column) -> Column:
    return F.when(pct < 50, "low").when(pct < 100, "medium").when(pct < 200, "high").otherwise("critical")


def _cutoff(as_of: dt.datetime, lookback_days: int) -> dt.datetime:
    if not 1 <= lookback_days <= 365:
        raise ValueError("lookback_days must be within 1..365")
    return as_of - dt.timedelta(days=lookback_days)


def _finding(when: Column, kind: str, severity: Column, baseline: Column, current: Column, deviation: Column,
             description: Column, action: str) -> Column:
    """One possible finding as a struct, NULL where the rule does not fire."""
    def number(c):
        return F.round(c.cast("double"), 4)

    return F.when(when, F.struct(
        F.lit(kind).alias("anomaly_type"), severity.alias("severity"), number(baseline).alias("baseline_value"),
        number(current).alias("current_value"), number(deviation).alias("deviation_pct"),
        description.alias("description"), F.lit(action).alias("suggested_action")))


def _listed(df: DataFrame, *findings: Column) -> DataFrame:
    """The findings that fired, one row each; all rules share one pass over ``df``."""
    return df.select("table_id", "column_name", F.inline(F.array_compact(F.array(*findings))))


def table_fold(history_df: DataFrame, as_of: dt.datetime, lookback_days: int = 30) -> DataFrame:
    """Per table: row counts within the lookback, and the latest snapshot of all time."""
    recent = F.col("created_at") >= F.lit(_cutoff(as_of, lookback_days))
    counted = F.when(recent & (F.coalesce("row_count", F.lit(0)) != 0), F.col("row_count"))
    return history_df.groupBy("table_id").agg(
        F.count(counted).alias("n"),
        F.sum(counted).alias("total"),
        F.max_by(counted, F.when(counted.isNotNull(), F.col("created_at"))).alias("current"),
        F.max_by(F.struct("last_updated", "update_frequency_hours"), "created_at").alias("latest"),
    ).withColumn("column_name", F.lit(None).cast("string"))


def _row_spike() -> Column:
    current = F.col("current")
    baseline = F.try_divide(F.col("total") - current, F.col("n") - 1)
    deviation = F.when(baseline > 0, (current - baseline) / baseline * 100).otherwise(0.0)
    text = F.format_string("Row count increased %.1f%% from %s to %s", deviation, short_number(baseline), short_number(current))
    return _finding((F.col("n") >= 2) & (deviation > 30), "row_spike", deviation_severity(deviation), baseline, current, deviation,
                    text, fixed.ACTION_ROW_SPIKE)


def _freshness_delay(as_of: dt.datetime) -> Column:
    expected = F.coalesce(F.nullif("latest.update_frequency_hours", F.lit(0.0)), F.lit(24.0))
    hours = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("latest.last_updated")) / 3_600_000_000.0
    days = hours / 24
    whole = F.floor(expected)
    shown = F.when(expected == whole, whole.cast("string")).otherwise(expected.cast("string"))
    severity = F.when(days > 7, "critical").when(days > 3, "high").otherwise("medium")
    text = F.format_string("Table should update every %sh but hasn't updated in %.1f days", shown, days)
    return _finding(F.coalesce(hours > expected * 2, F.lit(False)), "freshness_delay", severity, expected, hours,
                    (hours - expected) / expected * 100, text, fixed.ACTION_FRESHNESS)


def row_spike(history_df: DataFrame, as_of: dt.datetime, lookback_days: int = 30) -> DataFrame:
    """Latest row count more than 30 % above the mean of the earlier ones."""
    return _listed(table_fold(history_df, as_of, lookback_days), _row_spike())


def freshness_delay(history_df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Latest profile more than two expected intervals behind."""
    return _listed(table_fold(history_df, as_of), _freshness_delay(as_of))


def column_ends(history_df: DataFrame, as_of: dt.datetime, lookback_days: int = 30) -> DataFrame:
    """Earliest and latest null share and distinct count per (table, column), plus the table's span.

    The span is that of all the table's snapshots, so it travels through the fold of each column
    as a second aggregate joined on the table.
    """
    recent = history_df.filter(F.col("created_at") >= F.lit(_cutoff(as_of, lookback_days)))
    spans = recent.groupBy("table_id").agg(
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("snapshots"))
    exploded = recent.select("table_id", "created_at", F.inline("columns"))
    nulls, distinct = F.coalesce("null_percentage", F.lit(0.0)), F.coalesce("distinct_count", F.lit(0))
    folded = exploded.groupBy("table_id", F.col("name").alias("column_name")).agg(
        F.count(F.lit(1)).alias("points"),
        F.min_by(nulls, "created_at").alias("null_first"),
        F.max_by(nulls, "created_at").alias("null_last"),
        F.min_by(distinct, "created_at").alias("distinct_first"),
        F.max_by(distinct, "created_at").alias("distinct_last"),
    ).filter("points >= 2")
    days = F.floor((F.unix_micros("last_at") - F.unix_micros("first_at")) / 86_400_000_000)
    return folded.join(spans.filter("snapshots >= 2").select("table_id", days.alias("span_days")), "table_id")


def _null_increase() -> Column:
    first, last = F.col("null_first"), F.col("null_last")
    text = F.format_string("Column '%s' null %% increased from %.1f%% to %.1f%%", "column_name", first, last)
    return _finding(
        (last > first) & (last - first > 10), "null_increase",
        F.when(last > 50, "high").when(last > 25, "medium").otherwise("low"), first, last,
        F.when(first > 0, (last - first) / first * 100).otherwise(100.0), text, fixed.ACTION_NULL_INCREASE)


def _cardinality_shift() -> list[Column]:
    first, last = F.col("distinct_first"), F.col("distinct_last")
    drop = F.try_divide((first - last) * F.lit(1.0), first) * 100
    stalled = _finding(
        (first > 0) & (first == last) & (F.col("span_days") > 7), "cardinality_shift", F.lit("warning"), first, last, F.lit(0.0),
        F.format_string("Column '%s' cardinality stalled at %d values", "column_name", last), fixed.ACTION_STALL)
    dropped = _finding(
        (first > 0) & (last < first * 0.8), "cardinality_shift", F.lit("high"), first, last, -drop,
        F.format_string("Column '%s' cardinality dropped %.1f%% from %d to %d", "column_name", drop, first, last),
        fixed.ACTION_DROP)
    return [stalled, dropped]


def null_increase(ends: DataFrame) -> DataFrame:
    """Null share grown by more than 10 points."""
    return _listed(ends, _null_increase())


def cardinality_shift(ends: DataFrame) -> DataFrame:
    """Distinct counts that stood still for over 7 days, or fell below 80 %."""
    return _listed(ends, *_cardinality_shift())


def detect_anomalies(history_df: DataFrame, as_of: dt.datetime, lookback_days: int = 30) -> DataFrame:
    """All findings: one pass over table folds, one over column folds."""
    tables = _listed(table_fold(history_df, as_of, lookback_days), _row_spike(), _freshness_delay(as_of))
    columns = _listed(column_ends(history_df, as_of, lookback_days), _null_increase(), *_cardinality_shift())
    return tables.unionByName(columns)
