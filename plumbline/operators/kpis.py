"""Business questions over a fact DataFrame."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_n(df: DataFrame, dimension: str, measure: Column, n: int = 10, out: str = "value") -> DataFrame:
    """``n`` dimension values with the largest measure: aggregate, then a top-k without a full sort."""
    return df.groupBy(dimension).agg(measure.alias(out)).orderBy(F.desc(out), F.asc(dimension)).limit(n)


def last_n_months(df: DataFrame, ts: str, as_of: dt.datetime, months: int = 12) -> DataFrame:
    """Rows of the ``months`` months that end at ``as_of`` (exclusive); a plain range predicate."""
    year, month = divmod(as_of.year * 12 + as_of.month - 1 - months, 12)
    start = as_of.replace(year=year, month=month + 1)
    return df.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(as_of)))


def period_over_period(df: DataFrame, ts: str, measure: Column, period: str = "month", lag: int = 12) -> DataFrame:
    """Measure per period with its value ``lag`` calendar periods before and the change in percent.

    The data is reduced to one row per period first; the prior value is found by joining that
    small frame with itself shifted, so gaps in the calendar do not shift the comparison.
    """
    by_period = df.groupBy(F.to_date(F.date_trunc(period, F.col(ts))).alias("period")).agg(measure.alias("value"))
    shift = {"month": 1, "quarter": 3, "year": 12}[period] * lag
    prior = by_period.select(F.add_months("period", shift).alias("period"), F.col("value").alias("prior_value"))
    return by_period.join(prior, "period", "left").withColumn(
        "change_pct", (F.col("value") - F.col("prior_value")) / F.nullif("prior_value", F.lit(0)) * 100)


def change_drivers(df: DataFrame, dimension: str, measure: Column, before: Column, after: Column) -> DataFrame:
    """How much each dimension value adds to the change between two periods."""
    both = df.filter(before | after).groupBy(dimension, after.alias("__after")).agg(measure.alias("__v"))
    delta = both.groupBy(dimension).agg(
        F.sum(F.when(F.col("__after"), F.col("__v")).otherwise(-F.col("__v"))).alias("delta"))
    total = delta.agg(F.sum("delta")).scalar()
    return delta.withColumn("contribution_pct", F.col("delta") / F.nullif(total, F.lit(0)) * 100)

