"""Trend forecasts and outliers over many series at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.ordered import row_numbers


def forecast_linear(df: DataFrame, series: str, ds: str, y: str, periods: int = 12) -> DataFrame:
    """Least-squares line through each series, read off at the next ``periods`` month ends.

    Points are numbered 0, 1, 2 ... by date with the segment-wise numbering, so one very long
    series does not end up in one task; the fit itself is a map-side-combined aggregate. A series
    with a single point has no slope and yields nothing.
    """
    points = df.select(F.col(series).alias("series_id"), F.col(ds).cast("date").alias("ds"), F.col(y).cast("double").alias("y"))
    numbered = row_numbers(points, ["series_id"], "ds", ties=["y"], out="rn")
    x = (F.col("rn") - 1).cast("double")
    fit = numbered.groupBy("series_id").agg(
        F.regr_slope("y", x).alias("slope"),
        F.regr_intercept("y", x).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
        F.max("ds").alias("last_ds"),
    ).filter(F.col("slope").isNotNull())
    ahead = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("k"))
    return ahead.select(
        "series_id",
        F.last_day(F.add_months("last_ds", F.col("k"))).alias("ds"),
        (F.col("intercept") + F.col("slope") * (F.col("n") + F.col("k") - 1)).alias("y"),
    )


def zscore_outliers(df: DataFrame, series: str, y: str, threshold: float = 2.0) -> DataFrame:
    """Rows further than ``threshold`` sample deviations from their series' mean.

    Mean and deviation are aggregated first; the join lets Spark broadcast them when they are
    small and split hot series when they are not.
    """
    stats = df.groupBy(F.col(series).alias("__series")).agg(
        F.avg(y).alias("__mean"), F.stddev_samp(y).alias("__std")).filter("__std > 0")
    z = (F.col(y) - F.col("__mean")) / F.col("__std")
    return (
        df.join(stats, F.col(series) == F.col("__series"))
        .withColumn("z_score", z)
        .filter(F.abs("z_score") > threshold)
        .drop("__series", "__mean", "__std")
    )
