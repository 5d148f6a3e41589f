"""Live KPIs, stream anomalies and in-stream masking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.masks import redact_stream
from plumbline.session import exists, remove
from plumbline.streaming.sinks import run_available_now


def once(stream: DataFrame, ts: str, unique: str, watermark: str) -> DataFrame:
    """Each row of a stream once, however often it is delivered; rows behind the watermark are dropped, and so are the keys kept to tell."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([unique])


def live_kpis(
    stream: DataFrame, ts: str, metric: str, value: str, window: str = "1 hour", watermark: str = "2 hours", unique: str | None = None
) -> DataFrame:
    """Count, sum and mean per metric and tumbling window; rows behind the watermark are dropped, and repeats of a ``unique`` id."""
    return (
        (once(stream, ts, unique, watermark) if unique else stream.withWatermark(ts, watermark))
        .groupBy(F.window(ts, window), F.col(metric).alias("metric"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "metric", "n", "total", "mean")
    )


def threshold_anomalies(stream: DataFrame, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows outside fixed bounds; stateless, so it works on any stream."""
    outside = F.lit(False)
    if low is not None:
        outside = outside | (F.col(value) < low)
    if high is not None:
        outside = outside | (F.col(value) > high)
    return stream.filter(outside)


def hourly_moments(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Count, mean and sum of squared deviations; these merge without cancelling, unlike sums of squares."""
    return df.groupBy(F.col(key).alias("key"), F.date_trunc("hour", ts).alias("hour")).agg(
        F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).cast("double").alias("mean"),
        F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("m2"))


def merge_moments(df: DataFrame, *keys) -> DataFrame:
    """One (n, mean, m2) for each of ``keys``; a group holds hours or batches, not rows."""
    def step(a, b):
        n = a["n"] + b["n"]
        delta = b["mean"] - a["mean"]
        share = F.when(n > 0, b["n"] / n).otherwise(F.lit(0.0))
        return F.struct(n.alias("n"), (a["mean"] + delta * share).alias("mean"), (a["m2"] + b["m2"] + delta * delta * a["n"] * share).alias("m2"))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    parts = F.sort_array(F.collect_list(F.struct("n", "mean", "m2")))
    names = df.select(*keys).columns
    return df.groupBy(*keys).agg(F.aggregate(parts, none, step).alias("__m")).select(*names, "__m.*")


def score_rolling(
    df: DataFrame, hourly: DataFrame, key: str, ts: str, value: str, hours: int = 24, threshold: float = 3.0
) -> DataFrame:
    """z-score of each row against the ``hours`` full hours before its own.

    Hourly moments are spread to the hours they serve and folded, then joined on (key, hour): no
    row-by-row window, so a key with a third of all rows is split by hour.
    """
    serves = F.explode(F.sequence(F.lit(1), F.lit(hours))).alias("k")
    stats = (
        merge_moments(hourly.select("key", "hour", "n", "mean", "m2", serves), "key",
                      F.timestamp_seconds(F.unix_seconds("hour") + F.col("k") * 3600).alias("hour"))
        .select("key", "hour", F.when(F.col("n") > 0, F.col("mean")).alias("__mean"),
                F.sqrt(F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0))).alias("__std"))
    )
    z = (F.col(value) - F.col("__mean")) / F.nullif("__std", F.lit(0.0))
    scored = df.withColumn("__hour", F.date_trunc("hour", ts)).join(
        stats, (F.col(key) == F.col("key")) & (F.col("__hour") == F.col("hour")), "left")
    return scored.withColumn("z_score", z).withColumn("is_anomaly", F.coalesce(F.abs("z_score") > threshold, F.lit(False))).drop(
        "key", "hour", "__hour", "__mean", "__std")


def rolling_anomalies(df: DataFrame, key: str, ts: str, value: str, hours: int = 24, threshold: float = 3.0) -> DataFrame:
    """Batch form of the rolling check."""
    return score_rolling(df, hourly_moments(df, key, ts, value), key, ts, value, hours, threshold)


def stream_anomalies(
    stream: DataFrame, key: str, ts: str, value: str, state_dir: str, out_dir: str, checkpoint: str,
    hours: int = 24, threshold: float = 3.0, unique: str | None = None, lateness: int | None = None,
) -> None:
    """Rolling check over micro-batches against one table of hourly moments.

    A batch is folded to moments (map-side, so a hot key costs a task no more than others), merged into the state of the batch before, and
    scored by a join on key and hour. The state of a batch is a folder by its id: a retried batch starts from the one before and overwrites
    its own; older ones are removed. With ``lateness`` (hours) the state of a batch holds its own hours and those before that its rows can look at,
    keys times ``hours + lateness``. ``unique`` names an id by which repeats in that span are dropped, and rows further behind the newest one seen.
    """
    spark = stream.sparkSession
    if unique is not None:
        if lateness is None:
            raise ValueError("repeats are told apart within a lateness")
        stream = once(stream, ts, unique, f"{lateness} hours")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            moments, before = hourly_moments(batch, key, ts, value), f"{state_dir}/v{batch_id - 1}"
            if exists(spark, before):
                held = spark.read.parquet(before)
                newest = held.agg(F.max("hour")).first()[0] if lateness is not None else None
                if newest is not None:  # rows of this batch are at most so late, and look back so far
                    held = held.filter(F.col("hour") >= F.lit(newest) - F.make_interval(hours=F.lit(hours + lateness + 1)))
                moments = merge_moments(moments.unionByName(held), "key", "hour")
            state = f"{state_dir}/v{batch_id}"
            moments.write.mode("overwrite").parquet(state)
            score_rolling(batch, spark.read.parquet(state), key, ts, value, hours, threshold).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
            remove(spark, [f"{state_dir}/v{batch_id - 2}"])
        finally:
            batch.unpersist()

    run_available_now(stream, handle, checkpoint)


def mask_stream(stream: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Masks sensitive-named columns of a stream (optionally after a projection); stateless."""
    return redact_stream(stream if columns is None else stream.select(*columns))
