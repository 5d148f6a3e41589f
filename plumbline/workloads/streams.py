"""Registered jobs: streams over the events table, run to completion and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.session import work_path
from plumbline.sources.kafka import file_stream
from plumbline.sources.tables import load
from plumbline.streaming import cdc, live, sinks
from plumbline.workloads import derived as V

ROW = "user_id bigint, event_type string, value double"


BATCHES, FILES = 5, 4


def _events_stream(spark, sf, disturbed: bool = False):
    """The events as a stream of five micro-batches in the order of time.

    ``disturbed``: every tenth event of the second batch comes again with the third, and every 211th of the first two comes with the last.
    """
    events = load(spark, sf, "events")
    lo, hi = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    placed = events.withColumn("slot", F.floor(BATCHES * (F.unix_micros("ts") - lo) / (hi - lo + 1)).cast("int"))  # fifth of the time span
    if disturbed:
        late = (F.col("slot") <= 1) & (F.col("event_id") % 211 == 0)
        again = placed.where((F.col("slot") == 1) & (F.col("event_id") % 10 == 0) & ~late).withColumn("slot", F.lit(2))
        placed = placed.withColumn("slot", F.when(late, BATCHES - 1).otherwise(F.col("slot"))).unionByName(again)
    folder = work_path(spark, "events")
    for slot in range(BATCHES):
        placed.where(F.col("slot") == slot).drop("slot").repartition(FILES).write.parquet(f"{folder}/{slot}")
    return spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", FILES).parquet(folder)


def _feed_folder(spark, sf):
    """The change feed as JSON lines in several files, as a topic would deliver it, with faulty messages among them."""
    feed = V.frame(spark, sf, V.CDC_FEED)
    row = F.struct("user_id", "event_type", "value")
    nothing = F.when(F.lit(False), row)
    texts = feed.repartitionByRange(6, "epoch", "feed_offset").select(F.to_json(F.struct(
        F.when(F.col("op") != "i", row).otherwise(nothing).alias("before"),
        F.when(F.col("op") != "d", row).otherwise(nothing).alias("after"),
        "op", "feed_offset", "epoch")).alias("value"))
    path = work_path(spark, "feed")
    texts.write.text(path)
    V.frame(spark, sf, V.CDC_FAULTS).select("value").write.mode("append").text(path)
    return path


def cdc_changes(spark, sf):
    out = work_path(spark, "changes")
    changes = cdc.cdc_changes(file_stream(spark, _feed_folder(spark, sf), 2), ROW, keys=["user_id"], with_epoch=True)
    sinks.run_available_now(changes, sinks.batch_folder(out), work_path(spark, "checkpoint"))
    return spark.read.parquet(out).drop("batch_id")


def cdc_rejects(spark, sf):
    out = work_path(spark, "rejects")
    rejects = cdc.cdc_rejects(file_stream(spark, _feed_folder(spark, sf), 4), ROW, keys=["user_id"])
    sinks.run_available_now(rejects, sinks.batch_folder(out), work_path(spark, "checkpoint"))
    return spark.read.parquet(out).select("value", "reason")


def cdc_current_state(spark, sf):
    """Several micro-batches with compaction of the buckets that reach two deltas, unused files removed, then the merged state."""
    table = cdc.apply_cdc(file_stream(spark, _feed_folder(spark, sf), 4), ["user_id"], work_path(spark, "state"), work_path(spark, "checkpoint"),
                          compact_every=2, row_schema=ROW, rejects_dir=work_path(spark, "rejects"), buckets=4)
    table.vacuum()
    return table.current()


def stream_kpi_hourly(spark, sf):
    out = work_path(spark, "kpis")
    kpis = live.live_kpis(_events_stream(spark, sf, disturbed=True), "ts", "event_type", "value", unique="event_id")
    sinks.run_available_now(kpis, sinks.batch_folder(out), work_path(spark, "checkpoint"), mode="update")
    latest = sinks.latest_rows(spark.read.parquet(out), ["window_start", "window_end", "metric"])
    return latest.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "metric", "n",
                         F.round("total", 2).alias("total"), F.round("mean", 7).alias("mean"))


def stream_anomalies(spark, sf):
    out = work_path(spark, "scored")
    live.stream_anomalies(_events_stream(spark, sf, disturbed=True), "event_type", "ts", "value", work_path(spark, "sums"), out,
                          work_path(spark, "checkpoint"), unique="event_id", lateness=2)
    return spark.read.parquet(out).select("event_id", F.round("z_score", 4).alias("z_score"), "is_anomaly")


def rolling_anomalies(spark, sf):
    scored = live.rolling_anomalies(load(spark, sf, "events"), "event_type", "ts", "value", hours=6, threshold=2.5)
    return scored.select("event_id", F.round("z_score", 4).alias("z_score"), "is_anomaly")


def stream_threshold(spark, sf):
    out = work_path(spark, "outside")
    sinks.run_available_now(live.threshold_anomalies(_events_stream(spark, sf), "value", low=1.0, high=150.0),
                            sinks.batch_folder(out), work_path(spark, "checkpoint"))
    return spark.read.parquet(out).select("event_id", "value")


def stream_masked(spark, sf):
    out = work_path(spark, "masked")
    renamed = _events_stream(spark, sf).select("event_id", F.col("props").alias("token"), F.col("event_type").alias("full_name"), "value")
    sinks.run_available_now(live.mask_stream(renamed), sinks.batch_folder(out), work_path(spark, "checkpoint"))
    return spark.read.parquet(out).drop("batch_id")


def _rolling_sql(hours: int, threshold: float) -> str:
    return f"""
WITH h AS (SELECT event_type AS k, date_trunc('hour', ts) AS hr, count(*) AS n, sum(value) AS s, sum(value * value) AS ss FROM events GROUP BY 1, 2),
st AS (SELECT k, hr + to_hours(CAST(i AS INTEGER)) AS hr, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM h, range(1, {hours} + 1) r(i) GROUP BY 1, 2),
z AS (SELECT event_id, (value - s / n) / nullif(sqrt(greatest((ss - s * s / n) / nullif(n - 1, 0), 0)), 0) AS z FROM events
  LEFT JOIN st ON k = event_type AND hr = date_trunc('hour', ts))
SELECT event_id, round(z, 4) AS z_score, coalesce(abs(z) > {threshold}, false) AS is_anomaly FROM z"""


QUERIES = {
    "cdc_changes": cdc_changes,
    "cdc_rejects": cdc_rejects,
    "cdc_current_state": cdc_current_state,
    "stream_kpi_hourly": stream_kpi_hourly,
    "stream_anomalies": stream_anomalies,
    "rolling_anomalies": rolling_anomalies,
    "stream_threshold": stream_threshold,
    "stream_masked": stream_masked,
}

_FEED = V.duck(V.CDC_FEED)
# what is left once repeats and rows behind the watermark are gone
_DELIVERED = f"""
e AS (SELECT events.* FROM events, (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events)
  WHERE NOT ({BATCHES} * (epoch_us(ts) - lo) // (hi - lo + 1) <= 1 AND event_id % 211 = 0))"""
ORACLES = {
    "cdc_changes": f"SELECT op, feed_offset, user_id, event_type, value, cast(epoch AS BIGINT) AS epoch FROM {_FEED}",
    "cdc_rejects": f"SELECT value, reason FROM {V.duck(V.CDC_FAULTS)}",
    "cdc_current_state": f"""
WITH last AS (SELECT * FROM {_FEED} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch DESC, feed_offset DESC) = 1)
SELECT user_id, feed_offset, event_type, value FROM last WHERE op <> 'd'""",
    "stream_kpi_hourly": f"""
WITH {_DELIVERED} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS metric, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 7) AS mean FROM e GROUP BY 1, 2""",
    "stream_anomalies": f"""
WITH {_DELIVERED},
st AS (SELECT a.event_id, avg(b.value) AS mean, stddev_samp(b.value) AS std FROM e a JOIN e b ON b.event_type = a.event_type
  AND b.ts < date_trunc('hour', a.ts) AND b.ts >= date_trunc('hour', a.ts) - INTERVAL 24 HOUR GROUP BY 1)
SELECT e.event_id, round((value - mean) / nullif(std, 0), 4) AS z_score, coalesce(abs((value - mean) / nullif(std, 0)) > 3.0, false) AS is_anomaly FROM e LEFT JOIN st USING (event_id)""",
    "rolling_anomalies": _rolling_sql(6, 2.5),
    "stream_threshold": "SELECT event_id, value FROM events WHERE value < 1.0 OR value > 150.0",
    "stream_masked": "SELECT event_id, '****' AS token, '****' AS full_name, value FROM events",
}
