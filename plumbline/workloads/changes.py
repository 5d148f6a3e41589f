"""Registered jobs: history anomalies, forecasts and outliers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.operators import anomalies, forecast, profiling
from plumbline.session import cut_lineage
from plumbline.sources.tables import load
from plumbline.workloads import derived as V

AS_OF = dt.datetime(2000, 7, 10)
LOOKBACK = 365


def _history(spark, sf):
    """Monthly snapshots of the orders per priority and status, from 1995 to the as-of date.

    From spring 2000 on, large orders of two priorities lose their band, sizes collapse to one
    value and one group stops arriving, so that every kind of change occurs.
    """
    orders = load(spark, sf, "orders").filter(F.col("o_orderdate") < F.lit(dt.datetime(2000, 7, 1)))
    late = F.col("o_orderdate") >= F.lit(dt.datetime(2000, 4, 1))
    price, priority, status = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus")
    lost = late & priority.isin("1-URGENT", "3-MEDIUM") & (price > F.when(status == "F", 150000).otherwise(300000))
    gone = (priority == "5-LOW") & (status == "P") & (F.col("o_orderdate") > F.lit(dt.datetime(2000, 5, 1)))
    orders = orders.filter(~gone).select(
        F.concat_ws("/", priority, status).alias("g"),
        "o_orderdate",
        F.when(~lost, F.floor(price / 100000).cast("string")).alias("band"),
        "o_custkey",
        status.alias("status"),
        F.when(F.col("o_orderdate") < F.lit(dt.datetime(2000, 2, 1)), F.floor(price / 50000)).otherwise(F.lit(0)).alias("size"),
    )
    history = profiling.profile_history(orders, "g", "o_orderdate", cols=["band", "o_custkey", "status", "size"])
    return cut_lineage(history.withColumn("update_frequency_hours", F.when(F.endswith("table_id", F.lit("F")), 60.0)))


def anomaly_row_spike(spark, sf):
    return anomalies.row_spike(_history(spark, sf), AS_OF, LOOKBACK)


def anomaly_null_increase(spark, sf):
    return anomalies.null_increase(anomalies.column_ends(_history(spark, sf), AS_OF, LOOKBACK))


def anomaly_cardinality(spark, sf):
    return anomalies.cardinality_shift(anomalies.column_ends(_history(spark, sf), AS_OF, LOOKBACK))


def anomaly_freshness(spark, sf):
    return anomalies.freshness_delay(_history(spark, sf), AS_OF)


def anomalies_all(spark, sf):
    return anomalies.detect_anomalies(_history(spark, sf), AS_OF, LOOKBACK)


def forecast_monthly(spark, sf):
    series = V.frame(spark, sf, V.SERIES_MONTHLY)
    return forecast.forecast_linear(series, "series_id", "ds", "y").withColumn("y", F.round("y", 2))


def forecast_segments(spark, sf):
    """One monthly series per nation and market segment, fitted in one job."""
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    series = (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy(F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("series_id"),
                 F.to_date(F.date_trunc("month", "o_orderdate")).alias("ds"))
        .agg(F.sum("o_totalprice").alias("y"))
    )
    return forecast.forecast_linear(series, "series_id", "ds", "y", periods=3).withColumn("y", F.round("y", 2))


def zscore_outliers(spark, sf):
    series = load(spark, sf, "events").select("event_id", "event_type", "value")
    return forecast.zscore_outliers(series, "event_type", "value").withColumn("z_score", F.round("z_score", 5))


_HISTORY = """
base AS (SELECT o_orderpriority || '/' || o_orderstatus AS g, o_orderdate AS d,
   CASE WHEN NOT (o_orderdate >= TIMESTAMP '2000-04-01' AND o_orderpriority IN ('1-URGENT', '3-MEDIUM')
      AND o_totalprice > CASE WHEN o_orderstatus = 'F' THEN 150000 ELSE 300000 END) THEN CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR) END AS band,
   CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus AS status,
   CASE WHEN o_orderdate < TIMESTAMP '2000-02-01' THEN CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) AS VARCHAR) ELSE '0' END AS size
   FROM orders WHERE o_orderdate < TIMESTAMP '2000-07-01' AND NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P' AND o_orderdate > TIMESTAMP '2000-05-01')),
cells AS (SELECT g, d, date_trunc('month', d) + INTERVAL 1 MONTH AS created_at, unnest(['band', 'o_custkey', 'status', 'size']) AS name,
   unnest([band, o_custkey, status, size]) AS v FROM base),
snap AS (SELECT g AS table_id, created_at, count(*) AS row_count, max(d) AS last_updated,
   CASE WHEN right(g, 1) = 'F' THEN 60.0 END AS freq FROM (SELECT g, d, date_trunc('month', d) + INTERVAL 1 MONTH AS created_at FROM base) GROUP BY 1, 2, g),
colsnap AS (SELECT g AS table_id, created_at, name, round(100.0 * (count(*) - count(v)) / count(*), 6) AS null_pct, count(DISTINCT v) AS dc
   FROM cells GROUP BY 1, 2, 3),
recent AS (SELECT * FROM snap WHERE created_at >= TIMESTAMP '2000-07-10' - INTERVAL 365 DAY),
ends AS (SELECT c.table_id, name AS column_name, count(*) AS points, arg_min(null_pct, created_at) AS n0, arg_max(null_pct, created_at) AS n1,
   arg_min(dc, created_at) AS d0, arg_max(dc, created_at) AS d1, any_value(span) AS span
   FROM colsnap c JOIN (SELECT table_id, date_diff('day', min(created_at), max(created_at)) AS span, count(*) AS k FROM recent GROUP BY 1) s
     ON s.table_id = c.table_id AND s.k >= 2
   WHERE c.created_at >= TIMESTAMP '2000-07-10' - INTERVAL 365 DAY GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _short(x: str) -> str:
    return (f"CASE WHEN floor({x}) >= 1000000 THEN printf('%.1fM', floor({x}) / 1000000.0) "
            f"WHEN floor({x}) >= 1000 THEN printf('%.1fK', floor({x}) / 1000.0) ELSE CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) END")


_SPIKE = f"""
SELECT table_id, CAST(NULL AS VARCHAR) AS column_name, 'row_spike' AS anomaly_type,
   CASE WHEN dev < 50 THEN 'low' WHEN dev < 100 THEN 'medium' WHEN dev < 200 THEN 'high' ELSE 'critical' END AS severity,
   round(b, 4) AS baseline_value, round(CAST(c AS DOUBLE), 4) AS current_value, round(dev, 4) AS deviation_pct,
   printf('Row count increased %.1f%% from %s to %s', dev, {_short('b')}, {_short('c')}) AS description,
   '{fixed.ACTION_ROW_SPIKE}' AS suggested_action
FROM (SELECT *, (c - b) / b * 100 AS dev FROM (SELECT table_id, arg_max(row_count, created_at) AS c,
   (sum(row_count) - arg_max(row_count, created_at)) / (count(*) - 1)::DOUBLE AS b FROM recent GROUP BY 1 HAVING count(*) >= 2)) WHERE dev > 30"""
_NULLS = f"""
SELECT table_id, column_name, 'null_increase' AS anomaly_type, CASE WHEN n1 > 50 THEN 'high' WHEN n1 > 25 THEN 'medium' ELSE 'low' END AS severity,
   round(n0, 4) AS baseline_value, round(n1, 4) AS current_value, round(CASE WHEN n0 > 0 THEN (n1 - n0) / n0 * 100 ELSE 100.0 END, 4) AS deviation_pct,
   printf('Column ''%s'' null %% increased from %.1f%% to %.1f%%', column_name, n0, n1) AS description,
   '{fixed.ACTION_NULL_INCREASE}' AS suggested_action FROM ends WHERE n1 - n0 > 10"""
_CARDINALITY = f"""
SELECT table_id, column_name, 'cardinality_shift' AS anomaly_type, 'warning' AS severity, CAST(d0 AS DOUBLE) AS baseline_value,
   CAST(d1 AS DOUBLE) AS current_value, 0.0::DOUBLE AS deviation_pct,
   printf('Column ''%s'' cardinality stalled at %d values', column_name, d1) AS description,
   '{fixed.ACTION_STALL}' AS suggested_action FROM ends WHERE d0 > 0 AND d0 = d1 AND span > 7
UNION ALL
SELECT table_id, column_name, 'cardinality_shift', 'high', d0, d1, round(-(d0 - d1) / d0::DOUBLE * 100, 4),
   printf('Column ''%s'' cardinality dropped %.1f%% from %d to %d', column_name, (d0 - d1) / d0::DOUBLE * 100, d0, d1),
   '{fixed.ACTION_DROP}' FROM ends WHERE d0 > 0 AND d1 < d0 * 0.8"""
_FRESHNESS = f"""
SELECT table_id, CAST(NULL AS VARCHAR) AS column_name, 'freshness_delay' AS anomaly_type,
   CASE WHEN h / 24 > 7 THEN 'critical' WHEN h / 24 > 3 THEN 'high' ELSE 'medium' END AS severity,
   f AS baseline_value, round(h, 4) AS current_value, round((h - f) / f * 100, 4) AS deviation_pct,
   printf('Table should update every %sh but hasn''t updated in %.1f days', CAST(CAST(f AS BIGINT) AS VARCHAR), h / 24) AS description,
   '{fixed.ACTION_FRESHNESS}' AS suggested_action
FROM (SELECT table_id, coalesce(arg_max_null(freq, created_at), 24.0)::DOUBLE AS f,
   date_diff('microsecond', arg_max(last_updated, created_at), TIMESTAMP '2000-07-10') / 3600000000.0 AS h FROM snap GROUP BY 1)
WHERE h > 2 * f"""


def _forecast_sql(series: str, periods: int) -> str:
    return f"""
WITH s AS ({series}), n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds, y) - 1 AS x FROM s),
f AS (SELECT series_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS ic, count(*) AS n, max(ds) AS last_ds FROM n GROUP BY 1 HAVING count(*) > 1)
SELECT series_id, last_day(CAST(last_ds + to_months(CAST(k AS INTEGER)) AS DATE)) AS ds, round(ic + slope * (n + k - 1), 2) AS y
FROM f, range(1, {periods + 1}) r(k)"""


QUERIES = {
    "anomaly_row_spike": anomaly_row_spike,
    "anomaly_null_increase": anomaly_null_increase,
    "anomaly_cardinality": anomaly_cardinality,
    "anomaly_freshness": anomaly_freshness,
    "anomalies_all": anomalies_all,
    "forecast_monthly": forecast_monthly,
    "forecast_segments": forecast_segments,
    "zscore_outliers": zscore_outliers,
}

ORACLES = {
    "anomaly_row_spike": f"WITH {_HISTORY} {_SPIKE}",
    "anomaly_null_increase": f"WITH {_HISTORY} {_NULLS}",
    "anomaly_cardinality": f"WITH {_HISTORY} {_CARDINALITY}",
    "anomaly_freshness": f"WITH {_HISTORY} {_FRESHNESS}",
    "anomalies_all": f"WITH {_HISTORY} {_SPIKE} UNION ALL {_NULLS} UNION ALL {_CARDINALITY} UNION ALL {_FRESHNESS}",
    "forecast_monthly": _forecast_sql(V.SERIES_MONTHLY, 12),
    "forecast_segments": _forecast_sql(
        "SELECT c_nationkey || '/' || c_mktsegment AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, "
        "sum(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2", 3),
    "zscore_outliers": """
WITH st AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)
SELECT event_id, event_type, value, round((value - m) / s, 5) AS z_score FROM events JOIN st USING (event_type) WHERE abs((value - m) / s) > 2""",
}
