"""Registered jobs: profiling, quality, history anomalies, forecasts and outliers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.operators import profiling, quality
from plumbline.operators.profile_store import ProfileStore
from plumbline.session import work_path
from plumbline.sources.tables import load

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
AS_OF = dt.datetime(2024, 2, 1)
AS_OF_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


def _profile_sql(table: str, cols: list[str], wrap: dict[str, str] | None = None) -> str:
    wrap = wrap or {}
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(*) AS total, count({wrap.get(c, c)}) AS non_null, "
        f"count(*) - count({wrap.get(c, c)}) AS null_count, count(DISTINCT {wrap.get(c, c)}) AS distinct_count, "
        f"round(count(DISTINCT {wrap.get(c, c)}) / count(*), 6) AS cardinality FROM {table}" for c in cols)


def profile_lineitem(spark, sf):
    return profiling.profile_columns(load(spark, sf, "lineitem"))


def profile_orders(spark, sf):
    """Two columns carry derived NULLs, as the given tables hold none."""
    orders = load(spark, sf, "orders").withColumn(
        "o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    ).withColumn("o_custkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")))
    return profiling.profile_columns(orders)


def profile_rowcount(spark, sf):
    return profiling.row_count(load(spark, sf, "lineitem"))


def profile_sampled(spark, sf):
    lineitem = load(spark, sf, "lineitem")
    total = profiling.row_count(lineitem).first()[0]
    return profiling.profile_columns(lineitem, sample=profiling.sample_fraction(total))


def profile_hash_sample(spark, sf):
    """The profile of about 10,000 line items, picked by a hash of their keys."""
    lineitem = load(spark, sf, "lineitem")
    share = profiling.sample_fraction(profiling.row_count(lineitem).first()[0])
    return profiling.profile_columns(profiling.hash_sample(lineitem, ["l_orderkey", "l_linenumber"], share))


def profile_approx_holds(spark, sf):
    """Approximate distinct counts held against exact ones: within 15 %, three standard errors of the default sketch."""
    lineitem = load(spark, sf, "lineitem")
    exact = profiling.profile_columns(lineitem).select("column_name", F.col("distinct_count").alias("d"))
    found = profiling.profile_columns(lineitem, approx=True).join(exact, "column_name")
    return found.select("column_name", "total", "non_null", "null_count", (F.abs(F.col("distinct_count") - F.col("d")) <= 0.15 * F.col("d")).alias("distinct_holds"))


def profile_approx(spark, sf):
    return profiling.profile_columns(load(spark, sf, "lineitem"), approx=True)


def _orders_by_year(spark, sf):
    return load(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))


def profile_refresh(spark, sf):
    """A stored profile of orders by year; the last year comes later and is all that the second refresh reads. Sketches are held against exact counts."""
    path, orders = work_path(spark, "orders-by-year"), _orders_by_year(spark, sf)
    last = orders.agg(F.max("year")).first()[0]
    store = ProfileStore(spark, work_path(spark, "profile"), ["year"])
    orders.where(F.col("year") < last).write.partitionBy("year").parquet(path)
    store.refresh(spark.read.parquet(path))
    orders.where(F.col("year") == last).write.mode("append").partitionBy("year").parquet(path)
    read = store.refresh(spark.read.parquet(path))
    store.vacuum()
    exact = profiling.profile_columns(orders.drop("year")).select("column_name", F.col("distinct_count").alias("d"))
    close = F.abs(F.col("distinct_count") - F.col("d")) <= 0.08 * F.col("d")
    return store.profile().join(exact, "column_name").select(
        "column_name", "total", "non_null", "null_count", F.when(F.col("avg_value").isNotNull(), F.round("min_value", 2)).alias("min_value"),
        F.when(F.col("avg_value").isNotNull(), F.round("max_value", 2)).alias("max_value"), F.round("avg_value", 4).alias("avg_value"), "min_text", "max_text", close.alias("distinct_holds"),
        F.lit(read).cast("long").alias("rows_read_last"))


def profile_refresh_top(spark, sf):
    """Most frequent values of the narrow columns, from counters merged over years."""
    path = work_path(spark, "orders-by-year")
    _orders_by_year(spark, sf).select("year", "o_orderstatus", "o_orderpriority").write.partitionBy("year").parquet(path)
    store = ProfileStore(spark, work_path(spark, "profile"), ["year"])
    store.refresh(spark.read.parquet(path))
    return store.top_values(10)


def top_values_orders(spark, sf):
    return profiling.top_values(load(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


def profile_minmaxavg(spark, sf):
    lineitem = load(spark, sf, "lineitem")
    ranged = profiling.column_ranges(lineitem, ["l_orderkey", "l_quantity", "l_linenumber", "l_returnflag"])
    return ranged.withColumn("freshness", F.date_format(profiling.freshest(lineitem, "l_shipdate").scalar(), "yyyy-MM-dd"))


def profile_histogram(spark, sf):
    return profiling.histogram(load(spark, sf, "lineitem"), "l_quantity", bins=7).select(
        "bin", F.round("x", 6).alias("x"), "y")


def completeness_percent(spark, sf):
    orders = load(spark, sf, "orders").withColumn("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")))
    done = profiling.completeness_percent(profiling.profile_columns(orders, ["o_orderkey", "o_orderstatus"]))
    return done.select(F.round("completeness_percent", 4).alias("completeness_percent"))


def profile_history_monthly(spark, sf):
    history = profiling.profile_history(load(spark, sf, "orders"), F.col("o_orderpriority"), "o_orderdate",
                                        cols=["o_custkey", "o_orderstatus"])
    return history.select(
        "table_id", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"),
        F.date_format("last_updated", "yyyy-MM-dd").alias("last_updated"), "row_count",
        F.inline("columns"),
    ).withColumnRenamed("name", "column_name")


def _scored(spark, sf, with_links=False):
    lineitem, orders = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    customer, events = load(spark, sf, "customer"), load(spark, sf, "events")
    part = load(spark, sf, "part").withColumn("p_size", F.when(F.col("p_size") % 10 != 0, F.col("p_size")))
    links = [("l_orderkey", orders, "o_orderkey")] if with_links else []
    return {
        "lineitem": quality.ScoredTable(lineitem, ("l_orderkey", "l_linenumber"),
                                        rules=[F.col("l_quantity") >= 25] if with_links else (), foreign_keys=links),
        "orders": quality.ScoredTable(orders, ("o_orderkey",)),
        "customer": quality.ScoredTable(customer),
        "events": quality.ScoredTable(events, ("user_id",)),
        "part": quality.ScoredTable(part, ("p_partkey",)),
    }


def _sync_times(spark, sf):
    """Last change per table as seen in its own rows; customer and part carry no time."""
    lineitem = load(spark, sf, "lineitem").agg(F.max("l_shipdate").alias("last_metadata_sync")).withColumn("table_name", F.lit("lineitem"))
    orders = load(spark, sf, "orders").agg(F.max("o_orderdate").alias("last_metadata_sync")).withColumn("table_name", F.lit("orders"))
    events = load(spark, sf, "events").agg(F.max("ts").alias("last_metadata_sync")).withColumn("table_name", F.lit("events"))
    return lineitem.unionByName(orders).unionByName(events)


def _assets(spark):
    return spark.createDataFrame([("events", 12), ("orders", 48)], "table_name string, sla_freshness_hours int")


def quality_overall(spark, sf):
    return quality.score_tables(_scored(spark, sf), _sync_times(spark, sf), _assets(spark), AS_OF)


def _one(spark, sf, column, *more):
    return quality_overall(spark, sf).select("table_name", column, *more)


def quality_refresh(spark, sf):
    return quality.refresh_totals(["lineitem", "orders", "customer", "events", "part", "dropped_table"],
                                  quality_overall(spark, sf))


def quality_with_rules(spark, sf):
    scored = quality.score_tables({"lineitem": _scored(spark, sf, True)["lineitem"]}, _sync_times(spark, sf),
                                  _assets(spark), AS_OF)
    return scored.select("table_name", "accuracy", "consistency")


def fk_containment(spark, sf):
    """Items against settled orders; returned items carry no key."""
    orders = load(spark, sf, "orders").filter(F.col("o_orderstatus") != "P")
    lineitem = load(spark, sf, "lineitem").withColumn(
        "l_orderkey", F.when(F.col("l_returnflag") != "R", F.col("l_orderkey")))
    return quality.fk_containment(lineitem, "l_orderkey", orders, "o_orderkey")


_SYNC = """
sync AS (SELECT 'lineitem' AS table_name, max(l_shipdate) AS t, 24 AS sla FROM lineitem
   UNION ALL SELECT 'orders', max(o_orderdate), 48 FROM orders
   UNION ALL SELECT 'events', max(ts), 12 FROM events
   UNION ALL SELECT 'customer', NULL, 24 UNION ALL SELECT 'part', NULL, 24),
fresh AS (SELECT table_name, t, CASE WHEN t IS NULL THEN 0.0
      WHEN date_diff('microsecond', t, {as_of}) / 3600000000.0 <= sla THEN 100.0
      ELSE greatest(0.0, 100.0 - 5.0 * (date_diff('microsecond', t, {as_of}) / 3600000000.0 - sla)) END AS freshness,
      CASE WHEN t IS NULL THEN 9999 ELSE CAST(floor(date_diff('microsecond', t, {as_of}) / 3600000000.0) AS BIGINT) END AS freshness_hours,
      CAST(CASE WHEN t IS NULL THEN 75.0 WHEN floor(date_diff('microsecond', t, {as_of}) / 86400000000.0) < 7 THEN 90.0
           WHEN floor(date_diff('microsecond', t, {as_of}) / 86400000000.0) < 30 THEN 80.0 ELSE 70.0 END AS DOUBLE) AS accuracy
   FROM sync)""".replace("{as_of}", AS_OF_SQL)

_MEASURES = """
measures AS (
   SELECT 'lineitem' AS table_name, 100.0 AS completeness, 100.0 * count(DISTINCT (l_orderkey, l_linenumber)) / count(*) AS uniqueness, 100.0 AS completeness_percent FROM lineitem
   UNION ALL SELECT 'orders', 100.0, 100.0 * count(DISTINCT o_orderkey) / count(*), 100.0 FROM orders
   UNION ALL SELECT 'customer', 100.0, 75.0, 100.0
   UNION ALL SELECT 'events', 100.0, 100.0 * count(DISTINCT user_id) / count(*), 100.0 FROM events
   UNION ALL SELECT 'part', 100.0 * count(nullif(p_size % 10, 0)) / count(*), 100.0 * count(DISTINCT p_partkey) / count(*),
        (5 * 100.0 + 100.0 * count(nullif(p_size % 10, 0)) / count(*)) / 6 FROM part)"""

_QUALITY = f"""WITH {_SYNC}, {_MEASURES},
scores AS (SELECT table_name, round(freshness, 4) AS freshness, round(completeness, 4) AS completeness,
   round(uniqueness, 4) AS uniqueness, round(accuracy, 4) AS accuracy, 85.0::DOUBLE AS consistency,
   round(freshness * 0.9, 4) AS timeliness,
   round(0.25 * freshness + 0.25 * completeness + 0.15 * uniqueness + 0.15 * accuracy + 0.10 * 85.0 + 0.10 * freshness * 0.9, 4) AS overall,
   freshness_hours, round(completeness_percent, 4) AS completeness_percent
   FROM fresh JOIN measures USING (table_name))
SELECT {{}} FROM scores"""

QUERIES = {
    "profile_lineitem": profile_lineitem,
    "profile_orders": profile_orders,
    "profile_rowcount": profile_rowcount,
    "profile_sampled": profile_sampled,
    "profile_hash_sample": profile_hash_sample,
    "profile_approx": profile_approx,
    "profile_approx_holds": profile_approx_holds,
    "profile_refresh": profile_refresh,
    "profile_refresh_top": profile_refresh_top,
    "top_values_orders": top_values_orders,
    "profile_minmaxavg": profile_minmaxavg,
    "profile_histogram": profile_histogram,
    "completeness_percent": completeness_percent,
    "profile_history_monthly": profile_history_monthly,
    "quality_freshness": lambda spark, sf: _one(spark, sf, "freshness", "freshness_hours"),
    "quality_completeness": lambda spark, sf: _one(spark, sf, "completeness", "completeness_percent"),
    "quality_uniqueness": lambda spark, sf: _one(spark, sf, "uniqueness"),
    "quality_accuracy": lambda spark, sf: _one(spark, sf, "accuracy"),
    "quality_with_rules": quality_with_rules,
    "fk_containment": fk_containment,
    "quality_overall": quality_overall,
    "quality_refresh": quality_refresh,
}

ORACLES = {
    "profile_lineitem": _profile_sql("lineitem", LINEITEM),
    "profile_orders": _profile_sql("orders", ORDERS, {
        "o_orderstatus": "nullif(o_orderstatus, 'P')",
        "o_custkey": "CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END"}),
    "profile_hash_sample": "WITH h AS (SELECT * FROM lineitem WHERE cast('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber)), 1, 8) AS BIGINT) < "
        "(SELECT floor(least(1.0::DOUBLE, 10000 / count(*)) * 4294967296) FROM lineitem))\n" + _profile_sql("h", LINEITEM),
    "profile_approx_holds": "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(*) AS total, count({c}) AS non_null, count(*) - count({c}) AS null_count, true AS distinct_holds FROM lineitem" for c in LINEITEM),
    "profile_refresh": "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(*) AS total, count({c}) AS non_null, count(*) - count({c}) AS null_count, "
        + (f"round(min({c})::DOUBLE, 2) AS min_value, round(max({c})::DOUBLE, 2) AS max_value, round(avg({c}), 4) AS avg_value" if kind == "n" else "NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, NULL::DOUBLE AS avg_value")
        + (f", min({c}) AS min_text, max({c}) AS max_text" if kind == "s" else ", NULL::VARCHAR AS min_text, NULL::VARCHAR AS max_text")
        + ", true AS distinct_holds, count(*) FILTER (year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)) AS rows_read_last FROM orders"
        for c, kind in zip(ORDERS, "nnsnds")),
    "profile_refresh_top": """
SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""",
    "profile_rowcount": "SELECT count(*) AS row_count FROM lineitem",
    "top_values_orders": """
WITH cells AS (SELECT 'o_custkey' AS column_name, CAST(o_custkey AS VARCHAR) AS value FROM orders
   UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders
   UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
counted AS (SELECT column_name, value, count(*) AS count FROM cells GROUP BY 1, 2)
SELECT column_name, value, count, CAST(row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS INTEGER) AS rank
FROM counted QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) <= 10""",
    "profile_minmaxavg": "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, "
        + (f"round(avg({c}), 4)" if c != "l_returnflag" else "CAST(NULL AS DOUBLE)")
        + " AS avg_value, strftime(max(l_shipdate), '%Y-%m-%d') AS freshness FROM lineitem"
        for c in ["l_orderkey", "l_quantity", "l_linenumber", "l_returnflag"]),
    "profile_histogram": """
WITH r AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 7 AS w FROM lineitem)
SELECT CAST(least(floor((l_quantity - lo) / w), 6) AS BIGINT) AS bin,
       round(lo + least(floor((l_quantity - lo) / w), 6) * w, 6) AS x, count(*) AS y
FROM lineitem, r GROUP BY ALL""",
    "completeness_percent": """
SELECT round((100.0 + 100.0 * count(nullif(o_orderkey % 3, 0)) / count(*)) / 2, 4) AS completeness_percent FROM orders""",
    "profile_history_monthly": """
WITH based AS (SELECT o_orderpriority AS table_id, date_trunc('month', o_orderdate) AS m, o_orderdate, o_custkey, o_orderstatus FROM orders),
agg AS (SELECT table_id, m, max(o_orderdate) AS lu, count(*) AS row_count, count(DISTINCT o_custkey) AS dc, count(DISTINCT o_orderstatus) AS ds FROM based GROUP BY 1, 2)
SELECT table_id, strftime(m + INTERVAL 1 MONTH, '%Y-%m-%d') AS created_at, strftime(lu, '%Y-%m-%d') AS last_updated, row_count,
       'o_custkey' AS column_name, 0.0::DOUBLE AS null_percentage, dc AS distinct_count FROM agg
UNION ALL
SELECT table_id, strftime(m + INTERVAL 1 MONTH, '%Y-%m-%d'), strftime(lu, '%Y-%m-%d'), row_count, 'o_orderstatus', 0.0::DOUBLE, ds FROM agg""",
    "quality_freshness": _QUALITY.format("table_name, freshness, freshness_hours"),
    "quality_completeness": _QUALITY.format("table_name, completeness, completeness_percent"),
    "quality_uniqueness": _QUALITY.format("table_name, uniqueness"),
    "quality_accuracy": _QUALITY.format("table_name, accuracy"),
    "quality_with_rules": """
SELECT 'lineitem' AS table_name, round(100.0 * count(*) FILTER (WHERE l_quantity >= 25) / count(*), 4) AS accuracy,
       round(100.0 * count(*) FILTER (WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) / count(*), 4) AS consistency FROM lineitem""",
    "fk_containment": """
WITH c AS (SELECT l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AS hit FROM lineitem WHERE l_returnflag <> 'R')
SELECT count(*) AS non_null_keys, count(*) FILTER (WHERE hit) AS matched_keys,
       round(100.0 * count(*) FILTER (WHERE hit) / count(*), 4) AS containment_pct FROM c""",
    "quality_overall": _QUALITY.format("*"),
    "quality_refresh": "SELECT CAST(6 AS BIGINT) AS total, count(DISTINCT t) AS scored, 6 - count(DISTINCT t) AS failed FROM ("
        + " UNION ALL ".join(f"SELECT '{t}' AS t FROM {t}" for t in ["lineitem", "orders", "customer", "events", "part"]) + ")",
}
