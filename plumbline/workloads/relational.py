"""Registered jobs: transforms, files, guarded SQL and relational certification."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import query, transform
from plumbline.plans import ordered, ranges
from plumbline.session import work_path
from plumbline.sources import excel, files
from plumbline.sources.tables import load
from plumbline.workloads import derived as V


def filter_eq(spark, sf):
    return transform.filter_data(load(spark, sf, "orders"), "o_orderstatus", "F").select("o_orderkey", "o_custkey")


def filter_gt(spark, sf):
    return transform.filter_data(load(spark, sf, "orders"), "o_totalprice", 400000, ">").select("o_orderkey", "o_totalprice")


def filter_more(spark, sf):
    orders = transform.filter_data(load(spark, sf, "orders"), "o_totalprice", (100000, 300000), "between")
    orders = transform.filter_data(orders, "o_orderpriority", ["1-URGENT", "5-LOW"], "in")
    return transform.filter_data(orders, "o_orderstatus", "F", "!=").select("o_orderkey", "o_orderpriority", "o_orderstatus")


def agg_multi(spark, sf):
    orders = load(spark, sf, "orders").withColumn("first_key", F.col("o_orderkey")).withColumn("last_key", F.col("o_orderkey"))
    done = transform.aggregate(orders, ["o_orderpriority", "o_orderstatus"], {
        "o_totalprice": ["sum", "mean", "min", "max", "std", "var", "median"], "o_custkey": "nunique", "o_orderdate": "count",
        "first_key": "first", "last_key": "last"}, order_by="o_orderkey")
    return done.select("o_orderpriority", "o_orderstatus", *[F.round(f"o_totalprice_{f}", 4).alias(f"o_totalprice_{f}") for f in
                                                            ("sum", "mean", "min", "max", "std", "median")],
                       F.round(F.col("o_totalprice_var") / 1e6, 4).alias("o_totalprice_var"), "o_custkey", "o_orderdate", "first_key", "last_key")


def agg_null_keys(spark, sf):
    """NULL keys are left out and all-NULL groups add up to 0."""
    orders = load(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("price"))
    return transform.aggregate(orders, ["status"], {"price": ["sum", "count"]}).withColumn("price_sum", F.round("price_sum", 2))


def python_transform(spark, sf):
    """User pandas code over Arrow batches, with a declared schema."""
    def banded(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s_suppkey": pdf["s_suppkey"], "band": (pdf["s_acctbal"] // 1000).astype("int64")})

    return transform.apply_pandas(load(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), banded, "s_suppkey long, band long")


def csv_roundtrip(spark, sf):
    path = work_path(spark, "my sup-pliers.csv")
    load(spark, sf, "supplier").write.option("header", True).csv(path)
    files.read_csv(spark, path)
    return spark.sql(f"SELECT * FROM {files.view_name(path)} WHERE s_acctbal > 1000")


def ndjson_export(spark, sf):
    path = work_path(spark, "orders.ndjson")
    files.write_ndjson(load(spark, sf, "orders").withColumn(
        "o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))), path)
    return spark.read.schema("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, "
                             "o_orderpriority string").json(path)


def file_inventory(spark, sf):
    path = work_path(spark, "lake")
    load(spark, sf, "supplier").repartitionByRange(3, "s_suppkey").write.option("header", True).csv(f"{path}/supplier")
    load(spark, sf, "orders").write.json(f"{path}/orders")
    found = files.file_inventory(spark, path)
    return found.groupBy("extension").agg(F.count(F.lit(1)).alias("n_files"), (F.sum("size_bytes") > 0).alias("has_bytes"))


WORKBOOK_ROWS = 5000


# Parts of a small workbook. The sheet of the data comes first, but its part is named second; style 1 shows dates.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PARTS = {
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
        '<sheet name="parts" sheetId="1" r:id="rId2"/><sheet name="notes" sheetId="2" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData><row><c t="inlineStr"><is><t>p_partkey</t></is></c></row><row><c><v>-1</v></c></row></sheetData></worksheet>',
}


def _workbook(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One workbook as bytes for a block of rows: texts, numbers, booleans, dates and, for NaN, error cells."""
    columns = [c for c in pdf.columns if c != "block"]

    def cell(value):
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        if isinstance(value, (bool, np.bool_)):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, dt.date):
            return f'<c s="1"><v>{(value - dt.date(1899, 12, 30)).days}</v></c>'
        if isinstance(value, float) and value != value:
            return '<c t="e"><v>#DIV/0!</v></c>'
        return f"<c><v>{value}</v></c>"

    rows = ["".join(cell(c) for c in columns)] + ["".join(cell(v) for v in r) for r in pdf[columns].itertuples(index=False)]
    sheet = f'<worksheet xmlns="{_MAIN}"><sheetData>' + "".join(f"<row>{r}</row>" for r in rows) + "</sheetData></worksheet>"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as book:
        for name, part in (_PARTS | {"xl/worksheets/sheet2.xml": sheet}).items():
            book.writestr(name, part)
    return pd.DataFrame({"rows": [len(pdf)], "content": [packed.getvalue()]})


def excel_ingest(spark, sf):
    """Parts packed into workbooks of 5,000 rows, then read back as one table and held against the parts, value by value.

    The first sheet holds keys beyond what a double tells apart, dates, booleans and error cells; workbooks travel as a stored binary column.
    """
    folder = work_path(spark, "workbooks")
    schema = "p_partkey bigint, p_name string, p_retailprice double, big_key bigint, listed_on date, is_large boolean, ratio double"
    key = F.col("p_partkey")
    parts = load(spark, sf, "part").select(
        "p_partkey", "p_name", "p_retailprice", (key + 9007199254740993).alias("big_key"), F.date_add(F.lit("2020-01-01").cast("date"), (key % 2000).cast("int")).alias("listed_on"),
        (F.col("p_size") > 25).alias("is_large"), F.when(key % 6 != 0, F.round(F.col("p_retailprice") / (key % 6), 4)).alias("ratio"), F.floor(key / WORKBOOK_ROWS).alias("block"))
    parts.groupBy("block").applyInPandas(_workbook, "rows long, content binary").write.parquet(folder)
    return _same_as(excel.parse_workbooks(spark.read.parquet(folder).select("content"), schema), parts.drop("block"), "p_partkey")


def _same_as(found, wanted, key: str):
    """``found``, whose rows must be those of ``wanted``: a row that lacks, is too many or differs in a value ends the job."""
    counted = [df.groupBy(*wanted.columns).agg(F.count(F.lit(1)).alias("n")) for df in (found, wanted)]
    pairs = counted[0].alias("f").join(counted[1].alias("w"), F.col(f"f.{key}") == F.col(f"w.{key}"), "full_outer")
    same = F.lit(True)
    for c in [*wanted.columns, "n"]:
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"w.{c}"))
    differs = F.raise_error(F.concat(F.lit(f"workbooks differ from their source at {key} "), F.coalesce(F.col(f"f.{key}"), F.col(f"w.{key}")).cast("string")))
    checked = pairs.select(F.when(same, F.col(f"f.{key}")).otherwise(differs).alias(key), *[F.col(f"f.{c}").alias(c) for c in wanted.columns if c != key], F.col("f.n").alias("n"))
    return checked.select(*wanted.columns, F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("__copy")).drop("__copy")


def guarded_query_limit(spark, sf):
    return query.guarded_query(
        spark, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :s ORDER BY o_totalprice DESC, o_orderkey",
        {"s": "F"}, max_rows=250, frames={"orders": load(spark, sf, "orders")})


def sql_asof(spark, sf):
    """Latest earlier purchase value of the same user for every click."""
    events = load(spark, sf, "events")
    clicks = events.filter("event_type = 'click'").select("user_id", "event_id", "ts")
    buys = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return ordered.asof_join(clicks, buys, ["user_id"], "ts", "ts", "last_purchase").select("event_id", "user_id", "last_purchase")


def sql_running_sum(spark, sf):
    """Running order value per status in order-key order, over every single row."""
    orders = load(spark, sf, "orders").select("o_orderstatus", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return ordered.running_sum(orders, ["o_orderstatus"], "o_orderkey", "cents", out="running_cents")


def sql_range_join(spark, sf):
    """Line items per overlapping 45-day shipping window; windows start with each month of orders."""
    orders, items = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    windows = orders.select(F.unix_date(F.to_date(F.date_trunc("month", "o_orderdate"))).alias("low")).distinct().withColumn(
        "high", F.col("low") + 45)
    points = items.groupBy(F.unix_date(F.to_date("l_shipdate")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    joined = ranges.range_join(points, "day", windows, "low", "high", 45)
    return joined.groupBy(F.date_from_unix_date("low").alias("window_start")).agg(F.sum("n").alias("n_items"))


def _sql(text: str, *tables: str):
    def job(spark, sf):
        return query.query_over_frames(spark, text, {t: load(spark, sf, t) for t in tables})

    return job


# the same text runs on both engines
SHARED_SQL = {
    "sql_join_two_frames": (("orders", "customer"), """
SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""),
    "sql_left_join": (("customer", "orders"), """
SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey"""),
    "sql_full_join": (("supplier", "customer"), """
SELECT coalesce(s_nationkey, c_nationkey) AS nationkey, n_sup, n_cust FROM
 (SELECT s_nationkey, count(*) AS n_sup FROM supplier WHERE s_acctbal > 9000 GROUP BY s_nationkey) s
 FULL OUTER JOIN (SELECT c_nationkey, count(*) AS n_cust FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) c ON s_nationkey = c_nationkey"""),
    "sql_semi": (("customer", "orders"), """
SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)"""),
    "sql_anti": (("customer", "orders"), """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"""),
    "sql_group_having": (("lineitem",), """
SELECT l_partkey, count(DISTINCT l_suppkey) AS n_suppliers, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_partkey HAVING count(*) > 30"""),
    "sql_rollup": (("orders",), """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"""),
    "sql_cube": (("lineitem",), """
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"""),
    "sql_grouping_sets": (("lineitem",), """
SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())"""),
    "sql_rank": (("orders",), """
SELECT o_orderpriority, o_orderkey, o_totalprice, cast(rk AS bigint) AS rk FROM
 (SELECT o_orderpriority, o_orderkey, o_totalprice, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) q WHERE rk <= 20"""),
    "sql_window_frame": (("orders",), """
SELECT o_orderpriority, m, v, round(avg(v) OVER (PARTITION BY o_orderpriority ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS avg3,
 lag(v) OVER (PARTITION BY o_orderpriority ORDER BY m) AS prev FROM
 (SELECT o_orderpriority, cast(year(o_orderdate) * 100 + month(o_orderdate) AS bigint) AS m, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2) q"""),
    "sql_topk": (("lineitem",), """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100 OFFSET 10"""),
    "sql_setops": (("customer", "supplier", "orders"), """
SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) a
UNION ALL SELECT 'intersect', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') b
UNION ALL SELECT 'except', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) c"""),
    "sql_scalars": (("part", "events"), """
SELECT p_partkey, upper(p_name) AS up, cast(length(p_brand) AS bigint) AS len, substring(p_name, 1, 3) AS head, replace(p_type, 'E', '3') AS rep,
 concat(p_brand, '/', p_type) AS joined, lpad(cast(p_size AS varchar(10)), 5, '0') AS padded, abs(p_size - 25) AS dist, round(sqrt(p_retailprice), 4) AS root,
 greatest(p_size, 10) AS g, coalesce(nullif(p_size, 1), -1) AS c, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS band, mod(p_partkey, 7) AS m
FROM part"""),
    "sql_subquery": (("orders", "customer"), """
WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)
SELECT c_custkey, top FROM customer JOIN big ON o_custkey = c_custkey
WHERE top > (SELECT avg(o_totalprice) * 1.7 FROM orders) AND c_acctbal > (SELECT avg(i.c_acctbal) FROM customer i WHERE i.c_nationkey = customer.c_nationkey)"""),
    "sql_recursive": (("orders",), """
WITH RECURSIVE monthly AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1),
span AS (SELECT min(m) AS lo, max(m) AS hi FROM monthly),
calendar AS (SELECT lo AS m, hi FROM span UNION ALL SELECT m + 1, hi FROM calendar WHERE m < hi)
SELECT cast(c.m AS bigint) AS m, coalesce(n, 0) AS n FROM calendar c LEFT JOIN monthly o ON o.m = c.m"""),
}


def sql_json_arrays(spark, sf):
    """Nested values: JSON fields, arrays and maps."""
    return query.query_over_frames(spark, """
SELECT event_id, cast(get_json_object(props, '$.k') AS bigint) AS k, size(split(event_type, 'i')) AS n_pieces,
 element_at(split(event_type, 'i'), 1) AS first_piece, aggregate(sequence(1, cast(get_json_object(props, '$.k') AS int) + 1), 0, (a, x) -> a + x) AS tri,
 map_from_arrays(array('t', 'u'), array(event_type, cast(user_id AS string)))['u'] AS u,
 date_format(ts, 'yyyy-MM-dd') AS day, hour(ts) AS hour FROM events""", {"events": load(spark, sf, "events")})


def sql_embedding_stats(spark, sf):
    """Array columns through SQL: length and sum per label."""
    return query.query_over_frames(spark, """
SELECT label, count(*) AS n, min(size(embedding)) AS dim, round(sum(aggregate(embedding, 0D, (a, x) -> a + x)), 3) AS total FROM embeddings GROUP BY label""",
                                   {"embeddings": load(spark, sf, "embeddings")})


QUERIES = {
    "filter_eq": filter_eq,
    "filter_gt": filter_gt,
    "filter_more": filter_more,
    "agg_multi": agg_multi,
    "agg_null_keys": agg_null_keys,
    "python_transform": python_transform,
    "csv_roundtrip": csv_roundtrip,
    "ndjson_export": ndjson_export,
    "file_inventory": file_inventory,
    "excel_ingest": excel_ingest,
    "guarded_query_limit": guarded_query_limit,
    "sql_asof": sql_asof,
    "sql_running_sum": sql_running_sum,
    "sql_range_join": sql_range_join,
    "sql_json_arrays": sql_json_arrays,
    "sql_embedding_stats": sql_embedding_stats,
    **{name: _sql(text, *tables) for name, (tables, text) in SHARED_SQL.items()},
}

ORACLES = {
    "filter_eq": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'",
    "filter_gt": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000",
    "filter_more": "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_totalprice BETWEEN 100000 AND 300000 "
        "AND o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus <> 'F'",
    "agg_multi": """
SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 4) AS o_totalprice_sum, round(avg(o_totalprice), 4) AS o_totalprice_mean,
  round(min(o_totalprice), 4) AS o_totalprice_min, round(max(o_totalprice), 4) AS o_totalprice_max, round(stddev_samp(o_totalprice), 4) AS o_totalprice_std, round(var_samp(o_totalprice) / 1e6, 4) AS o_totalprice_var,
  round(median(o_totalprice), 4) AS o_totalprice_median, count(DISTINCT o_custkey) AS o_custkey, count(o_orderdate) AS o_orderdate,
  min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1, 2""",
    "agg_null_keys": """
SELECT status, round(coalesce(sum(price), 0), 2) AS price_sum, count(price) AS price_count FROM
 (SELECT nullif(o_orderstatus, 'P') AS status, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS price FROM orders) WHERE status IS NOT NULL GROUP BY 1""",
    "python_transform": "SELECT s_suppkey, CAST(floor(s_acctbal / 1000) AS BIGINT) AS band FROM supplier",
    "csv_roundtrip": "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 1000",
    "ndjson_export": "SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders",
    "file_inventory": "SELECT 'csv' AS extension, CAST(3 AS BIGINT) AS n_files, sum(length(s_name)) > 0 AS has_bytes FROM supplier",
    "excel_ingest": "SELECT p_partkey, p_name, p_retailprice, p_partkey + 9007199254740993 AS big_key, DATE '2020-01-01' + CAST(p_partkey % 2000 AS INTEGER) AS listed_on, p_size > 25 AS is_large, "
        "round(p_retailprice / nullif(p_partkey % 6, 0), 4) AS ratio FROM part",
    "guarded_query_limit": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 250",
    "sql_asof": """
SELECT c.event_id, c.user_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = c.user_id AND c.ts >= p.ts""",
    "sql_running_sum": """
SELECT o_orderstatus, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS running_cents FROM orders""",
    "sql_range_join": """
SELECT w AS window_start, count(*) AS n_items FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS w FROM orders)
JOIN lineitem ON l_shipdate >= w AND l_shipdate < w + INTERVAL 45 DAY GROUP BY 1""",
    "sql_json_arrays": """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(len(string_split(event_type, 'i')) AS INTEGER) AS n_pieces, split_part(event_type, 'i', 1) AS first_piece,
  CAST((CAST(json_extract(props, '$.k') AS INTEGER) + 1) * (CAST(json_extract(props, '$.k') AS INTEGER) + 2) // 2 AS INTEGER) AS tri, CAST(user_id AS VARCHAR) AS u,
  strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) AS INTEGER) AS hour FROM events""",
    "sql_embedding_stats": "SELECT label, count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS dim, round(sum(list_sum(embedding)), 3) AS total FROM embeddings GROUP BY 1",
    **{name: text for name, (_, text) in SHARED_SQL.items()},
}
