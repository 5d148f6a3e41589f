"""Metadata tables derived from the data tables, so that metadata jobs grow with the data.

Catalogs, query logs, lineage edges, policies, audit rows and change feeds are not among the
given tables. Each is computed here from one of them, by SQL text that Spark and DuckDB both
accept: the job and its oracle then start from the same rows. ``{explode}`` and ``{rings}`` are the spots
where the dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import dealt, work_path
from plumbline.sources.tables import load

ENTITIES = "customer,order,product,invoice,shipment,payment,employee,address"
SUFFIXES = "s,_fact,_dim,_bridge,_v2,_staging,_archive"

# name|type pairs of the non-key catalog columns; wide enough to reach every rule branch
COLUMN_POOL = [
    ("email_address", "varchar(255)"), ("phone_number", "varchar(32)"), ("ssn", "varchar(11)"),
    ("full_name", "varchar(80)"), ("street_address", "text"), ("password_hash", "char(64)"),
    ("session_uuid_token", "char(36)"), ("card_number", "varchar(19)"), ("passport_no", "varchar(12)"),
    ("tax_id", "varchar(16)"), ("aadhaar_no", "varchar(14)"), ("birth_date", "date"),
    ("dob", "timestamp"), ("total_amount", "decimal(12,2)"), ("discount", "float"),
    ("avg_price", "numeric(10,2)"), ("order_count", "int"), ("max_quantity", "int"),
    ("min_rate", "float"), ("sales_value", "double"), ("revenue", "decimal(14,2)"),
    ("order_status", "varchar(12)"), ("region", "varchar(20)"), ("country_code", "char(2)"),
    ("product_type", "varchar(30)"), ("sku_category", "varchar(30)"), ("customer_segment", "varchar(30)"),
    ("channel", "varchar(20)"), ("department", "varchar(20)"), ("order_date", "date"),
    ("updated_at", "timestamp"), ("ship_time", "time"), ("notes", "text"),
    ("filename", "varchar(200)"), ("hotel", "varchar(60)"), ("company", "varchar(60)"),
    ("is_active", "boolean"), ("state", "char(2)"), ("city", "varchar(40)"), ("weight", "int"),
]
POOL_NAMES = ",".join(n for n, _ in COLUMN_POOL)
POOL_TYPES = ";".join(t for _, t in COLUMN_POOL)
PII_NAMES = "','".join([
    "email_address", "phone_number", "ssn", "full_name", "street_address", "password_hash", "card_number",
    "passport_no", "tax_id", "aadhaar_no", "birth_date", "dob"])


def text(expr: str) -> str:
    return f"cast({expr} as string)"


def pick(values: str, index: str, sep: str = ",") -> str:
    """SQL for the ``index``-th (0-based) of a separated list, cycling."""
    n = len(values.split(sep))
    return f"split_part('{values}', '{sep}', cast(1 + ({index}) % {n} as int))"


def half(key: str, by: int = 2) -> str:
    return f"cast(floor(({key}) / {by}) as bigint)"


def entity_word(key: str) -> str:
    return f"concat({pick(ENTITIES, key)}, '_', {text(key)})"


def table_name(key: str) -> str:
    return f"concat({entity_word(key)}, {pick(SUFFIXES, key)})"


CATALOG_TABLES = f"""
SELECT concat('T', {text('p_partkey')}) AS table_id,
       CASE WHEN floor(p_partkey / 64) % 5 = 0 THEN 'conn_b' ELSE 'conn_a' END AS connection_id,
       CASE WHEN p_partkey % 10 = 0 THEN 'ws2' ELSE 'ws1' END AS workspace_id,
       CASE WHEN p_size % 2 = 0 THEN 'public' ELSE 'sales' END AS schema_name,
       {table_name('p_partkey')} AS table_name,
       CASE p_partkey % 4
            WHEN 0 THEN NULL
            WHEN 1 THEN p_name
            WHEN 2 THEN concat('Daily ', p_type, ' orders of ', p_brand, ' used in the revenue report')
            ELSE concat('Holds customer purchases of ', p_name, ' across all regions') END AS description,
       CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN '' ELSE p_brand END AS owner_id,
       cast(p_size as bigint) * 1000 AS row_count_estimate,
       CASE WHEN p_partkey % 7 = 0 THEN NULL
            ELSE cast('2023-01-01' as date) + cast(p_partkey % 380 as int) END AS created_on
FROM part"""

CATALOG_COLUMNS = f"""
SELECT concat('T', {text('p_partkey')}, '.', {text('i')}) AS column_id,
       concat('T', {text('p_partkey')}) AS table_id,
       CASE WHEN i = 1 THEN CASE WHEN p_partkey % 11 = 0 THEN 'code' ELSE 'id' END
            WHEN i = 2 AND p_partkey > 1 THEN concat({entity_word(half('p_partkey'))}, '_id')
            WHEN i = 3 AND p_partkey > 2 AND p_partkey % 3 > 0 THEN concat({entity_word(half('p_partkey', 3))}, '_ID')
            ELSE {pick(POOL_NAMES, 'p_partkey * 7 + i * 3')} END AS name,
       CASE WHEN i <= 3 AND p_partkey > 2 THEN 'bigint'
            ELSE {pick(POOL_TYPES, 'p_partkey * 7 + i * 3', ';')} END AS data_type,
       i = 1 AS is_primary_key,
       (i = 2 AND p_partkey > 1) OR (i = 3 AND p_partkey > 2 AND p_partkey % 3 > 0) AS is_foreign_key,
       {pick(POOL_NAMES, 'p_partkey * 7 + i * 3')} IN ('{PII_NAMES}') AND i > 3 AS is_pii,
       CASE WHEN {pick(POOL_NAMES, 'p_partkey * 7 + i * 3')} IN ('{PII_NAMES}') AND i > 3 THEN upper({pick(POOL_NAMES, 'p_partkey * 7 + i * 3')}) END AS pii_tag,
       (p_partkey + i) % 4 = 0 AS is_masked,
       CASE WHEN i % 5 = 0 THEN concat('Order detail ', {text('i')}) END AS description,
       cast(i as int) AS ordinal_position
FROM {{explode}}"""

SPARK_POSITIONS = "part LATERAL VIEW explode(sequence(1, 4 + p_size % 12)) s AS i"
DUCK_POSITIONS = "(SELECT *, unnest(range(1, 5 + p_size % 12)) AS i FROM part)"

# every event is one logged statement; the tables it names are catalog tables, but for a few strays
SQL_LOG = f"""
SELECT event_id AS query_id,
       concat('u', {text('user_id')}) AS user_id,
       'query_executed' AS action,
       ts AS logged_at,
       cast(floor(value * 10) as bigint) AS execution_time_ms,
       event_type <> 'error' AS ok,
       CASE event_id % 10
         WHEN 0 THEN concat('CREATE TABLE IF NOT EXISTS ', dst, ' AS SELECT a.id, b.total_amount FROM ', src, ' a JOIN ', alt, ' b ON a.id = b.id')
         WHEN 1 THEN concat('insert into ', dst, ' (id, v) SELECT id, sum(v) FROM ', src, ' GROUP BY id -- FROM hidden_', event_type)
         WHEN 2 THEN concat('UPDATE ', dst, ' SET v = s.v FROM ', src, ' s WHERE s.id = 1')
         WHEN 3 THEN concat('UPDATE ', dst, ' SET v = 1 FROM ', dst, ' WHERE id = 2')
         WHEN 4 THEN concat('SELECT  x.id,   x.region FROM ', src, ' x /* JOIN ghost */ LEFT JOIN public.', alt, ' y ON x.id = y.id')
         WHEN 5 THEN concat('select * from (SELECT id FROM ', src, ') AS z JOIN ', alt, ' w ON z.id = w.id')
         WHEN 6 THEN concat('SELECT count(*) FROM stray_', {text('user_id')}, ' WHERE k = ', {text('event_id % 7')})
         WHEN 7 THEN concat('CREATE TEMPORARY TABLE tmp_', {text('user_id')}, ' AS SELECT id FROM ', src)
         WHEN 8 THEN concat('CREATE TABLE ', dst, ' AS SELECT id FROM ', src, ' UNION ALL SELECT id FROM ', alt)
         ELSE concat('SHOW TABLES LIKE ''', event_type, '''') END AS query_executed
FROM (SELECT *, {table_name('a')} AS src, {table_name('b')} AS alt, {table_name('c')} AS dst FROM
      (SELECT *, 1 + user_id % 97 AS a, 1 + (user_id * 3 + event_id) % 101 AS b, 1 + event_id % 89 AS c FROM events) k) n"""

# a lineage forest with diamonds, rings of three to six tables, two-node cycles, self loops and switched-off edges
LINEAGE_EDGES = f"""
SELECT concat('T', {text('p_partkey')}) AS source_table_id,
       concat('T', {text(half('p_partkey'))}) AS target_table_id,
       p_partkey % 17 <> 0 AS is_active
FROM part WHERE p_partkey > 1
UNION ALL
SELECT concat('T', {text('p_partkey')}), concat('T', {text(half('p_partkey', 3))}), true
FROM part WHERE p_partkey > 2 AND p_partkey % 5 = 0
UNION ALL
SELECT concat('T', {text(half('p_partkey'))}), concat('T', {text('p_partkey')}), true
FROM part WHERE p_partkey % 97 = 0 AND p_partkey > 1
UNION ALL
SELECT concat('T', {text('p_partkey')}), concat('T', {text('p_partkey')}), true
FROM part WHERE p_partkey % 89 = 0 AND p_partkey > 1
UNION ALL
SELECT concat('T', {text('a')}), concat('T', {text('b')}), true
FROM {{rings}} WHERE a > 0 AND b > 0"""

# every 211th table starts a ring over its neighbours, of three to six of them in turn
_RING = "floor(p_partkey / 211) % 4 + 3"
_RING_EDGES = f"(SELECT p_partkey - i AS a, p_partkey - cast((i + 1) % ({_RING}) as bigint) AS b FROM %s WHERE p_partkey % 211 = 0) r"
SPARK_RINGS = _RING_EDGES.replace("%s", f"part LATERAL VIEW explode(sequence(0, cast({_RING} as int) - 1)) s AS i")
DUCK_RINGS = _RING_EDGES.replace("%s", f"(SELECT *, unnest(range(0, cast({_RING} as int))) AS i FROM part)")

POLICIES = """
SELECT concat('P', cast(n_nationkey as string)) AS policy_id,
       n_name AS name,
       CASE n_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'restricted' WHEN 2 THEN 'confidential'
            WHEN 3 THEN 'internal' ELSE '' END AS sensitivity_level,
       CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS contains_pii_condition,
       CASE WHEN n_nationkey % 4 = 3 THEN 'restrict_access' ELSE 'mask' END AS action_type,
       CASE n_nationkey % 6 WHEN 0 THEN 'generic' WHEN 1 THEN 'name' WHEN 2 THEN 'phone' WHEN 3 THEN 'email'
            WHEN 4 THEN 'credit_card' END AS mask_type,
       CASE n_nationkey % 4 WHEN 0 THEN 'auditor' WHEN 1 THEN 'auditor,steward' WHEN 2 THEN '' END AS bypass_roles,
       n_nationkey % 7 <> 6 AS enabled
FROM nation"""

CLASSIFICATIONS = """
SELECT concat('C', cast(c_custkey as string)) AS table_id,
       CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'restricted' WHEN 'MACHINERY' THEN 'confidential'
            WHEN 'BUILDING' THEN 'internal' ELSE 'public' END AS sensitivity_level,
       c_nationkey % 3 <> 0 AS contains_pii,
       c_nationkey % 2 = 0 AS masking_enabled,
       c_custkey % 5 = 0 AS access_restricted,
       CASE WHEN c_custkey % 10 = 0 THEN 'steward' END AS allowed_roles
FROM customer WHERE c_acctbal >= 0"""

AUDIT_LOG = """
SELECT event_id AS audit_id,
       concat('u', cast(user_id as string)) AS user_id,
       CASE WHEN event_type = 'error' THEN 'access_denied' ELSE 'query_executed' END AS action,
       concat('T', cast(1 + user_id % 97 as string)) AS resource_id,
       CASE event_type WHEN 'error' THEN 'denied' WHEN 'purchase' THEN 'masked' ELSE 'full' END AS access_level,
       CASE event_type WHEN 'purchase' THEN cast(floor(value) as bigint) ELSE 0 END AS rows_masked,
       cast(floor(value) as bigint) AS rows_returned,
       ts AS logged_at
FROM events"""

HEALTH_LOG = """
SELECT concat('conn_', cast(user_id % 12 as string)) AS connection_id,
       CASE WHEN event_type = 'error' THEN 'down' ELSE 'healthy' END AS status,
       value AS latency_ms,
       ts AS checked_at
FROM events"""

METRICS = f"""
SELECT concat('metric_', {text('p_partkey')}) AS name,
       CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN '' ELSE concat('sum(', p_type, ')') END AS formula,
       CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN '' ELSE p_name END AS description,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 5 < 3 END AS is_certified,
       {pick('conn_a,conn_b', 'p_partkey')} AS connection_id
FROM part"""

# metric -> metric or table it is computed from
METRIC_DEPENDENCIES = f"""
SELECT concat('metric_', {text('p_partkey')}) AS parent_id,
       CASE WHEN p_partkey % 4 = 0 THEN concat('metric_', {text('p_partkey + 1')})
            ELSE concat('table_', {text('p_partkey % 40')}) END AS child_id
FROM part"""

# halfway through the topic is divided anew: keys move to other partitions, and offsets start again in a new epoch
CDC_FEED = """
SELECT event_id - CASE WHEN event_id > half THEN half ELSE 0 END AS feed_offset,
       CASE WHEN event_id > half THEN 1 ELSE 0 END AS epoch,
       CASE WHEN event_id % 11 = 0 THEN 'd' WHEN event_id < 50 THEN 'i' ELSE 'u' END AS op,
       user_id,
       event_type,
       value,
       ts
FROM (SELECT *, (SELECT cast(floor(max(event_id) / 2) as bigint) FROM events) AS half FROM events) e"""

# messages of the same topic that are no changes: cut off, of an unknown operation, without a row, without a key
CDC_FAULTS = """
SELECT CASE kind WHEN 0 THEN concat('{"op": "u", "feed_offset": ', id) WHEN 1 THEN concat('{"op": "x", "feed_offset": ', id, ', "after": {"user_id": 1}}')
                 WHEN 2 THEN concat('{"op": "u", "feed_offset": ', id, ', "before": null}') WHEN 3 THEN concat('{"feed_offset": ', id, ', "after": {"user_id": 1}}')
                 ELSE concat('{"op": "u", "feed_offset": ', id, ', "after": {"event_type": "view"}}') END AS value,
       CASE kind WHEN 0 THEN 'not valid JSON of the declared row' WHEN 1 THEN 'unknown operation' WHEN 2 THEN 'no row' WHEN 3 THEN 'no operation' ELSE 'no key user_id' END AS reason
FROM (SELECT cast(event_id as string) AS id, floor(event_id / 37) % 5 AS kind FROM events k WHERE event_id % 37 = 0) f"""

JSON_TEXTS = """
SELECT event_id AS id,
       CASE event_id % 6
         WHEN 0 THEN props
         WHEN 1 THEN concat('Here it is:', chr(10), '```json', chr(10), props, chr(10), '```', chr(10), 'done')
         WHEN 2 THEN concat('```json', chr(10), '{"k": ', chr(10), '``` but ', props)
         WHEN 3 THEN concat('The answer is ', props, ' as asked')
         WHEN 4 THEN concat('nothing to see in ', event_type)
         ELSE concat('set {', event_type, '} then ', props) END AS body
FROM events"""

PLAN_LOG = """
SELECT event_id AS plan_id,
       CASE event_id % 4
         WHEN 0 THEN concat('[{"Plan": {"Node Type": "Seq Scan", "Relation Name": "t', cast(user_id as string),
                            '", "Plan Rows": ', cast(cast(floor(value * 300) as bigint) as string), '}}]')
         WHEN 1 THEN concat('[{"Plan": {"Node Type": "Nested Loop", "Plan Rows": ', cast(cast(floor(value * 30) as bigint) as string),
                            ', "Plans": [{"Node Type": "Index Scan", "Plan Rows": 5}, {"Node Type": "Seq Scan", "Relation Name": "n',
                            cast(user_id as string), '", "Plan Rows": ', cast(cast(floor(value * 200) as bigint) as string), '}]}}]')
         WHEN 2 THEN concat('[{"Plan": {"Node Type": "Sort", "Plans": [{"Node Type": "Hash Join", "Plans": [',
                            '{"Node Type": "Nested Loop", "Plan Rows": 1001}, {"Node Type": "Seq Scan", "Relation Name": "d", "Plan Rows": ',
                            cast(cast(floor(value * 250) as bigint) as string), '}]}]}}]')
         ELSE '[{"Plan": {"Node Type": "Result", "Plan Rows": 1}}]' END AS plan_json
FROM events"""

# customers with contact data of every recognised shape, and some of none
CONTACTS = """
SELECT c_custkey,
       c_mktsegment AS segment,
       concat(lower(c_mktsegment), '.', cast(c_custkey as string), '@example.com') AS contact,
       concat('555-', lpad(cast(c_custkey % 1000 as string), 3, '0'), '-', lpad(cast(c_nationkey * 37 as string), 4, '0')) AS phone,
       CASE WHEN c_custkey % 6 = 0 THEN NULL
            ELSE concat(lpad(cast(c_custkey % 900 as string), 3, '0'), '-', lpad(cast(c_nationkey as string), 2, '0'), '-', lpad(cast(c_custkey % 10000 as string), 4, '0')) END AS code1,
       concat('4532-1111-2222-', lpad(cast(c_custkey % 10000 as string), 4, '0')) AS code2,
       concat('AB', lpad(cast(c_custkey as string), 7, '0')) AS doc_no,
       CASE c_custkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN '' WHEN 2 THEN concat(' ABCDE', lpad(cast(c_custkey % 10000 as string), 4, '0'), 'F ')
            ELSE concat('10.0.', cast(c_custkey % 256 as string), '.7') END AS mixed,
       concat('1234 5678 ', lpad(cast(c_custkey % 10000 as string), 4, '0')) AS aadhaar_no,
       concat('zyxwvutsrqponmlkjihgfedcbaZYXWVU', md5(c_name)) AS session_key,
       c_name AS company,
       'none' AS notes
FROM customer"""

SERIES_MONTHLY = """
SELECT o_orderpriority AS series_id,
       cast(date_trunc('month', o_orderdate) as date) AS ds,
       sum(o_totalprice) AS y
FROM orders GROUP BY 1, 2"""

SERIES_DAILY = """
SELECT event_type AS series_id, cast(ts as date) AS ds, sum(value) AS y
FROM events GROUP BY 1, 2"""

_SOURCES = ("part", "events", "nation", "customer", "orders", "supplier")


def duck(sql: str) -> str:
    """The derivation as a parenthesised DuckDB subquery."""
    return "(" + sql.replace("{explode}", DUCK_POSITIONS).replace("{rings}", DUCK_RINGS).strip() + ")"


def frame(spark: SparkSession, sf_dir: str, sql: str, deal: bool = False) -> DataFrame:
    """The derivation as a Spark DataFrame over the given tables, whose rows are dealt to all cores before on request."""
    query = sql.replace("{explode}", SPARK_POSITIONS).replace("{rings}", SPARK_RINGS).replace("{", "{{").replace("}", "}}")
    for name in _SOURCES:
        query = _bind(query, name)
    frames = {n: load(spark, sf_dir, n) for n in _SOURCES if "{" + n + "}" in query}
    if deal:
        frames = {n: dealt(df) for n, df in frames.items()}
    return spark.sql(query, **frames)


def _bind(query: str, name: str) -> str:
    """Turns ``FROM name`` into the frame placeholder of ``spark.sql``."""
    return re.sub(rf"\bFROM {name}\b", "FROM {" + name + "}", query)


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The derivation as a stored Parquet table, written once per application.

    Catalogs and query logs are tables in real life; reading them from files also keeps their
    long CASE texts out of the plans under test.
    """
    key = (spark.sparkContext.applicationId, sf_dir, sql)
    if key not in _STORED:
        path = work_path(spark, "derived")
        frame(spark, sf_dir, sql, deal=True).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])
