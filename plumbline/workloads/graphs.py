"""Registered jobs: lineage, impact, and query-log work."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.operators import impact, lineage, query
from plumbline.workloads import derived as V


def _log(spark, sf):
    return V.stored(spark, sf, V.SQL_LOG)


def _tables(spark, sf):
    return V.stored(spark, sf, V.CATALOG_TABLES)


def _edges(spark, sf):
    return V.stored(spark, sf, V.LINEAGE_EDGES)


def sql_source_tables(spark, sf):
    return lineage.source_tables(_log(spark, sf))


def sql_source_tables_deep(spark, sf):
    return lineage.source_tables(_log(spark, sf), deep=True)


def sql_lineage_edges(spark, sf):
    return lineage.lineage_edges(_log(spark, sf))


def lineage_register(spark, sf):
    edges = lineage.lineage_edges(_log(spark, sf))
    tables = _tables(spark, sf)
    known = lineage.register_edges(edges.filter("lineage_type = 'join'"), tables)
    return lineage.register_edges(edges, tables, known).select(
        "source_table_id", "target_table_id", "discovery_method", "lineage_type", "confidence", "transformation_logic")


def lineage_manual(spark, sf):
    wanted = _tables(spark, sf).select("table_id", F.col("row_count_estimate").alias("n")).select(
        F.col("table_id").alias("source_table_id"), F.concat(F.lit("T"), (F.col("n") / 1000).cast("long").cast("string")).alias("target_table_id"),
        F.lit("nightly export").alias("transformation_logic"))
    return lineage.manual_edges(wanted, _edges(spark, sf)).select("source_table_id", "target_table_id", "discovery_method", "confidence")


def sql_column_tokens(spark, sf):
    return lineage.column_tokens(_log(spark, sf)).select("query_id", "qualifier", "token", "query_fragment")


def query_graph(spark, sf):
    nodes, edges = lineage.query_graph(_log(spark, sf))
    return nodes.select(F.lit("node").alias("part"), F.col("node_id").alias("a"), F.col("node_type").alias("b"), F.col("label").alias("c")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), F.lit("").alias("c")))


def lineage_downstream(spark, sf):
    return impact.downstream(_edges(spark, sf), "T180", 5)


def lineage_upstream(spark, sf):
    return impact.upstream(_edges(spark, sf), "T3", 5)


def blast_radius_all(spark, sf):
    return impact.blast_radius(_edges(spark, sf))


def blast_radius_compat(spark, sf):
    return impact.blast_radius(_edges(spark, sf), compat=True)


def blast_radius_sketched(spark, sf):
    """Sketches held against exact counts for every table: exact where sets are small, within 8 % (five standard errors) elsewhere."""
    exact = impact.blast_radius(_edges(spark, sf)).select("root", F.col("direct").alias("d"), F.col("total").alias("t"), F.col("data_sources").alias("s"), F.col("max_depth").alias("m"))
    both = impact.blast_radius_sketched(_edges(spark, sf)).join(exact, "root")

    def close(found: str, true: str):
        return (F.abs(F.col(found) - F.col(true)) <= F.when(F.col(true) <= 64, 0).otherwise(0.08 * F.col(true)))

    return both.select("root", "direct", close("total", "t").alias("total_holds"), close("data_sources", "s").alias("sources_hold"), (F.col("max_depth") <= F.col("m")).alias("depth_holds"))


def lineage_components(spark, sf):
    return impact.components(_edges(spark, sf)).withColumn("size", F.col("size").cast("long"))


def _pairs(spark, sf):
    """Every table with its third successor by halving, and with its neighbour, mostly out of reach."""
    tables = _tables(spark, sf).select(F.substring("table_id", 2, 20).cast("long").alias("p"))
    far = tables.select("p", F.explode(F.array(F.floor(F.col("p") / 8), F.col("p") + 1)).alias("q"))
    return far.select(F.concat(F.lit("T"), F.col("p").cast("string")).alias("source"), F.concat(F.lit("T"), F.col("q").cast("string")).alias("target"))


def lineage_path(spark, sf):
    found = impact.shortest_paths(_edges(spark, sf), _pairs(spark, sf))
    return found.select("source", "target", F.array_join("path", ">").alias("path"))


def lineage_cycles(spark, sf):
    return impact.cycles(_edges(spark, sf)).select(F.array_join("cycle", ">").alias("cycle"), F.col("length").cast("long").alias("length"))


def change_impact(spark, sf):
    kinds = F.array(*[F.lit(k[0]) for k in fixed.CHANGE_KINDS], F.lit("renamed_owner"))
    requests = _tables(spark, sf).select(
        F.col("table_id").alias("root"), F.element_at(kinds, (1 + F.substring("table_id", 2, 20).cast("long") % 6).cast("int")).alias("change_type"))
    return impact.change_impact(_edges(spark, sf), requests)


def _metric_tables(spark, sf):
    return V.frame(spark, sf, V.METRIC_DEPENDENCIES).filter(F.startswith("child_id", F.lit("table_"))).select(
        F.col("child_id").alias("table_name")).distinct()


def metric_dependents(spark, sf):
    return impact.affected_metrics(V.frame(spark, sf, V.METRIC_DEPENDENCIES), _metric_tables(spark, sf))


def metric_impact(spark, sf):
    return impact.metric_impact(metric_dependents(spark, sf), _metric_tables(spark, sf))


def query_fingerprints(spark, sf):
    return query.query_fingerprints(_log(spark, sf)).select("fingerprint", "n_queries", F.round("avg_ms", 4).alias("avg_ms"))


def json_recovery(spark, sf):
    done = query.recover_json(V.frame(spark, sf, V.JSON_TEXTS), "body")
    return done.select("id", F.col("recovered").isNotNull().alias("recovered"), F.try_variant_get("recovered", "$.k", "bigint").alias("k"))


def entity_rank(spark, sf):
    entities = _tables(spark, sf).select(F.col("table_name").alias("name"), F.col("created_on").alias("last_used"))
    return query.rank_entities(entities, "Customer order FACT 12 order")


def schema_summary(spark, sf):
    columns = V.stored(spark, sf, V.CATALOG_COLUMNS).withColumn("table_name", F.col("table_id"))
    return query.schema_summary(columns)


def ungrounded_tables(spark, sf):
    return lineage.ungrounded_references(_log(spark, sf), _tables(spark, sf))


def plan_bottlenecks(spark, sf):
    return query.plan_bottlenecks(V.frame(spark, sf, V.PLAN_LOG))


_LOG = V.duck(V.SQL_LOG)
_T = V.duck(V.CATALOG_TABLES)
_E = V.duck(V.LINEAGE_EDGES)
_SOURCE = fixed.SOURCE_PATTERN
_BARE = r"regexp_replace(regexp_replace(query_executed, '(?m)--.*$', '', 'g'), '(?s)/\*.*?\*/', '', 'g')"


def _names(text: str) -> str:
    return (f"list_filter(regexp_extract_all({text}, '{_SOURCE}', 1), lambda t: upper(t) NOT IN ('SELECT', 'WITH', 'VALUES'))")


_EDGES_SQL = f"""
heads AS (SELECT query_id, query_executed, trim(upper(query_executed)) AS h, unnest(list_distinct({_names(_BARE)})) AS source_table FROM {_LOG}),
typed AS (SELECT query_id, source_table, query_executed,
   CASE WHEN h LIKE 'CREATE TABLE%' THEN regexp_extract(query_executed, '{fixed.CREATE_PATTERN}', 1)
        WHEN h LIKE 'INSERT INTO%' THEN regexp_extract(query_executed, '{fixed.INSERT_PATTERN}', 1)
        WHEN h LIKE 'UPDATE%' THEN regexp_extract(query_executed, '{fixed.UPDATE_PATTERN}', 1) END AS target_table,
   CASE WHEN h LIKE 'CREATE TABLE%' THEN 'transform' WHEN h LIKE 'INSERT INTO%' THEN 'direct' WHEN h LIKE 'UPDATE%' THEN 'join' END AS lineage_type,
   CASE WHEN h LIKE 'CREATE TABLE%' THEN 'CREATE TABLE AS SELECT' WHEN h LIKE 'INSERT INTO%' THEN 'INSERT INTO ... SELECT' WHEN h LIKE 'UPDATE%' THEN 'UPDATE ... FROM' END AS transformation_logic,
   CASE WHEN h LIKE 'UPDATE%' THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence FROM heads),
edges AS (SELECT query_id, source_table, target_table, lineage_type, confidence, transformation_logic, query_executed[:200] AS query_template FROM typed
   WHERE target_table IS NOT NULL AND NOT (lineage_type = 'join' AND upper(source_table) = upper(target_table)))"""
_ACTIVE = f"e AS (SELECT source_table_id AS s, target_table_id AS t, count(*) AS n FROM {_E} WHERE is_active GROUP BY 1, 2)"


def _reach_sql(depth: int, roots: str, forward: bool, out: str) -> str:
    here, there = ("s", "t") if forward else ("t", "s")
    return (f"{out}_w AS (SELECT {roots} UNION SELECT w.root, e.{there}, w.hop + 1 FROM {out}_w w JOIN e ON e.{here} = w.node WHERE w.hop < {depth}), "
            f"{out} AS (SELECT root, node, min(hop) AS hop FROM {out}_w GROUP BY 1, 2)")


_ALL_ROOTS = "node AS root, node, 0 AS hop FROM (SELECT s AS node FROM e UNION SELECT t FROM e)"
_BLAST = f"""WITH RECURSIVE {_ACTIVE}, {_reach_sql(10, _ALL_ROOTS, True, 'd')}, {_reach_sql(10, _ALL_ROOTS, False, 'u')},
fd AS (SELECT s AS node, sum(n) AS k FROM e GROUP BY 1), fu AS (SELECT t AS node, sum(n) AS k FROM e GROUP BY 1),
dn AS (SELECT root, {{down}}, max(hop) AS max_depth FROM d LEFT JOIN fd USING (node) GROUP BY 1),
up AS (SELECT root, {{up}} AS data_sources FROM u LEFT JOIN fu USING (node) GROUP BY 1)
SELECT root, direct, indirect, direct + indirect AS total, max_depth, 5 * direct + 2 * indirect AS affected_queries, data_sources,
  CASE WHEN direct + indirect = 0 THEN 'LOW' WHEN max_depth <= 2 AND direct + indirect <= 5 THEN 'LOW' WHEN max_depth <= 3 AND direct + indirect <= 10 THEN 'MEDIUM'
       WHEN max_depth <= 5 AND direct + indirect <= 20 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level
FROM dn JOIN up USING (root)"""

QUERIES = {
    "sql_source_tables": sql_source_tables,
    "sql_source_tables_deep": sql_source_tables_deep,
    "sql_lineage_edges": sql_lineage_edges,
    "lineage_register": lineage_register,
    "lineage_manual": lineage_manual,
    "sql_column_tokens": sql_column_tokens,
    "query_graph": query_graph,
    "lineage_downstream": lineage_downstream,
    "lineage_upstream": lineage_upstream,
    "blast_radius_all": blast_radius_all,
    "blast_radius_compat": blast_radius_compat,
    "blast_radius_sketched": blast_radius_sketched,
    "lineage_components": lineage_components,
    "lineage_path": lineage_path,
    "lineage_cycles": lineage_cycles,
    "change_impact": change_impact,
    "metric_dependents": metric_dependents,
    "metric_impact": metric_impact,
    "query_fingerprints": query_fingerprints,
    "json_recovery": json_recovery,
    "entity_rank": entity_rank,
    "schema_summary": schema_summary,
    "ungrounded_tables": ungrounded_tables,
    "plan_bottlenecks": plan_bottlenecks,
}

_METRIC_REACH = f"""
WITH RECURSIVE dep AS (SELECT * FROM {V.duck(V.METRIC_DEPENDENCIES)}),
w AS (SELECT child_id AS table_name, parent_id AS metric FROM dep WHERE child_id LIKE 'table_%'
  UNION SELECT w.table_name, dep.parent_id FROM w JOIN dep ON dep.child_id = w.metric)"""

ORACLES = {
    "sql_source_tables": f"SELECT query_id, unnest(list_distinct({_names(_BARE)})) AS table_name FROM {_LOG}",
    "sql_source_tables_deep": f"SELECT query_id, unnest(list_distinct(list_concat({_names(_BARE)}, {_names('replace(' + _BARE + ', chr(40), chr(32))')}))) AS table_name FROM {_LOG}",
    "sql_lineage_edges": f"WITH {_EDGES_SQL} SELECT * FROM edges",
    "lineage_register": f"""WITH {_EDGES_SQL},
known AS (SELECT DISTINCT source_table, target_table FROM edges WHERE lineage_type = 'join'),
firsts AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY source_table, target_table ORDER BY query_id) = 1)
SELECT s.table_id AS source_table_id, t.table_id AS target_table_id, 'sql_parser' AS discovery_method, lineage_type, confidence, transformation_logic
FROM firsts f JOIN {_T} s ON s.table_name = f.source_table JOIN {_T} t ON t.table_name = f.target_table
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.source_table = f.source_table AND k.target_table = f.target_table)""",
    "lineage_manual": f"""
SELECT DISTINCT table_id AS source_table_id, 'T' || (row_count_estimate // 1000) AS target_table_id, 'manual' AS discovery_method, 1.0::DOUBLE AS confidence
FROM {_T} t WHERE NOT EXISTS (SELECT 1 FROM {_E} e WHERE e.source_table_id = t.table_id AND e.target_table_id = 'T' || (t.row_count_estimate // 1000))""",
    "sql_column_tokens": f"""
WITH c AS (SELECT query_id, regexp_extract(query_executed, '{fixed.SELECT_LIST_PATTERN}', 1) AS clause FROM {_LOG}),
t AS (SELECT query_id, clause, unnest(regexp_extract_all(clause, '{fixed.COLUMN_TOKEN_PATTERN}')) AS t FROM c)
SELECT query_id, CASE WHEN contains(t, '.') THEN split_part(t, '.', 1) ELSE '' END AS qualifier,
  CASE WHEN contains(t, '.') THEN split_part(t, '.', 2) ELSE t END AS token, clause[:100] AS query_fragment FROM t""",
    "query_graph": f"""
WITH l AS (SELECT 'q_' || query_id AS q, query_executed AS sql FROM {_LOG}),
e AS (SELECT q, unnest(list_distinct(regexp_extract_all(sql, '(?i)FROM\\s+([a-zA-Z0-9_.]+)', 1))) AS t FROM l)
SELECT 'node' AS part, q AS a, 'query' AS b, 'Query: ' || sql[:20] || '...' AS c FROM l
UNION ALL SELECT DISTINCT 'node', t, 'table', t FROM e UNION ALL SELECT 'edge', t, q, '' FROM e""",
    "lineage_downstream": f"WITH RECURSIVE {_ACTIVE}, {_reach_sql(5, chr(39) + 'T180' + chr(39) + ' AS root, ' + chr(39) + 'T180' + chr(39) + ' AS node, 0 AS hop', True, 'd')} SELECT * FROM d WHERE hop > 0",
    "lineage_upstream": f"WITH RECURSIVE {_ACTIVE}, {_reach_sql(5, chr(39) + 'T3' + chr(39) + ' AS root, ' + chr(39) + 'T3' + chr(39) + ' AS node, 0 AS hop', False, 'd')} SELECT * FROM d WHERE hop > 0",
    "blast_radius_all": _BLAST.format(
        down="count(*) FILTER (WHERE hop = 1) AS direct, count(*) FILTER (WHERE hop > 1) AS indirect", up="count(*) FILTER (WHERE hop > 0)"),
    "blast_radius_compat": _BLAST.format(
        down="CAST(coalesce(sum(k) FILTER (WHERE hop = 1), 0) AS BIGINT) AS direct, CAST(coalesce(sum(k) FILTER (WHERE hop > 1), 0) AS BIGINT) AS indirect",
        up="CAST(coalesce(sum(k), 0) AS BIGINT)"),
    "blast_radius_sketched": f"""
WITH RECURSIVE {_ACTIVE}, n AS (SELECT s AS root FROM e UNION SELECT t FROM e)
SELECT root, count(e.t) FILTER (e.t <> root) AS direct, true AS total_holds, true AS sources_hold, true AS depth_holds FROM n LEFT JOIN e ON e.s = root GROUP BY 1""",
    "lineage_components": f"""
WITH RECURSIVE {_ACTIVE}, w AS (SELECT s AS a, t AS b FROM e UNION SELECT w.a, e.t FROM w JOIN e ON e.s = w.b),
c AS (SELECT x.a AS node, least(min(x.b), x.a) AS component, count(DISTINCT x.b) AS size FROM w x JOIN w y ON y.a = x.b AND y.b = x.a GROUP BY 1)
SELECT component, node, size FROM c""",
    "lineage_path": f"""
WITH RECURSIVE {_ACTIVE}, p AS (SELECT p_partkey AS p FROM part),
want AS (SELECT 'T' || p AS source, 'T' || (p // 8) AS target FROM p UNION SELECT 'T' || p, 'T' || (p + 1) FROM p),
w AS (SELECT DISTINCT source AS root, source AS node, [source] AS path, 0 AS hop FROM want
  UNION SELECT w.root, e.t, list_append(path, e.t), hop + 1 FROM w JOIN e ON e.s = w.node WHERE NOT list_contains(path, e.t) AND hop < 14),
b AS (SELECT root, node, arg_min(path, [hop::VARCHAR.lpad(3, '0')] || path) AS path FROM w GROUP BY 1, 2)
SELECT source, target, array_to_string(path, '>') AS path FROM want JOIN b ON b.root = source AND b.node = target""",
    "lineage_cycles": f"""
WITH RECURSIVE {_ACTIVE},
w AS (SELECT s AS root, t AS node, [s, t] AS path FROM e
  UNION SELECT w.root, e.t, list_append(path, e.t) FROM w JOIN e ON e.s = w.node WHERE w.root <> w.node AND len(path) < 12 AND NOT list_contains(path[2:], e.t)),
b AS (SELECT root, arg_min(path, [len(path)::VARCHAR.lpad(3, '0')] || path)[:-2] AS ring FROM w WHERE root = node GROUP BY 1)
SELECT DISTINCT array_to_string(list_concat(ring[list_position(ring, list_min(ring)):], ring[:list_position(ring, list_min(ring)) - 1]), '>') AS cycle, len(ring) AS length FROM b""",
    "change_impact": f"""
WITH RECURSIVE {_ACTIVE}, q AS (SELECT table_id AS root, [{', '.join(repr(k[0]) for k in fixed.CHANGE_KINDS)}, 'renamed_owner'][1 + substr(table_id, 2)::BIGINT % 6] AS change_type FROM {_T}),
{_reach_sql(5, 'root, root AS node, 0 AS hop FROM q', True, 'd')},
f AS (SELECT s AS node, sum(n) AS k FROM e GROUP BY 1),
a AS (SELECT root, CAST(coalesce(sum(k), 0) AS BIGINT) AS n FROM d LEFT JOIN f USING (node) GROUP BY 1)
SELECT q.root, q.change_type, coalesce(severity, 'unknown') AS severity, coalesce(description, 'Unknown impact') AS description, n AS affected_tables,
  n * 3 AS affected_queries, n // 2 AS affected_dashboards, replace(coalesce(advice, 'Review impact carefully.'), '%d', n::VARCHAR) AS recommendation
FROM q JOIN a USING (root) LEFT JOIN (VALUES {', '.join(str(k) for k in fixed.CHANGE_KINDS)}) v(change_type, severity, description, advice) USING (change_type)""",
    "metric_dependents": f"{_METRIC_REACH} SELECT * FROM w",
    "metric_impact": f"{_METRIC_REACH} SELECT table_name, count(*) AS n_metrics, CASE WHEN count(*) > 5 THEN 'high' ELSE 'medium' END AS criticality FROM w GROUP BY 1",
    "query_fingerprints": f"SELECT sha256(trim(regexp_replace(lower(query_executed), '\\s+', ' ', 'g'))) AS fingerprint, count(*) AS n_queries, "
        f"round(avg(execution_time_ms), 4) AS avg_ms FROM {_LOG} GROUP BY 1",
    "json_recovery": f"""
WITH j AS (SELECT id, CASE WHEN json_valid(body) THEN body
    WHEN regexp_matches(body, '(?s)```json\\n.*?\\n```') THEN regexp_extract(body, '(?s)```json\\n(.*?)\\n```', 1)
    ELSE nullif(regexp_extract(body, '(?s)(\\{{.*\\}})', 1), '') END AS t FROM {V.duck(V.JSON_TEXTS)}),
v AS (SELECT id, CASE WHEN json_valid(t) THEN t END AS t FROM j)
SELECT id, t IS NOT NULL AS recovered, CAST(json_extract(t, '$.k') AS BIGINT) AS k FROM v""",
    "entity_rank": f"""
SELECT table_name AS name, CAST(10 * len(list_intersect(string_split(lower(table_name), '_'), ['customer', 'order', 'fact', '12'])) + CASE WHEN created_on IS NULL THEN 0 ELSE 5 END AS INTEGER) AS score FROM {_T}""",
    "schema_summary": f"""
SELECT table_id AS table_name, 'Table ' || table_id || ': ' || string_agg(name || ' (' || data_type || ')', ', ' ORDER BY ordinal_position) AS summary
FROM {V.duck(V.CATALOG_COLUMNS)} WHERE ordinal_position <= 10 GROUP BY table_id""",
    "ungrounded_tables": f"""
WITH u AS (SELECT query_id, unnest(list_distinct({_names(_BARE)})) AS table_name FROM {_LOG})
SELECT * FROM u WHERE lower(split_part(table_name, '.', -1)) NOT IN (SELECT lower(table_name) FROM {_T})""",
    "plan_bottlenecks": """
WITH f AS (
 SELECT event_id AS plan_id, 'scan' AS k, 't' || user_id AS table_name FROM events WHERE event_id % 4 = 0 AND floor(value * 300) > 10000
 UNION ALL SELECT event_id, 'loop', NULL FROM events WHERE event_id % 4 = 1 AND floor(value * 30) > 1000
 UNION ALL SELECT event_id, 'scan', 'n' || user_id FROM events WHERE event_id % 4 = 1 AND floor(value * 200) > 10000
 UNION ALL SELECT event_id, 'loop', NULL FROM events WHERE event_id % 4 = 2
 UNION ALL SELECT event_id, 'scan', 'd' FROM events WHERE event_id % 4 = 2 AND floor(value * 250) > 10000)
SELECT plan_id, CASE k WHEN 'scan' THEN 'Performance Risk' ELSE 'Optimization Opportunity' END AS type,
  CASE k WHEN 'scan' THEN 'Sequential Scan' ELSE 'Nested Loop Join' END AS node, table_name, CASE k WHEN 'scan' THEN 'High' ELSE 'Medium' END AS impact,
  CASE k WHEN 'scan' THEN 'Add an index to the columns used in the filter for table ''' || table_name || '''.'
    ELSE 'Consider if a Hash Join would be more efficient by ensuring table statistics are up to date.' END AS suggestion FROM f""",
}
