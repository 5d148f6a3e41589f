"""Registered jobs: catalog, relationships, semantic layer, KPIs, search and findings."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed_values as fixed
from plumbline.operators import inclusion, kpis, recommend, refresh, relations, search, semantic
from plumbline.operators.catalog_index import CatalogIndex
from plumbline.operators.profiling import profile_history
from plumbline.operators.quality import ScoredTable
from plumbline.session import cut_lineage, work_path
from plumbline.sources.catalog import list_columns, table_sizes
from plumbline.sources.tables import load
from plumbline.workloads import derived as V

STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
AS_OF = dt.datetime(2024, 2, 1)
SALES_END = dt.datetime(2001, 8, 1)
SUFFIXES = ("_id", "id", "key")


def _tables(spark, sf):
    return V.stored(spark, sf, V.CATALOG_TABLES).withColumn("created_at", F.col("created_on").cast("timestamp"))


def _columns(spark, sf):
    return V.stored(spark, sf, V.CATALOG_COLUMNS)


def _star(spark, sf):
    return {t: load(spark, sf, t) for t in STAR}


def catalog_columns(spark, sf):
    star = _star(spark, sf)
    columns = list_columns(spark, star).select("table_name", "name", "ordinal_position")
    return columns.join(table_sizes(star), "table_name")


def refresh_summary(spark, sf):
    broken = load(spark, sf, "orders").withColumn("o_custkey", F.raise_error(F.lit("unreadable block")))
    tables = {
        "customer": ScoredTable(load(spark, sf, "customer"), ("c_custkey",)),
        "nation": ScoredTable(load(spark, sf, "nation"), ("n_nationkey",)),
        "orders": ScoredTable(load(spark, sf, "orders"), ("o_orderkey",)),
        "broken": ScoredTable(broken, ()),
    }
    sync = spark.createDataFrame([(n, AS_OF) for n in tables], "table_name string, last_metadata_sync timestamp")
    assets = spark.createDataFrame([], "table_name string, sla_freshness_hours int")
    status = refresh.refresh_catalog(spark, tables, sync, assets, AS_OF, work_path(spark, "refresh"), SUFFIXES)
    return status.select("step", "table_name", "status", "n_rows")


def _constraints(spark, sf):
    return V.frame(spark, sf, CONSTRAINTS)


CONSTRAINTS = f"""
SELECT upper({V.table_name('p_partkey')}) AS source_table, concat({V.entity_word(V.half('p_partkey'))}, '_id') AS source_column,
       {V.table_name(V.half('p_partkey'))} AS target_table, 'ID' AS target_column
FROM part WHERE p_partkey > 1 AND p_partkey % 2 = 0"""


def _explicit(spark, sf):
    return relations.explicit_relationships(_columns(spark, sf), _tables(spark, sf), _constraints(spark, sf))


def _inferred(spark, sf):
    return relations.infer_relationships(_columns(spark, sf), _tables(spark, sf), _explicit(spark, sf))


def _all_relations(spark, sf, scoped=True):
    """Declared and inferred keys, inside connections or over the whole catalog; the declared ones are cut off first, as they are read three times."""
    tables = _tables(spark, sf) if scoped else _tables(spark, sf).drop("connection_id")
    declared = cut_lineage(relations.explicit_relationships(_columns(spark, sf), tables, _constraints(spark, sf)))
    return declared.unionByName(relations.infer_relationships(_columns(spark, sf), tables, declared))


REL = ["source_table", "source_column", "target_table", "target_column", "relationship_type", "confidence_score",
       "discovery_method"]


def fk_explicit(spark, sf):
    return _explicit(spark, sf).select(*REL)


def fk_inferred(spark, sf):
    return _inferred(spark, sf).select(*REL)


def fk_inferred_tpch(spark, sf):
    """Key columns of the star schema by name, all verified by one pass over each table."""
    star = _star(spark, sf)
    columns = list_columns(spark, star)
    names = columns.select("table_id", "table_name").distinct()
    found = relations.infer_relationships(columns.drop("table_name"), names, suffixes=("_id", "id", "key"),
                                          strip_prefix=True, target_key="same").select(*REL)
    held = inclusion.inclusions(star, _whole_columns(star))
    return found.join(held, REL[:4], "left").select(*REL, F.coalesce("containment_pct", F.lit(0.0)).alias("containment_pct"))


def _whole_columns(star):
    return {t: [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)] for t, df in star.items()}


def inclusion_dependencies(spark, sf):
    """Every pair of whole-number columns of the star schema, the rows of one matched by the other."""
    star = _star(spark, sf)
    return inclusion.inclusions(star, _whole_columns(star)).drop("n_rows")


def relationship_text(spark, sf):
    everything = _all_relations(spark, sf)
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("Many-to-One", "one_to_many", "many_to_many", "1:1", "unknown")]),
                         1 + F.length("source_table") % 5)
    told = relations.relationship_text(everything.withColumn("relationship_type", kinds))
    return told.select("source_table", "source_column", "target_table", "explanation")


def join_path_text(spark, sf):
    """Two-step paths: a table, its parent, its parent's parent."""
    rel = _all_relations(spark, sf)
    first = rel.select(F.col("source_table").alias("a"), F.col("target_table").alias("b"))
    second = rel.select(F.col("source_table").alias("b"), F.col("target_table").alias("c"))
    paths = first.join(second, "b").select(F.array("a", "b", "c").alias("path"))
    short = first.select(F.array("a", "b").alias("path"))
    told = relations.join_path_text(paths.unionByName(short))
    return told.select(F.array_join("path", ">").alias("path"), "explanation")


def many_to_many_text(spark, sf):
    """Junctions of the whole catalog, also those whose keys lead to another connection."""
    rel = _all_relations(spark, sf, scoped=False)
    return relations.many_to_many_text(rel)


def entity_types(spark, sf):
    rel = _all_relations(spark, sf)
    return semantic.map_entities(_columns(spark, sf), _tables(spark, sf), rel)


def _roles(spark, sf):
    return semantic.column_roles(_columns(spark, sf))


def metric_registry(spark, sf):
    """Metrics of one connection after a pack of named metrics without formulas was added."""
    current = V.frame(spark, sf, V.METRICS)
    pack = current.filter(F.col("formula").isNull()).select(
        F.lit("conn_b").alias("connection_id"), "name", F.lit(None).cast("string").alias("formula"),
        F.lit("from pack").alias("description"), F.lit(None).cast("boolean").alias("is_certified"))
    return semantic.register(current, pack).filter(F.col("connection_id") == "conn_b").select("name", "formula", "description")


LINKS = [
    semantic.Link("lineitem", "l_orderkey", "orders", "o_orderkey"),
    semantic.Link("orders", "o_custkey", "customer", "c_custkey"),
    semantic.Link("customer", "c_nationkey", "nation", "n_nationkey"),
    semantic.Link("nation", "n_regionkey", "region", "r_regionkey"),
    semantic.Link("lineitem", "l_partkey", "part", "p_partkey"),
]
METRICS = {
    "revenue": semantic.Metric("revenue", "round(sum(l_extendedprice * (1 - l_discount)), 4)", ("lineitem",)),
    "order_value": semantic.Metric("order_value", "round(avg(o_totalprice), 4)", ("orders",)),
}


def metric_revenue_by_region(spark, sf):
    return semantic.compile_metric("revenue", METRICS, _star(spark, sf), LINKS, ["r_name", "p_brand"])


def metric_filtered(spark, sf):
    return semantic.compile_metric("order_value", METRICS, _star(spark, sf), LINKS, ["o_orderpriority"],
                                   {"n_name": _nation(spark, sf), "o_orderstatus": "F", "bad key;": 1})


def _nation(spark, sf):
    return load(spark, sf, "nation").agg(F.min("n_name")).first()[0]


def metric_trust(spark, sf):
    return semantic.trust_scores(V.frame(spark, sf, V.METRICS))


def top10_customers(spark, sf):
    """Top customers by revenue of the year before the as-of date."""
    orders = kpis.last_n_months(load(spark, sf, "orders"), "o_orderdate", SALES_END, 12).select("o_orderkey", "o_custkey")
    lineitem = load(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    best = kpis.top_n(joined, "o_custkey", F.round(F.sum("rev"), 4), 10, "revenue")
    return best.join(load(spark, sf, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select(
        "c_name", "revenue")


def _sales(spark, sf):
    star = _star(spark, sf)
    return (
        star["orders"].join(star["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(star["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(star["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )


def sales_by_region_12m(spark, sf):
    recent = kpis.last_n_months(_sales(spark, sf), "o_orderdate", SALES_END, 12)
    return recent.groupBy("r_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total_sales"), F.count(F.lit(1)).alias("n_orders"))


def revenue_yoy(spark, sf):
    compared = kpis.period_over_period(load(spark, sf, "orders"), "o_orderdate", F.round(F.sum("o_totalprice"), 2))
    return compared.withColumn("change_pct", F.round("change_pct", 4))


def change_drivers(spark, sf):
    year = F.year("o_orderdate")
    drivers = kpis.change_drivers(_sales(spark, sf), "r_name", F.sum("o_totalprice"), year == 1999, year == 2000)
    return drivers.select("r_name", F.round("delta", 2).alias("delta"), F.round("contribution_pct", 4).alias("contribution_pct"))


def semantic_search(spark, sf):
    usage = V.frame(spark, sf, V.AUDIT_LOG).groupBy(F.col("resource_id").alias("id")).agg(F.count(F.lit(1)).alias("n_queries"))
    ranked = search.semantic_search(None, None, "customer order date", AS_OF, limit=100, workspace_id="ws1", usage_df=usage, index=catalog_index(spark, sf))
    return ranked.select("resource_type", "id", "name", "relevance_score", *[
        F.round(c, 6).alias(c) for c in ("popularity_score", "recency_score", "combined_score")])


def search_suggestions(spark, sf):
    return search.suggest(_tables(spark, sf), _columns(spark, sf), "Cu")


_INDEXES: dict[tuple[str, str], CatalogIndex] = {}


def catalog_index(spark, sf):
    """The index of the derived catalog, built once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = CatalogIndex.build(_tables(spark, sf), _columns(spark, sf))
    return _INDEXES[key]


def metadata_search(spark, sf):
    return catalog_index(spark, sf).search("order")


def metadata_search_scan(spark, sf):
    """The same search without an index."""
    return search.metadata_search(_tables(spark, sf), _columns(spark, sf), "order")


def catalog_search(spark, sf):
    return search.catalog_search(_tables(spark, sf), _columns(spark, sf), "card", "public")


def table_details(spark, sf):
    """Every table with its columns and tags."""
    tags = load(spark, sf, "lineitem").select(F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("table_id"), F.lit("status").alias("tag_type"),
                                              F.col("l_returnflag").alias("tag_value")).distinct()
    found = search.table_details(_tables(spark, sf), _columns(spark, sf), tags)
    return found.select(
        "table_id", "table_name", "owner_id", F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["data_type"])), ", ").alias("columns"),
        F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["tag_type"], t["tag_value"])), ", ").alias("tags"))


def classification_upsert(spark, sf):
    """Manual classifications of every third customer's table, put over the detected ones."""
    detected = V.frame(spark, sf, V.CLASSIFICATIONS).select(
        "table_id", "sensitivity_level", "contains_pii", "masking_enabled", "access_restricted", F.split("allowed_roles", ",").alias("allowed_roles"),
        F.lit("detector").alias("classified_by"), F.lit(True).alias("auto_detected"))
    key = F.col("c_custkey")
    asked = load(spark, sf, "customer").where(key % 3 == 0).select(
        F.concat(F.lit("C"), key.cast("string")).alias("table_id"), F.when(key % 2 == 0, "restricted").otherwise("internal").alias("sensitivity_level"), (key % 5 == 0).alias("contains_pii"),
        F.when(key % 4 == 0, F.lit(True)).alias("masking_enabled"), F.lit(None).cast("boolean").alias("access_restricted"),
        F.when(key % 9 == 0, F.array(F.lit("auditor"))).alias("allowed_roles"))
    return search.classify(detected, asked).withColumn("allowed_roles", F.array_join("allowed_roles", ","))


def tags_by_table(spark, sf):
    """Tags per table; repeated tags are folded before the join."""
    tags = load(spark, sf, "lineitem").select(F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("table_id"),
                                              F.concat_ws(":", F.lit("status"), "l_returnflag").alias("tag")).distinct()
    listed = tags.groupBy("table_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return _tables(spark, sf).select("table_id", "table_name").join(listed, "table_id", "left")


def asset_upsert(spark, sf):
    """Partial update: only the fields given in the change replace the stored ones."""
    tables = _tables(spark, sf)
    current = tables.filter("row_count_estimate < 30000").select("table_id", F.col("owner_id").alias("owner"), F.lit(24).alias("sla"))
    changes = tables.filter("row_count_estimate >= 20000").select(
        "table_id", F.when(F.col("schema_name") == "sales", "sales_team").alias("owner"), F.lit(None).cast("int").alias("sla"))
    return search.upsert(current, changes, ["table_id"])


def _profile_history(spark, sf):
    """Last snapshots of catalog tables: part key p is profiled in the quarters its items shipped; older quarters are no longer read."""
    items = load(spark, sf, "lineitem").select(
        F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("t"), F.col("l_shipdate").alias("at"),
        F.when(F.col("l_quantity") > 40, F.col("l_quantity")).alias("quantity"), F.col("l_returnflag").alias("flag"))
    newest = items.groupBy("t").agg(F.max(F.date_trunc("quarter", "at")).alias("last"))
    last = items.join(newest, "t").where(F.col("at") >= F.col("last")).drop("last")
    return cut_lineage(profile_history(last, "t", "at", "quarter"))


FOUND_AS_OF = dt.datetime(2001, 11, 1)


def recommendations(spark, sf):
    return recommend.recommendations(_tables(spark, sf), _columns(spark, sf), _profile_history(spark, sf), FOUND_AS_OF)


def recommendations_by_type(spark, sf):
    found = recommend.recommendations(_tables(spark, sf), _columns(spark, sf), _profile_history(spark, sf), FOUND_AS_OF)
    return recommend.by_type(found)


def exposed_columns(spark, sf):
    return recommend.exposed_columns(_columns(spark, sf))


_T = V.duck(V.CATALOG_TABLES)
_C = V.duck(V.CATALOG_COLUMNS)

_EXPLICIT = f"""
explicit AS (SELECT DISTINCT st.table_id AS sid, sc.column_id AS scid, st.table_name AS source_table, sc.name AS source_column,
   tt.table_id AS tid, tc.column_id AS tcid, tt.table_name AS target_table, tc.name AS target_column,
   'Many-to-One' AS relationship_type, 0.95::DOUBLE AS confidence_score, 'explicit_fk_constraint' AS discovery_method
 FROM {V.duck(CONSTRAINTS)} k JOIN {_T} st ON lower(st.table_name) = lower(k.source_table) JOIN {_C} sc ON sc.table_id = st.table_id AND lower(sc.name) = lower(k.source_column)
 JOIN {_T} tt ON lower(tt.table_name) = lower(k.target_table) AND tt.connection_id = st.connection_id JOIN {_C} tc ON tc.table_id = tt.table_id AND lower(tc.name) = lower(k.target_column))"""
_BASE = "rtrim(rtrim(replace(replace(lower({}), '_id', ''), 'id', ''), '_'), 's')"
_INFERRED = f"""
inferred AS (SELECT c.table_id AS sid, c.column_id AS scid, s.table_name AS source_table, c.name AS source_column,
   t.table_id AS tid, ic.column_id AS tcid, t.table_name AS target_table, ic.name AS target_column,
   'Many-to-One' AS relationship_type, 0.75::DOUBLE AS confidence_score, 'heuristic_name_match' AS discovery_method
 FROM {_C} c JOIN {_T} s USING (table_id) JOIN {_T} t ON rtrim(lower(t.table_name), 's') = {_BASE.format('c.name')} AND t.table_id <> s.table_id AND t.connection_id = s.connection_id
 JOIN {_C} ic ON ic.table_id = t.table_id AND lower(ic.name) = 'id'
 WHERE lower(c.name) LIKE '%id' AND NOT EXISTS (SELECT 1 FROM explicit e WHERE e.scid = c.column_id AND (e.tid = t.table_id OR e.tcid = ic.column_id)))"""
_RELS = f"WITH {_EXPLICIT}, {_INFERRED}, rel AS (SELECT * FROM explicit UNION ALL SELECT * FROM inferred)"
# the same over the whole catalog, whatever the connections of both ends
_RELS_ALL = _RELS.replace(" AND tt.connection_id = st.connection_id", "").replace(" AND t.connection_id = s.connection_id", "")
_REL_COLS = ", ".join(REL)


def _initcap(x: str) -> str:
    return (f"array_to_string(list_transform(list_filter(string_split(regexp_replace({x}, '_+', ' ', 'g'), ' '), lambda w: w <> ''), "
            "lambda w: upper(w[1]) || lower(w[2:])), ' ')")


def _label(x: str) -> str:
    cleaned = _initcap(f"regexp_replace({x}, '(_v[0-9]+|_temp|_archive|_staging|_fact|_dim|_bridge)$', '', 'i')")
    return f"regexp_replace({cleaned}, 's$', '')"


def _entity(x: str) -> str:
    return _initcap(f"regexp_replace({x}, '(_v[0-9]+|_temp|_archive|_staging|_fact|_dim)$', '', 'i')")


def _any(x: str, words) -> str:
    return f"regexp_matches(lower({x}), '{'|'.join(words)}')"


_MEASURE = f"({_any('data_type', fixed.NUMERIC_TYPES + ['double', 'real'])} AND {_any('name', fixed.MEASURE_WORDS)})"
_DIMENSION = f"({_any('data_type', fixed.TEMPORAL_TYPES)} OR {_any('name', fixed.DIMENSION_WORDS)})"
_AGG = "CASE " + " ".join(f"WHEN {_any('name', w)} THEN '{k}'" for k, w in fixed.AGGREGATION_WORDS.items()) + " ELSE 'SUM' END"
_KIND = ("CASE " + " ".join(f"WHEN {_any('name', w)} THEN '{k}'" for k, w in fixed.DIMENSION_KINDS.items())
         + f" WHEN {_any('data_type', fixed.TEXT_TYPES + ['string'])} THEN 'categorical' ELSE 'attribute' END")


def _relevance(name: str, description: str, terms) -> str:
    def one(t):
        return (f"CASE WHEN lower({name}) = '{t}' THEN 1.0 WHEN list_contains(string_split(lower({name}), '_'), '{t}') THEN 0.95 "
                f"WHEN contains(lower({name}), '{t}') THEN 0.85 WHEN contains(lower({description}), '{t}') THEN 0.60 ELSE 0.0 END::DOUBLE")
    return "greatest(" + ", ".join(one(t) for t in terms) + ")"


def _told(kind: str, *values: str) -> str:
    """The text of a finding as a DuckDB expression."""
    pieces = re.split("%[sd]", fixed.FINDING_TEXTS[kind].replace("%%", "%").replace("'", "''"))
    return " || ".join(f"'{p}'" + (f" || {v}" if v else "") for p, v in zip(pieces, [*values, ""]))


_TERMS = search.expand_query("customer order date")
_SALES_SQL = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_FOUND = f"""
WITH t AS (SELECT * FROM {_T}), c AS (SELECT * FROM {_C}),
snap AS (SELECT 'T' || l_partkey AS table_id, date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH AS created_at,
   100.0 * count(*) FILTER (WHERE NOT l_quantity > 40) / count(*) AS quantity, 0.0 AS flag FROM lineitem GROUP BY 1, 2),
latest AS (SELECT table_id, max(created_at) AS seen, arg_max(quantity, created_at) AS q FROM snap GROUP BY 1),
found AS (
 SELECT 'assign_owner' AS recommendation_type, 'table' AS resource_type, table_id AS resource_id, table_name AS resource_name, 'warning' AS severity,
   'Assign owner to ' || table_name AS title, {_told('assign_owner', 'table_name')} AS description FROM t WHERE coalesce(owner_id, '') = ''
 UNION ALL SELECT 'mask_pii', 'table', t.table_id, table_name, 'critical', 'Apply masking to ' || n || ' PII columns in ' || table_name, {_told('mask_pii', 'names')}
   FROM t JOIN (SELECT table_id, count(*) AS n, string_agg(name, ', ' ORDER BY ordinal_position, name) AS names FROM c WHERE is_pii AND NOT is_masked GROUP BY 1) x ON x.table_id = t.table_id
 UNION ALL SELECT 'fix_description', 'table', table_id, table_name, 'info', 'Add description to ' || table_name, {_told('fix_description', 'table_name')} FROM t WHERE description IS NULL OR length(trim(description)) <= 20
 UNION ALL SELECT 'flag_unused', 'table', t.table_id, table_name, 'info', 'Review ' || table_name || ' for deprecation', {_told('flag_unused', 'table_name', "date_diff('day', seen, TIMESTAMP '2001-11-01')")}
   FROM t JOIN latest USING (table_id) WHERE date_diff('day', seen, TIMESTAMP '2001-11-01') > 90
 UNION ALL SELECT 'improve_quality', 'column', t.table_id, table_name || '.quantity', 'high', 'High null percentage in quantity', {_told('improve_quality', "'quantity'", 'table_name', 'CAST(round_even(q, 0) AS BIGINT)')}
   FROM t JOIN latest USING (table_id) WHERE q > 50),
acts AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{a}')" for k, (_, a) in fixed.FINDINGS.items())}) v(recommendation_type, suggested_action))"""

QUERIES = {
    "catalog_columns": catalog_columns,
    "refresh_summary": refresh_summary,
    "fk_explicit": fk_explicit,
    "fk_inferred": fk_inferred,
    "fk_inferred_tpch": fk_inferred_tpch,
    "inclusion_dependencies": inclusion_dependencies,
    "relationship_text": relationship_text,
    "join_path_text": join_path_text,
    "many_to_many_text": many_to_many_text,
    "entity_types": entity_types,
    "column_roles": lambda s, sf: _roles(s, sf).select("column_id", "name", "role"),
    "metric_columns": lambda s, sf: _roles(s, sf).filter("metric_name IS NOT NULL").select("column_id", "metric_name", "aggregation"),
    "dimension_columns": lambda s, sf: _roles(s, sf).filter("dimension_type IS NOT NULL").select("column_id", "name", "dimension_type"),
    "fact_columns": lambda s, sf: _roles(s, sf).filter("is_fact").select("column_id", "name", "data_type"),
    "metric_registry": metric_registry,
    "metric_revenue_by_region": metric_revenue_by_region,
    "metric_filtered": metric_filtered,
    "metric_trust": metric_trust,
    "top10_customers": top10_customers,
    "sales_by_region_12m": sales_by_region_12m,
    "revenue_yoy": revenue_yoy,
    "change_drivers": change_drivers,
    "semantic_search": semantic_search,
    "search_suggestions": search_suggestions,
    "metadata_search": metadata_search,
    "metadata_search_scan": metadata_search_scan,
    "catalog_search": catalog_search,
    "table_details": table_details,
    "classification_upsert": classification_upsert,
    "tags_by_table": tags_by_table,
    "asset_upsert": asset_upsert,
    "recommendations": recommendations,
    "recommendations_by_type": recommendations_by_type,
    "exposed_columns": exposed_columns,
}

_WHOLE = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"],
          "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]}
_INCLUSIONS = "WITH v AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS BIGINT) AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for t, cs in _WHOLE.items() for c in cs) + """),
total AS (SELECT t, c, count(*) AS n_values, sum(n) AS n_rows FROM v GROUP BY 1, 2)
SELECT a.t AS source_table, a.c AS source_column, b.t AS target_table, b.c AS target_column, n_values, count(*) AS n_shared, CAST(sum(a.n) AS BIGINT) AS n_matched,
  round(100.0 * sum(a.n) / any_value(n_rows), 4) AS containment_pct
FROM v a JOIN v b ON a.v = b.v AND (a.t, a.c) <> (b.t, b.c) JOIN total ON total.t = a.t AND total.c = a.c GROUP BY 1, 2, 3, 4, 5"""

ORACLES = {
    "catalog_columns": "SELECT c.table_name, c.column_name AS name, CAST(c.ordinal AS INTEGER) AS ordinal_position, n.row_count FROM ("
        + " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, row_number() OVER () AS ordinal FROM (DESCRIBE SELECT * FROM {t})" for t in STAR)
        + ") c JOIN (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in STAR) + ") n USING (table_name)",
    "refresh_summary": """
SELECT step, table_name, CASE WHEN table_name = 'broken' THEN 'failed' ELSE 'completed' END AS status, CAST(n AS BIGINT) AS n_rows FROM (VALUES
 ('profile','customer',5),('profile','nation',3),('profile','orders',6),('profile','broken',0),
 ('pii','customer',1),('pii','nation',1),('pii','orders',0),('pii','broken',0),
 ('quality','customer',1),('quality','nation',1),('quality','orders',1),('quality','broken',0),
 ('relationships','all',2)) v(step, table_name, n) WHERE (SELECT count(*) FROM orders) > 0""",
    "fk_explicit": f"WITH {_EXPLICIT} SELECT {_REL_COLS} FROM explicit",
    "fk_inferred": f"WITH {_EXPLICIT}, {_INFERRED} SELECT {_REL_COLS} FROM inferred",
    "fk_inferred_tpch": "SELECT *, 'Many-to-One' AS relationship_type, 0.75::DOUBLE AS confidence_score, 'heuristic_name_match' AS discovery_method FROM ("
        + " UNION ALL ".join(
            f"SELECT '{a}' AS source_table, '{ac}' AS source_column, '{b}' AS target_table, '{bc}' AS target_column, "
            f"round(100.0 * count(*) FILTER (WHERE {ac} IN (SELECT {bc} FROM {b})) / count(*), 4) AS containment_pct FROM {a}"
            for a, ac, b, bc in [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
                                 ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
                                 ("nation", "n_regionkey", "region", "r_regionkey")]) + ")",
    "inclusion_dependencies": _INCLUSIONS,
    "relationship_text": f"""{_RELS},
typed AS (SELECT *, ['n:1', '1:n', 'n:n', '1:1', 'unknown'][1 + length(source_table) % 5] AS k FROM rel)
SELECT source_table, source_column, target_table,
  CASE k WHEN '1:n' THEN 'Each ' || {_label('source_table')} || ' can have zero or more ' || {_label('target_table')} || 's. '
         WHEN 'n:1' THEN 'Each ' || {_label('target_table')} || ' belongs to exactly one ' || {_label('source_table')} || '. '
         WHEN 'n:n' THEN 'Each ' || {_label('source_table')} || ' can be related to many ' || {_label('target_table')} || 's, and vice versa. '
         WHEN '1:1' THEN 'Each ' || {_label('source_table')} || ' maps to exactly one ' || {_label('target_table')} || '. '
         ELSE 'There is a relationship between ' || {_label('source_table')} || ' and ' || {_label('target_table')} || '. ' END
  || 'Join on ' || source_column || ' = ' || target_column || '.'
  || CASE WHEN confidence_score < 0.8 THEN ' ⚠️ (Low confidence: 75%)' ELSE ' ✓ (High confidence: 95%)' END AS explanation FROM typed""",
    "join_path_text": f"""{_RELS},
a AS (SELECT source_table AS a, target_table AS b FROM rel)
SELECT x.a || '>' || x.b || '>' || y.b AS path, 'To join ' || {_label('x.a')} || ' to ' || {_label('y.b')} || ', traverse: ' || {_label('x.a')} || ' → ' || {_label('x.b')} || ' → ' || {_label('y.b')} AS explanation
FROM a x JOIN a y ON x.b = y.a
UNION ALL SELECT a || '>' || b, 'To join ' || {_label('a')} || ' to ' || {_label('b')} || ', use: ' || {_label('a')} || ' → ' || {_label('b')} FROM a""",
    "many_to_many_text": f"""{_RELS_ALL},
e AS (SELECT DISTINCT a.source_table AS junction_table, a.target_table AS left_table, b.target_table AS right_table FROM rel a JOIN rel b ON a.source_table = b.source_table AND a.target_table < b.target_table)
SELECT *, 'Each ' || {_label('left_table')} || ' can be associated with many ' || {_label('right_table')} || 's, and vice versa, through the ' || {_label('junction_table')} || ' table.' AS explanation FROM e""",
    "entity_types": f"""{_RELS},
n AS (SELECT table_id, count(*) AS nc, count(*) FILTER (WHERE is_foreign_key) AS nf FROM {_C} GROUP BY 1),
j AS (SELECT t.table_name, nc, nf, (SELECT count(*) FROM rel r WHERE r.sid = t.table_id OR r.tid = t.table_id) AS nl FROM {_T} t JOIN n USING (table_id)),
k AS (SELECT *, CASE WHEN nc > 10 AND nf >= 2 AND nl > 2 THEN 'fact' WHEN nc <= 10 AND nf <= 1 THEN 'dimension'
   WHEN regexp_matches(lower(table_name), 'bridge|junction') THEN 'bridge' ELSE 'entity' END AS entity_type FROM j)
SELECT table_name, {_entity('table_name')} AS entity_name, entity_type,
   (CASE entity_type WHEN 'fact' THEN 0.85 WHEN 'dimension' THEN 0.80 WHEN 'bridge' THEN 0.90 ELSE 0.50 END)::DOUBLE AS confidence FROM k""",
    "column_roles": f"SELECT column_id, name, CASE WHEN is_primary_key THEN 'pk' WHEN is_foreign_key THEN 'fk' WHEN {_MEASURE} THEN 'measure' "
        f"WHEN {_DIMENSION} THEN 'dimension' ELSE 'attribute' END AS role FROM {_C}",
    "metric_columns": f"SELECT column_id, {_initcap(chr(39).join(['regexp_replace(name, ', '^(total|sum|avg|count|max|min)_', ', ', '', ', ', 'i', ')']))} AS metric_name, {_AGG} AS aggregation FROM {_C} WHERE {_MEASURE}",
    "dimension_columns": f"SELECT column_id, name, {_KIND} AS dimension_type FROM {_C} WHERE {_DIMENSION}",
    "fact_columns": f"SELECT column_id, name, data_type FROM {_C} WHERE NOT is_primary_key AND NOT is_foreign_key AND NOT {_MEASURE}",
    "metric_registry": f"""
WITH m AS (SELECT * FROM {V.duck(V.METRICS)}), pack AS (SELECT name FROM m WHERE formula IS NULL)
SELECT name, formula, description FROM m WHERE connection_id = 'conn_b' AND name NOT IN (SELECT name FROM pack)
UNION ALL SELECT name, NULL, 'from pack' FROM pack""",
    "metric_revenue_by_region": """
SELECT r_name, p_brand, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem
LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "metric_filtered": """
SELECT o_orderpriority, round(avg(o_totalprice), 4) AS order_value FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation) AND o_orderstatus = 'F' GROUP BY 1""",
    "metric_trust": f"SELECT name, (50 + CASE WHEN is_certified THEN 30 ELSE 0 END + CASE WHEN description <> '' THEN 10 ELSE 0 END "
        f"+ CASE WHEN formula <> '' THEN 10 ELSE 0 END)::DOUBLE AS trust_score FROM {V.duck(V.METRICS)}",
    "top10_customers": """
SELECT c_name, revenue FROM (SELECT o_custkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderdate >= TIMESTAMP '2000-08-01' AND o_orderdate < TIMESTAMP '2001-08-01' GROUP BY 1 ORDER BY revenue DESC, o_custkey LIMIT 10) JOIN customer ON o_custkey = c_custkey""",
    "sales_by_region_12m": f"SELECT r_name, round(sum(o_totalprice), 2) AS total_sales, count(*) AS n_orders FROM {_SALES_SQL} "
        "WHERE o_orderdate >= TIMESTAMP '2000-08-01' AND o_orderdate < TIMESTAMP '2001-08-01' GROUP BY 1",
    "revenue_yoy": """
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1)
SELECT m.period, m.value, p.value AS prior_value, round((m.value - p.value) / p.value * 100, 4) AS change_pct
FROM m LEFT JOIN m p ON p.period = CAST(m.period - INTERVAL 12 MONTH AS DATE)""",
    "change_drivers": f"""
WITH d AS (SELECT r_name, coalesce(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 2000), 0) - coalesce(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1999), 0) AS delta FROM {_SALES_SQL} GROUP BY 1)
SELECT r_name, round(delta, 2) AS delta, round(100 * delta / (SELECT sum(delta) FROM d), 4) AS contribution_pct FROM d""",
    "semantic_search": f"""
WITH t AS (SELECT * FROM {_T}), c AS (SELECT * FROM {_C}),
u AS (SELECT resource_id AS id, count(*) AS n FROM {V.duck(V.AUDIT_LOG)} GROUP BY 1),
f AS (SELECT 'table' AS resource_type, table_id AS id, table_name AS name, {_relevance('table_name', "coalesce(description, '')", _TERMS)} AS relevance_score, created_on FROM t WHERE workspace_id = 'ws1'
  UNION ALL SELECT 'column', column_id, table_name || '.' || name, {_relevance('name', 'name', _TERMS)}, created_on FROM c JOIN t USING (table_id)),
g AS (SELECT f.*, least(coalesce(n, 0.5) / 1000.0, 1.0)::DOUBLE AS pop, CASE WHEN created_on IS NULL THEN 0.5::DOUBLE ELSE greatest(1.0 - date_diff('day', created_on, DATE '2024-02-01') / 365.0, 0.0) END AS rec FROM f LEFT JOIN u USING (id) WHERE relevance_score > 0)
SELECT resource_type, id, name, relevance_score, round(pop, 6) AS popularity_score, round(rec, 6) AS recency_score,
  round(0.5 * relevance_score + 0.3 * pop + 0.2 * rec, 6) AS combined_score FROM g
ORDER BY 0.5 * relevance_score + 0.3 * pop + 0.2 * rec DESC, resource_type, id LIMIT 100""",
    "search_suggestions": f"""
SELECT DISTINCT suggestion FROM ((SELECT DISTINCT table_name AS suggestion FROM {_T} WHERE lower(table_name) LIKE 'cu%' ORDER BY 1 LIMIT 5)
UNION ALL (SELECT DISTINCT name FROM {_C} WHERE lower(name) LIKE 'cu%' ORDER BY 1 LIMIT 5))""",
    "metadata_search": f"""
WITH t AS (SELECT * FROM {_T}), c AS (SELECT * FROM {_C}),
h AS (SELECT 'table' AS kind, table_id AS id, table_name AS name, table_name, schema_name, NULL::VARCHAR AS data_type, NULL::VARCHAR AS pii_tag
   FROM t WHERE contains(lower(table_name), 'order') OR contains(lower(description), 'order')
 UNION ALL SELECT 'column', column_id, name, table_name, schema_name, data_type, pii_tag FROM c JOIN t USING (table_id) WHERE contains(lower(name), 'order') OR contains(lower(c.description), 'order'))
SELECT *, CAST(CASE WHEN lower(name) = 'order' THEN 100 WHEN lower(name) LIKE 'order%' THEN 80 WHEN contains(lower(name), 'order') THEN 50 ELSE 10 END AS INTEGER) AS score FROM h""",
    "table_details": f"""
SELECT t.table_id, table_name, owner_id, columns, tags FROM {_T} t
LEFT JOIN (SELECT table_id, string_agg(name || ' ' || data_type, ', ' ORDER BY ordinal_position, name) AS columns FROM {_C} GROUP BY 1) c ON c.table_id = t.table_id
LEFT JOIN (SELECT 'T' || l_partkey AS table_id, string_agg(DISTINCT 'status:' || l_returnflag, ', ' ORDER BY 'status:' || l_returnflag) AS tags FROM lineitem GROUP BY 1) g ON g.table_id = t.table_id""",
    "classification_upsert": f"""
SELECT 'C' || c_custkey AS table_id, CASE WHEN c_custkey % 2 = 0 THEN 'restricted' ELSE 'internal' END AS sensitivity_level, c_custkey % 5 = 0 AS contains_pii, c_custkey % 4 = 0 AS masking_enabled,
  false AS access_restricted, CASE WHEN c_custkey % 9 = 0 THEN 'auditor' ELSE '' END AS allowed_roles, 'api_manual' AS classified_by, false AS auto_detected FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT table_id, sensitivity_level, contains_pii, masking_enabled, access_restricted, allowed_roles, 'detector', true FROM {V.duck(V.CLASSIFICATIONS)}
  WHERE substr(table_id, 2)::BIGINT % 3 <> 0""",
    "catalog_search": f"""
WITH k AS (SELECT table_id, count(*) AS n FROM {_C} WHERE contains(lower(name), 'card') GROUP BY 1)
SELECT t.table_id, schema_name, table_name, coalesce(n, 0) AS n_columns FROM {_T} t LEFT JOIN k USING (table_id)
WHERE schema_name = 'public' AND (contains(lower(table_name), 'card') OR n > 0)""",
    "tags_by_table": f"""
SELECT t.table_id, table_name, tags FROM {_T} t LEFT JOIN (SELECT 'T' || l_partkey AS table_id, string_agg(DISTINCT 'status:' || l_returnflag, ',' ORDER BY 'status:' || l_returnflag) AS tags FROM lineitem GROUP BY 1) g ON g.table_id = t.table_id""",
    "asset_upsert": f"""
WITH t AS (SELECT * FROM {_T})
SELECT table_id, CASE WHEN row_count_estimate >= 20000 AND schema_name = 'sales' THEN 'sales_team' WHEN row_count_estimate < 30000 THEN owner_id END AS owner,
  CAST(CASE WHEN row_count_estimate < 30000 THEN 24 END AS INTEGER) AS sla FROM t""",
    "recommendations": f"{_FOUND} SELECT found.*, suggested_action FROM found JOIN acts USING (recommendation_type)",
    "recommendations_by_type": f"{_FOUND} SELECT recommendation_type, count(*) AS count FROM found GROUP BY 1",
    "exposed_columns": f"SELECT table_id, string_agg(name, ', ' ORDER BY ordinal_position, name) AS columns FROM {_C} WHERE is_pii AND NOT is_masked GROUP BY 1",
}
ORACLES["metadata_search_scan"] = ORACLES["metadata_search"]
