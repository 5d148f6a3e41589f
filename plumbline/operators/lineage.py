"""Lineage from statement text. Patterns run as column expressions over a query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.operators.relations import connection_of


def without_comments(sql: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sql, r"(?m)--.*$", ""), r"(?s)/\*.*?\*/", "")


def table_names(sql: Column, deep: bool = False) -> Column:
    """Distinct names after FROM or JOIN. ``deep`` also looks inside parenthesised subqueries."""
    def scan(text):
        found = F.regexp_extract_all(text, F.lit(fixed.SOURCE_PATTERN), F.lit(1))
        return F.filter(found, lambda t: ~F.upper(t).isin(fixed.NOT_TABLES))

    bare = without_comments(sql)
    names = scan(bare)
    if deep:
        names = F.concat(names, scan(F.replace(bare, F.lit("("), F.lit(" "))))
    return F.array_distinct(names)


def source_tables(log_df: DataFrame, deep: bool = False) -> DataFrame:
    """(query_id, table_name) for every table a statement reads."""
    return log_df.select("query_id", F.explode(table_names(F.col("query_executed"), deep)).alias("table_name"))


def lineage_edges(log_df: DataFrame) -> DataFrame:
    """(source_table, target_table, ...) per statement that writes a table from others."""
    sql = F.col("query_executed")
    head = F.trim(F.upper(sql))

    def target(pattern):
        return F.regexp_extract(sql, pattern, 1)

    def edge(kind, logic, confidence, name):
        return F.struct(F.lit(kind).alias("lineage_type"), F.lit(logic).alias("transformation_logic"),
                        F.lit(confidence).alias("confidence"), name.alias("target_table"))

    writes = (
        F.when(F.startswith(head, F.lit("CREATE TABLE")),
               edge("transform", "CREATE TABLE AS SELECT", 0.95, target(fixed.CREATE_PATTERN)))
        .when(F.startswith(head, F.lit("INSERT INTO")),
              edge("direct", "INSERT INTO ... SELECT", 0.95, target(fixed.INSERT_PATTERN)))
        .when(F.startswith(head, F.lit("UPDATE")),
              edge("join", "UPDATE ... FROM", 0.85, target(fixed.UPDATE_PATTERN)))
    )
    found = log_df.select("query_id", writes.alias("w"), F.substring(sql, 1, 200).alias("query_template"), sql.alias("sql")).filter(
        F.col("w").isNotNull() & (F.col("w.target_table") != ""))
    edges = found.select(
        "query_id", F.explode(table_names(F.col("sql"))).alias("source_table"), "w.target_table", "w.lineage_type",
        "w.confidence", "w.transformation_logic", "query_template")
    itself = (F.col("lineage_type") == "join") & (F.upper("source_table") == F.upper("target_table"))
    return edges.filter(~itself)


def register_edges(
    edges_df: DataFrame, tables_df: DataFrame, existing_df: DataFrame | None = None, method: str = "sql_parser"
) -> DataFrame:
    """New catalog edges, one per (source, target, method); both ends must be cataloged, in one connection.

    The many statements behind one edge are folded to the first before anything is joined.
    """
    first = edges_df.groupBy("source_table", "target_table").agg(
        F.min_by(F.struct("lineage_type", "confidence", "transformation_logic", "query_template"), "query_id").alias("e"))
    names = tables_df.select("table_id", "table_name", connection_of(tables_df).alias("conn"))
    resolved = (
        first.join(names.select("conn", F.col("table_id").alias("source_table_id"), F.col("table_name").alias("source_table")), "source_table")
        .join(names.select("conn", F.col("table_id").alias("target_table_id"), F.col("table_name").alias("target_table")), ["target_table", "conn"])
        .select("source_table_id", "target_table_id", F.lit(method).alias("discovery_method"), "e.*", F.lit(True).alias("is_active"))
    )
    if existing_df is not None:
        resolved = resolved.join(existing_df.select("source_table_id", "target_table_id", "discovery_method"),
                                 ["source_table_id", "target_table_id", "discovery_method"], "left_anti")
    return resolved


def manual_edges(wanted_df: DataFrame, existing_df: DataFrame) -> DataFrame:
    """Hand-made edges not yet present under any method (source_table_id, target_table_id, transformation_logic)."""
    pair = ["source_table_id", "target_table_id"]
    fresh = wanted_df.groupBy(*pair).agg(F.min("transformation_logic").alias("transformation_logic"))
    return fresh.join(existing_df.select(*pair), pair, "left_anti").select(
        *pair, F.lit("manual").alias("discovery_method"), F.lit("transform").alias("lineage_type"),
        F.lit(1.0).alias("confidence"), "transformation_logic", F.lit(True).alias("is_active"))


def column_tokens(log_df: DataFrame) -> DataFrame:
    """(query_id, qualifier, token) for every identifier between the first SELECT and its FROM."""
    clause = F.regexp_extract("query_executed", fixed.SELECT_LIST_PATTERN, 1)
    tokens = F.regexp_extract_all(clause, F.lit(fixed.COLUMN_TOKEN_PATTERN), F.lit(0))
    listed = log_df.select("query_id", clause.alias("clause"), F.posexplode(tokens).alias("position", "t"))
    dotted = F.contains("t", F.lit("."))
    return listed.select(
        "query_id", "position",
        F.when(dotted, F.substring_index("t", ".", 1)).otherwise("").alias("qualifier"),
        F.substring_index("t", ".", -1).alias("token"),
        F.substring("clause", 1, 100).alias("query_fragment"))


def query_graph(log_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (queries and the tables behind FROM) and table → query edges."""
    runs = log_df.filter(F.col("action") == "query_executed").select(
        F.concat(F.lit("q_"), F.col("query_id").cast("string")).alias("node_id"), F.col("query_executed").alias("sql"))
    queries = runs.select("node_id", F.lit("query").alias("node_type"),
                          F.concat(F.lit("Query: "), F.substring("sql", 1, 20), F.lit("...")).alias("label"))
    names = F.array_distinct(F.regexp_extract_all(F.col("sql"), F.lit(r"(?i)FROM\s+([a-zA-Z0-9_.]+)"), F.lit(1)))
    edges = runs.select(F.explode(names).alias("source"), F.col("node_id").alias("target"))
    tables = edges.select(F.col("source").alias("node_id")).distinct().select(
        "node_id", F.lit("table").alias("node_type"), F.col("node_id").alias("label"))
    return queries.unionByName(tables), edges


def ungrounded_references(log_df: DataFrame, tables_df: DataFrame) -> DataFrame:
    """Referenced tables that the catalog does not know, names compared without case or schema."""
    used = source_tables(log_df).withColumn("__k", F.lower(F.substring_index("table_name", ".", -1)))
    return used.join(tables_df.select(F.lower("table_name").alias("__k")).distinct(), "__k", "left_anti").select("query_id", "table_name")
