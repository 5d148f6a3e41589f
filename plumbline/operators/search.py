"""Catalog search. Query terms become column expressions, so a search is one pass over the catalog."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed

if TYPE_CHECKING:
    from plumbline.operators.catalog_index import CatalogIndex


def expand_query(query: str) -> list[str]:
    """Lowercase terms of the query and their synonyms, sorted."""
    terms = query.lower().split()
    return sorted({*terms, *[s for t in terms for s in fixed.SYNONYMS.get(t, [])]})


def _has(text: Column, term: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(term)), F.lit(False))


def relevance(terms: Sequence[str], name: Column, description: Column) -> Column:
    """Best match over all terms: exact 1.0, word .95, part of the name .85, description .60, else 0."""
    lowered, about = F.lower(name), F.lower(F.coalesce(description, F.lit("")))
    words = F.split(lowered, "_")

    def of(term):
        return (
            F.when(lowered == term, 1.0)
            .when(F.array_contains(words, term), 0.95)
            .when(F.contains(lowered, term), 0.85)
            .when(F.contains(about, term), 0.60)
            .otherwise(0.0)
        )

    # one lambda over a literal array: the expression does not grow with the number of terms
    return F.array_max(F.transform(F.array(*[F.lit(t) for t in terms]), of))


def _rank(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    days = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("updated").cast("timestamp"))) / 86_400_000_000)
    recency = F.when(F.col("updated").isNull(), 0.5).otherwise(F.greatest(1.0 - days / 365.0, F.lit(0.0)))
    popularity = F.least(F.col("popularity") / 1000.0, F.lit(1.0))
    scored = df.withColumn("popularity_score", popularity).withColumn("recency_score", recency)
    combined = 0.50 * F.col("relevance_score") + 0.30 * F.col("popularity_score") + 0.20 * F.col("recency_score")
    return scored.withColumn("combined_score", combined)


def _relevant(tables_df: DataFrame, columns_df: DataFrame, terms: Sequence[str], workspace_id: str | None) -> DataFrame:
    """(resource_type, id, name, relevance_score, updated) of what some term fits, by a scan of the catalog."""
    mine = tables_df if workspace_id is None else tables_df.filter(F.col("workspace_id") == workspace_id)
    tables = mine.select(
        F.lit("table").alias("resource_type"), F.col("table_id").alias("id"), F.col("table_name").alias("name"),
        relevance(terms, F.col("table_name"), F.col("description")).alias("relevance_score"),
        F.col("created_at").alias("updated"))
    matched = columns_df.select("column_id", "table_id", "name", relevance(terms, F.col("name"), F.col("name")).alias("relevance_score")).filter(
        "relevance_score > 0")
    columns = matched.join(tables_df.select("table_id", "table_name", "created_at"), "table_id").select(
        F.lit("column").alias("resource_type"), F.col("column_id").alias("id"), F.concat_ws(".", "table_name", "name").alias("name"),
        "relevance_score", F.col("created_at").alias("updated"))
    return tables.filter("relevance_score > 0").unionByName(columns)


def semantic_search(
    tables_df: DataFrame | None,
    columns_df: DataFrame | None,
    query: str,
    as_of: dt.datetime,
    limit: int = 50,
    types: Sequence[str] | None = None,
    workspace_id: str | None = None,
    usage_df: DataFrame | None = None,
    index: CatalogIndex | None = None,
) -> DataFrame:
    """Tables and columns ranked by relevance, popularity and recency; the best ``limit`` of them.

    With an ``index`` (:class:`plumbline.operators.catalog_index.CatalogIndex`) the catalog itself isn't scanned and may be None.

    ``usage_df`` (id, n_queries) supplies popularity; without it every resource counts 0.5.
    """
    terms = expand_query(query)
    if not terms:
        raise ValueError("empty query")
    if not 1 <= limit <= 500:
        raise ValueError("limit must be within 1..500")
    found = index.relevant(terms, workspace_id) if index is not None else _relevant(tables_df, columns_df, terms, workspace_id)
    if types:
        found = found.filter(F.col("resource_type").isin(list(types)))
    if usage_df is None:
        found = found.withColumn("popularity", F.lit(0.5))
    else:
        found = found.join(usage_df.select("id", F.col("n_queries").cast("double").alias("popularity")), "id", "left")
        found = found.withColumn("popularity", F.coalesce("popularity", F.lit(0.5)))
    return (
        _rank(found, as_of)
        .orderBy(F.desc("combined_score"), "resource_type", "id")
        .limit(limit)
        .select("resource_type", "id", "name", "relevance_score", "popularity_score", "recency_score", "combined_score")
    )


def suggest(tables_df: DataFrame, columns_df: DataFrame, prefix: str) -> DataFrame:
    """Up to five table and five column names that start with ``prefix``."""
    if len(prefix.strip()) < 2:
        return tables_df.select(F.col("table_name").alias("suggestion")).limit(0)
    starts = F.lit(prefix.lower())

    def first_five(names):
        hits = names.filter(F.startswith(F.lower("suggestion"), starts)).distinct()
        return hits.orderBy("suggestion").limit(5)

    tables = first_five(tables_df.select(F.col("table_name").alias("suggestion")))
    columns = first_five(columns_df.select(F.col("name").alias("suggestion")))
    return tables.union(columns).distinct().orderBy("suggestion").limit(10)


def match_score(name: Column, query: str) -> Column:
    """exact 100, prefix 80, contained 50, description only 10."""
    lowered, wanted = F.lower(name), query.lower()
    return (
        F.when(lowered == wanted, 100).when(F.startswith(lowered, F.lit(wanted)), 80)
        .when(F.contains(lowered, F.lit(wanted)), 50).otherwise(10)
    )


def metadata_search(tables_df: DataFrame, columns_df: DataFrame, query: str, connection_id: str | None = None) -> DataFrame:
    """Every table and column whose name or description holds the query, best matches first.

    (kind, id, name, table_name, schema_name, data_type, pii_tag, score), tables before columns; equal scores in the order of names and ids.
    """
    mine = tables_df if connection_id is None else tables_df.filter(F.col("connection_id") == connection_id)
    wanted, none = query.lower(), F.lit(None).cast("string")
    tables = mine.filter(_has(F.col("table_name"), wanted) | _has(F.col("description"), wanted)).select(
        F.lit("table").alias("kind"), F.col("table_id").alias("id"), F.col("table_name").alias("name"), "table_name", "schema_name",
        none.alias("data_type"), none.alias("pii_tag"), match_score(F.col("table_name"), query).alias("score"))
    hits = columns_df.filter(_has(F.col("name"), wanted) | _has(F.col("description"), wanted))
    tag = F.col("pii_tag") if "pii_tag" in columns_df.columns else none
    columns = hits.select("column_id", "table_id", "name", "data_type", tag.alias("pii_tag")).join(mine.select("table_id", "table_name", "schema_name"), "table_id").select(
        F.lit("column").alias("kind"), F.col("column_id").alias("id"), "name", "table_name", "schema_name", "data_type", "pii_tag",
        match_score(F.col("name"), query).alias("score"))
    return tables.unionByName(columns).orderBy(F.desc("kind"), F.desc("score"), "name", "id")


def catalog_search(tables_df: DataFrame, columns_df: DataFrame, query: str, schema: str | None = None) -> DataFrame:
    """Tables whose own name, or one of whose column names, holds the query."""
    mine = tables_df if schema is None else tables_df.filter(F.col("schema_name") == schema)
    wanted = query.lower()
    by_column = columns_df.filter(_has(F.col("name"), wanted)).groupBy("table_id").agg(F.count(F.lit(1)).alias("n_columns"))
    joined = mine.join(by_column, "table_id", "left").withColumn("n_columns", F.coalesce("n_columns", F.lit(0)))
    return joined.filter(_has(F.col("table_name"), wanted) | (F.col("n_columns") > 0)).select(
        "table_id", "schema_name", "table_name", "n_columns")


def table_details(tables_df: DataFrame, columns_df: DataFrame, tags_df: DataFrame, table_id: str | None = None) -> DataFrame:
    """One table, or each, with its columns and tags as arrays (each as wide as one table)."""
    own = [df if table_id is None else df.filter(F.col("table_id") == table_id) for df in (tables_df, columns_df, tags_df)]
    columns = own[1].groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("ordinal_position", "name", "data_type"))).alias("columns"))
    tags = own[2].groupBy("table_id").agg(F.array_sort(F.collect_set(F.struct("tag_type", "tag_value"))).alias("tags"))
    return own[0].join(columns, "table_id", "left").join(tags, "table_id", "left")


def classify(current: DataFrame, requests: DataFrame) -> DataFrame:
    """Manual classifications put over the stored ones: a request replaces what it classifies; switches and roles it leaves open become off and empty."""
    manual = requests.select(
        "table_id", "sensitivity_level", "contains_pii", F.coalesce("masking_enabled", F.lit(False)).alias("masking_enabled"),
        F.coalesce("access_restricted", F.lit(False)).alias("access_restricted"), F.coalesce("allowed_roles", F.array().cast("array<string>")).alias("allowed_roles"),
        F.lit("api_manual").alias("classified_by"), F.lit(False).alias("auto_detected"))
    return current.join(requests.select("table_id"), "table_id", "left_anti").select(manual.columns).unionByName(manual)


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial update: fields absent (NULL) in ``changes`` keep their value, new keys are added."""
    fields = [c for c in current.columns if c not in keys]
    staged = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields if c in changes.columns])
    merged = current.join(staged, list(keys), "full")
    return merged.select(*keys, *[
        F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in changes.columns else F.col(c) for c in fields])
