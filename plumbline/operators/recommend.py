"""Governance findings over the catalog and its profile history."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.operators.telemetry import count_by


def _finding(df: DataFrame, kind: str, title: Column, *told: Column, resource_type: str = "table", name: Column | None = None) -> DataFrame:
    severity, action = fixed.FINDINGS[kind]
    return df.select(
        F.lit(kind).alias("recommendation_type"), F.lit(resource_type).alias("resource_type"),
        F.col("table_id").alias("resource_id"), (name if name is not None else F.col("table_name")).alias("resource_name"),
        F.lit(severity).alias("severity"), title.alias("title"),
        F.format_string(fixed.FINDING_TEXTS[kind], *told).alias("description"), F.lit(action).alias("suggested_action"))


def latest_snapshots(history_df: DataFrame) -> DataFrame:
    """(table_id, seen_at, columns) of the newest snapshot of each table; of snapshots of one moment any one."""
    newest = history_df.groupBy("table_id").agg(F.max("created_at").alias("seen_at"))
    return history_df.join(newest, "table_id").where("created_at = seen_at").select("table_id", "seen_at", "columns").dropDuplicates(["table_id"])


def findings(tables_df: DataFrame, columns_df: DataFrame, history_df: DataFrame, as_of: dt.datetime,
             unused_days: int = 90) -> DataFrame:
    """All findings with the text that explains each; the history contributes its latest snapshot per table."""
    base = tables_df.select("table_id", "table_name", "owner_id", F.col("description").alias("about"))
    name = F.col("table_name")
    ownerless = base.filter(F.coalesce("owner_id", F.lit("")) == "")
    exposed = _exposed(columns_df)
    vague = base.filter(F.coalesce(F.length(F.trim("about")), F.lit(0)) <= 20)
    profiled = base.join(latest_snapshots(history_df), "table_id")
    idle = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("seen_at")) / 86_400_000_000)
    holes = profiled.select("table_id", "table_name", F.inline("columns")).filter("null_percentage > 50")
    parts = [
        _finding(ownerless, "assign_owner", F.concat(F.lit("Assign owner to "), name), name),
        _finding(base.join(exposed, "table_id"), "mask_pii",
                 F.format_string("Apply masking to %d PII columns in %s", "n_columns", name), F.col("columns")),
        _finding(vague, "fix_description", F.concat(F.lit("Add description to "), name), name),
        _finding(profiled.filter(idle > unused_days), "flag_unused", F.format_string("Review %s for deprecation", name), name, idle),
        _finding(holes, "improve_quality", F.concat(F.lit("High null percentage in "), F.col("name")), F.col("name"), name, F.bround("null_percentage").cast("long"),
                 resource_type="column", name=F.concat_ws(".", "table_name", "name")),
    ]
    return reduce(DataFrame.unionByName, parts)


def recommendations(
    tables_df: DataFrame, columns_df: DataFrame, history_df: DataFrame, as_of: dt.datetime,
    severity: str | None = None, limit: int | None = None, resource_id: str | None = None,
) -> DataFrame:
    """Findings, optionally of one severity or one resource; ``limit`` (1..500) makes it a report page."""
    found = findings(tables_df, columns_df, history_df, as_of)
    if severity is not None:
        found = found.filter(F.col("severity") == severity)
    if resource_id is not None:
        found = found.filter(F.col("resource_id") == resource_id)
    if limit is not None:
        if not 1 <= limit <= 500:
            raise ValueError("limit must be within 1..500")
        found = found.orderBy("resource_name", "recommendation_type", "title").limit(limit)
    return found


def _exposed(columns_df: DataFrame) -> DataFrame:
    return columns_df.filter(F.col("is_pii") & ~F.coalesce("is_masked", F.lit(False))).groupBy("table_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal_position", "name"))), lambda c: c["name"]), ", ").alias("columns"),
        F.count(F.lit(1)).alias("n_columns"))


def exposed_columns(columns_df: DataFrame) -> DataFrame:
    """Unmasked sensitive columns per table, in column order."""
    return _exposed(columns_df).drop("n_columns")


def by_type(found: DataFrame) -> DataFrame:
    return count_by(found, "recommendation_type")
