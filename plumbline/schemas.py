"""Schemas of the metadata tables the operators read and write, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "catalog_tables": (
        "table_id string, connection_id string, workspace_id string, schema_name string, table_name string, entity_type string, "
        "description string, owner_id string, row_count_estimate bigint, size_bytes bigint, last_metadata_sync timestamp, created_at timestamp"),
    "catalog_columns": (
        "column_id string, table_id string, name string, data_type string, default_value string, description string, pii_tag string, "
        "sensitivity_level string, is_nullable boolean, is_primary_key boolean, is_foreign_key boolean, is_pii boolean, is_masked boolean, "
        "ordinal_position int"),
    "catalog_relationships": (
        "source_table_id string, source_column_id string, target_table_id string, target_column_id string, relationship_type string, "
        "discovery_method string, confidence_score double"),
    "catalog_profiles": (
        "table_id string, column_id string, distinct_count bigint, null_count bigint, min_value string, max_value string, avg_value double, "
        "cardinality double, top_values array<struct<value:string,count:bigint>>, histogram array<struct<x:double,y:double>>, "
        "freshness timestamp, last_profiled timestamp"),
    "profile_history": (
        "table_id string, created_at timestamp, last_updated timestamp, row_count bigint, update_frequency_hours double, "
        "columns array<struct<name:string,null_percentage:double,distinct_count:bigint>>"),
    "metadata_assets": (
        "table_id string, owner string, steward string, contact_email string, business_owner string, sla_freshness_hours int"),
    "metadata_glossary": (
        "term string, definition string, domain string, owner string, related_terms array<string>, examples array<string>"),
    "metadata_tags": "table_id string, column_id string, tag_type string, tag_value string",
    "metadata_custom_fields": "table_id string, column_id string, field_name string, field_value string, field_type string",
    "quality_scores": (
        "table_name string, freshness double, completeness double, uniqueness double, accuracy double, consistency double, "
        "timeliness double, overall double, freshness_hours bigint, completeness_percent double"),
    "classifications": (
        "table_id string, column_id string, sensitivity_level string, masking_type string, contains_pii boolean, auto_detected boolean, "
        "masking_enabled boolean, access_restricted boolean, detection_confidence double, pii_types array<string>, "
        "compliance_reqs array<string>, allowed_roles array<string>"),
    "lineage_edges": (
        "source_table_id string, target_table_id string, lineage_type string, discovery_method string, transformation_logic string, "
        "query_template string, source_columns array<string>, target_columns array<string>, confidence double, is_active boolean"),
    "governance_policies": (
        "policy_id string, workspace_id string, name string, sensitivity_level string, contains_pii_condition boolean, action_type string, "
        "mask_type string, mask_pattern string, allowed_roles array<string>, enabled boolean"),
    "audit_log": (
        "audit_id string, user_id string, action string, resource_type string, resource_id string, query_executed string, "
        "rows_returned bigint, rows_masked bigint, columns_masked array<string>, access_level string, denial_reason string, timestamp timestamp"),
    "semantic_metrics": (
        "connection_id string, name string, description string, formula string, is_certified boolean, certified_at timestamp"),
    "semantic_dimensions": "connection_id string, name string, description string, column_name string, table_name string",
    "semantic_dependencies": "parent_id string, child_id string, dependency_type string",
    "connection_health": "connection_id string, status string, latency_ms double, checked_at timestamp",
    "resource_usage": "user_id string, workspace_id string, resource_type string, amount double, timestamp timestamp",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty metadata table."""
    return spark.createDataFrame([], SCHEMAS[name])
