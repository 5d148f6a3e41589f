"""Catalog rows from DataFrame schemas and Spark's own catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMN_SCHEMA = ("table_id string, table_name string, column_id string, name string, data_type string, "
                 "is_nullable boolean, is_primary_key boolean, ordinal_position int")


def list_tables(spark: SparkSession, database: str | None = None, skip: Sequence[str] = ("information_schema", "sys")) -> DataFrame:
    """Tables and views of the Spark catalog: schema_name, table_name, entity_type."""
    rows = [
        (".".join(t.namespace or []), t.name, "view" if t.tableType in ("VIEW", "TEMPORARY") else "table")
        for t in spark.catalog.listTables(database)
        if not set(t.namespace or []) & set(skip)
    ]
    return spark.createDataFrame(rows, "schema_name string, table_name string, entity_type string")


def list_columns(
    spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None,
    metadata_limit: int | None = None,
) -> DataFrame:
    """One row per column, ordinals from 1, of all tables; an explicit ``metadata_limit`` keeps the first ones only.

    Reads schemas only; no data is touched.
    """
    rows = []
    for name, df in list(tables.items())[:metadata_limit]:
        primary = set((keys or {}).get(name, ()))
        for i, f in enumerate(df.schema.fields, start=1):
            rows.append((name, name, f"{name}.{f.name}", f.name, f.dataType.simpleString(), f.nullable,
                         f.name in primary, i))
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count): one count per table, all in a single unioned plan."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ])
