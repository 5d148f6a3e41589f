"""User-supplied connectors by name, on Spark's Python data source API."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource


def register_connector(spark: SparkSession, source: type[DataSource]) -> str:
    """Makes ``spark.read.format(source.name())`` available; returns the name."""
    if not issubclass(source, DataSource):
        raise TypeError("a connector extends pyspark.sql.datasource.DataSource")
    spark.dataSource.register(source)
    return source.name()
