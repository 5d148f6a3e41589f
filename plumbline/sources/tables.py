"""Table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; zone-less timestamps become UTC instants."""
    return instants(spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))


def instants(df: DataFrame) -> DataFrame:
    """Casts ``timestamp_ntz`` columns to ``timestamp`` (watermarks need the latter)."""
    zone_less = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    if not zone_less:
        return df
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c in zone_less else F.col(c) for c in df.columns])
