"""Change feeds from Kafka topics. The connector jar is supplied on the cluster's class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_options(servers: str, topic: str, group_id: str, starting: str = "earliest",
                  max_offsets_per_trigger: int | None = None) -> dict[str, str]:
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "kafka.group.id": group_id, "startingOffsets": starting}
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def kafka_stream(spark: SparkSession, servers: str, topic: str, group_id: str = "plumbline-cdc", **options) -> DataFrame:
    """Stream of (value text, feed_offset) from a topic."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, topic, group_id, **options)).load()
    return raw.select(F.col("value").cast("string").alias("value"), F.col("offset").alias("feed_offset"), "partition")


def file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same envelope from a folder of JSON-lines files."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)
