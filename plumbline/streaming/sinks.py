"""Replayable sinks: every micro-batch owns one folder, so a retried batch overwrites itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_available_now(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Processes what is available, batch by batch, and returns when done."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """Handler that writes each batch below ``path/batch_id=<n>``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle


def latest_rows(df: DataFrame, keys: list[str], version: str = "batch_id") -> DataFrame:
    """Row of the highest version per key, folded map-side."""
    others = [c for c in df.columns if c not in (*keys, version)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), version).alias("__row")).select(*keys, "__row.*")
