"""Catalog refresh: profile, sensitive data, quality and relationships, table by table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.pii import scan_pii
from plumbline.operators.profiling import profile_columns
from plumbline.operators.quality import ScoredTable, score_tables
from plumbline.operators.relations import infer_relationships
from plumbline.sources.catalog import list_columns

STATUS_SCHEMA = "step string, table_name string, status string, n_rows long, error string"


def refresh_catalog(
    spark: SparkSession,
    tables: Mapping[str, ScoredTable],
    catalog_df: DataFrame,
    assets_df: DataFrame,
    as_of: dt.datetime,
    out_dir: str,
    suffixes: Sequence[str] = ("_id", "id", "key"),
    parallel: int = 4,
) -> DataFrame:
    """Runs every step for every table and writes each result as Parquet below ``out_dir``.

    A failing table is recorded and the rest goes on. Returns one status row per (step, table).
    """
    def attempt(step: str, name: str, build) -> tuple:
        path = f"{out_dir}/{step}/table_name={name}"
        try:
            build().write.mode("overwrite").parquet(path)
            return step, name, "completed", spark.read.parquet(path).count(), None
        except Exception as exc:  # recorded, the other tables go on
            return step, name, "failed", 0, str(exc)

    steps = []
    for name, table in tables.items():
        steps.append(("profile", name, lambda t=table: profile_columns(t.df)))
        steps.append(("pii", name, lambda n=name, t=table: scan_pii(t.df, n).drop("table_name")))
        steps.append(("quality", name, lambda n=name, t=table: score_tables({n: t}, catalog_df, assets_df, as_of).drop("table_name")))
    columns = list_columns(spark, {n: t.df for n, t in tables.items()}, {n: t.key for n, t in tables.items()})
    catalog = columns.select("table_id", "table_name").distinct()
    links = infer_relationships(columns.drop("table_name"), catalog, suffixes=suffixes, strip_prefix=True, target_key="same")
    steps.append(("relationships", "all", lambda: links))
    with ThreadPoolExecutor(parallel) as pool:  # the steps are independent jobs
        statuses = list(pool.map(lambda s: attempt(*s), steps))
    return spark.createDataFrame(statuses, STATUS_SCHEMA)
