"""Quality scores: one aggregate per table, six dimensions and a weighted total."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Dimension weights, and the scores used when a dimension has nothing to measure.
WEIGHTS = {
    "freshness": 0.25,
    "completeness": 0.25,
    "uniqueness": 0.15,
    "accuracy": 0.15,
    "consistency": 0.10,
    "timeliness": 0.10,
}
DEFAULT_SLA_HOURS = 24
NO_ROWS_COMPLETENESS = 50.0
NO_KEY_UNIQUENESS = 75.0
UNKNOWN_AGE_ACCURACY = 75.0
DEFAULT_CONSISTENCY = 85.0
NEVER_SYNCED_HOURS = 9999


@dataclass
class ScoredTable:
    """A table to score: its rows, its key, optional plausibility rules and foreign keys."""

    df: DataFrame
    key: Sequence[str] = ()
    rules: Sequence[Column] = ()
    foreign_keys: Sequence[tuple[str, DataFrame, str]] = field(default_factory=tuple)


def age_hours(synced: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(synced)) / 3_600_000_000.0


def freshness_score(synced: Column, sla_hours: Column, as_of: Column) -> Column:
    late = age_hours(synced, as_of) - sla_hours
    return (
        F.when(synced.isNull(), 0.0)
        .when(late <= 0, 100.0)
        .otherwise(F.greatest(F.lit(0.0), 100.0 - 5.0 * late))
    )


def completeness_score(full_rows: Column, rows: Column) -> Column:
    return F.when(rows > 0, F.least(F.lit(100.0), full_rows * 100.0 / rows)).otherwise(NO_ROWS_COMPLETENESS)


def uniqueness_score(distinct_keys: Column, keyed_rows: Column) -> Column:
    return F.when(keyed_rows > 0, F.least(F.lit(100.0), distinct_keys * 100.0 / keyed_rows)).otherwise(100.0)


def accuracy_score(synced: Column, as_of: Column) -> Column:
    days = F.floor(age_hours(synced, as_of) / 24)
    return (
        F.when(synced.isNull(), UNKNOWN_AGE_ACCURACY).when(days < 7, 90.0).when(days < 30, 80.0).otherwise(70.0)
    )


def all_true(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def measure(table_name: str, table: ScoredTable) -> DataFrame:
    """One row of raw measurements for a table; a single scan with map-side combination."""
    df = table.df
    columns = [F.col(f"`{c}`") for c in df.columns]
    aggs = [
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(all_true([c.isNotNull() for c in columns])).alias("full_rows"),
    ]
    keys = [F.col(f"`{k}`") for k in table.key]
    if keys:
        aggs += [
            F.count_if(all_true([k.isNotNull() for k in keys])).alias("keyed_rows"),
            F.count_distinct(*keys).alias("distinct_keys"),
        ]
    else:
        aggs += [F.lit(None).cast("long").alias("keyed_rows"), F.lit(None).cast("long").alias("distinct_keys")]
    if table.rules:
        passing = F.count_if(F.coalesce(all_true(list(table.rules)), F.lit(False)))
        aggs.append((passing * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("rule_pass"))
    else:
        aggs.append(F.max(F.lit(None).cast("double")).alias("rule_pass"))
    filled = sum((F.count(c) for c in columns), F.lit(0))
    aggs.append(
        F.coalesce(filled * 100.0 / F.nullif(F.count(F.lit(1)) * len(columns), F.lit(0)), F.lit(50.0))
        .alias("completeness_percent")
    )
    measured = df.agg(*aggs)
    if table.foreign_keys:
        parts = [fk_containment(df, c, parent, p).select("non_null_keys", "matched_keys")
                 for c, parent, p in table.foreign_keys]
        links = reduce(DataFrame.unionByName, parts).agg(
            (F.sum("matched_keys") * 100.0 / F.nullif(F.sum("non_null_keys"), F.lit(0))).alias("fk_pass"))
        measured = measured.withColumn("fk_pass", links.scalar())
    else:
        measured = measured.withColumn("fk_pass", F.lit(None).cast("double"))
    return measured.withColumn("table_name", F.lit(table_name))


def score_tables(
    tables: Mapping[str, ScoredTable],
    catalog_df: DataFrame,
    assets_df: DataFrame,
    as_of: dt.datetime,
) -> DataFrame:
    """Scores every table of ``tables``.

    ``catalog_df``: table_name, last_metadata_sync. ``assets_df``: table_name, sla_freshness_hours.
    """
    now = F.lit(as_of).cast("timestamp")
    measured = reduce(DataFrame.unionByName, [measure(n, t) for n, t in tables.items()])
    joined = (
        measured.join(catalog_df.select("table_name", "last_metadata_sync"), "table_name", "left")
        .join(assets_df.groupBy("table_name").agg(F.max("sla_freshness_hours").alias("sla")), "table_name", "left")
    )
    synced = F.col("last_metadata_sync")
    sla = F.coalesce(F.col("sla"), F.lit(DEFAULT_SLA_HOURS)).cast("double")
    scored = joined.select(
        "table_name",
        freshness_score(synced, sla, now).alias("freshness"),
        completeness_score(F.col("full_rows"), F.col("row_count")).alias("completeness"),
        F.when(F.col("keyed_rows").isNull(), NO_KEY_UNIQUENESS)
        .otherwise(uniqueness_score(F.col("distinct_keys"), F.col("keyed_rows"))).alias("uniqueness"),
        F.coalesce(F.col("rule_pass"), accuracy_score(synced, now)).alias("accuracy"),
        F.coalesce(F.col("fk_pass"), F.lit(DEFAULT_CONSISTENCY)).alias("consistency"),
        F.when(synced.isNull(), NEVER_SYNCED_HOURS).otherwise(F.floor(age_hours(synced, now))).cast("long")
        .alias("freshness_hours"),
        "completeness_percent",
    ).withColumn("timeliness", F.col("freshness") * 0.9)
    overall = sum((F.col(name) * weight for name, weight in WEIGHTS.items()), F.lit(0.0))
    return scored.select(
        "table_name",
        *[F.round(name, 4).alias(name) for name in WEIGHTS],
        F.round(overall, 4).alias("overall"),
        "freshness_hours",
        F.round("completeness_percent", 4).alias("completeness_percent"),
    )


def fk_containment(child_df: DataFrame, child_key: str, parent_df: DataFrame, parent_key: str) -> DataFrame:
    """Share of non-null child keys that exist in the parent.

    Child keys are counted before the join, so a key repeated in a third of the rows crosses the
    network once per task.
    """
    keys = (
        child_df.filter(F.col(child_key).isNotNull())
        .groupBy(F.col(child_key).alias("__key"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    parents = parent_df.select(F.col(parent_key).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    matched = keys.join(parents, "__key", "left")
    return matched.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("non_null_keys"),
        F.coalesce(F.sum(F.when(F.col("__hit"), F.col("__n"))), F.lit(0)).alias("matched_keys"),
    ).withColumn(
        "containment_pct",
        F.coalesce(F.round(F.col("matched_keys") * 100.0 / F.nullif(F.col("non_null_keys"), F.lit(0)), 4), F.lit(100.0)),
    )


def upsert_scores(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Score table with the rows of ``fresh`` replacing those of the same table."""
    return current.join(fresh.select("table_name"), "table_name", "left_anti").unionByName(fresh)


def refresh_totals(requested: Sequence[str], scores: DataFrame) -> DataFrame:
    """total / scored / failed over the tables asked for."""
    asked = scores.sparkSession.createDataFrame([(t,) for t in requested], "table_name string")
    hit = asked.join(scores.select("table_name", F.lit(1).alias("ok")), "table_name", "left")
    return hit.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("ok").alias("scored"),
        (F.count(F.lit(1)) - F.count("ok")).alias("failed"),
    )
