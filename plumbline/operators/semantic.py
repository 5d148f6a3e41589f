"""Business meaning of tables and columns, and metrics compiled to aggregates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.functions.text import contains_any, entity_name, metric_name
from plumbline.operators import gate


def map_entities(columns_df: DataFrame, tables_df: DataFrame, rel_df: DataFrame) -> DataFrame:
    """fact / dimension / bridge / entity per table; tables without columns are left out.

    A relationship counts for both of its tables.
    """
    counts = columns_df.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("n_columns"), F.count_if(F.coalesce("is_foreign_key", F.lit(False))).alias("n_fks"))
    touching = rel_df.filter(F.col("target_table_id").isNotNull()).select(
        F.explode(F.array_distinct(F.array("source_table_id", "target_table_id"))).alias("table_id"))
    links = touching.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_links"))
    joined = tables_df.join(counts, "table_id").join(links, "table_id", "left")
    fact = (F.col("n_columns") > 10) & (F.col("n_fks") >= 2) & (F.coalesce("n_links", F.lit(0)) > 2)
    dimension = (F.col("n_columns") <= 10) & (F.col("n_fks") <= 1)
    bridge = contains_any(F.col("table_name"), ["bridge", "junction"])
    return joined.select(
        "table_name",
        entity_name(F.col("table_name")).alias("entity_name"),
        F.when(fact, "fact").when(dimension, "dimension").when(bridge, "bridge").otherwise("entity").alias("entity_type"),
        F.when(fact, 0.85).when(dimension, 0.80).when(bridge, 0.90).otherwise(0.50).alias("confidence"),
    )


def is_measure(name: Column, data_type: Column, extra_types: Sequence[str] = ("double", "real")) -> Column:
    """Numeric type and a measure word; ``extra_types`` admits Spark's own numeric names."""
    return contains_any(data_type, [*fixed.NUMERIC_TYPES, *extra_types]) & contains_any(name, fixed.MEASURE_WORDS)


def is_dimension(name: Column, data_type: Column) -> Column:
    return contains_any(data_type, fixed.TEMPORAL_TYPES) | contains_any(name, fixed.DIMENSION_WORDS)


def aggregation(name: Column) -> Column:
    return F.coalesce(*[F.when(contains_any(name, words), F.lit(fn)) for fn, words in fixed.AGGREGATION_WORDS.items()],
                      F.lit("SUM"))


def dimension_kind(name: Column, data_type: Column) -> Column:
    return F.coalesce(
        *[F.when(contains_any(name, words), F.lit(kind)) for kind, words in fixed.DIMENSION_KINDS.items()],
        F.when(contains_any(data_type, [*fixed.TEXT_TYPES, "string"]), F.lit("categorical")),
        F.lit("attribute"),
    )


def column_roles(columns_df: DataFrame) -> DataFrame:
    """Adds role, metric_name, aggregation and dimension_type to catalog columns."""
    name, kind = F.col("name"), F.col("data_type")
    measure, dimension = is_measure(name, kind), is_dimension(name, kind)
    role = (
        F.when(F.coalesce("is_primary_key", F.lit(False)), "pk")
        .when(F.coalesce("is_foreign_key", F.lit(False)), "fk")
        .when(measure, "measure").when(dimension, "dimension").otherwise("attribute")
    )
    return columns_df.withColumns({
        "role": role,
        "metric_name": F.when(measure, metric_name(name)),
        "aggregation": F.when(measure, aggregation(name)),
        "dimension_type": F.when(dimension, dimension_kind(name, kind)),
        "is_fact": ~F.coalesce("is_primary_key", F.lit(False)) & ~F.coalesce("is_foreign_key", F.lit(False)) & ~measure,
    })


def register(registry_df: DataFrame, new_df: DataFrame, key: Sequence[str] = ("connection_id", "name")) -> DataFrame:
    """Registry of definitions with ``new_df`` added; a redefinition replaces the old one."""
    return registry_df.join(new_df.select(*key), list(key), "left_anti").unionByName(new_df, allowMissingColumns=True)


def certify(metrics_df: DataFrame, name: str, role: str, at: dt.datetime) -> DataFrame:
    """Registry with one metric marked as certified; only admins may."""
    if role != "admin":
        raise PermissionError("Only admins can certify metrics.")
    hit = F.col("name") == name
    return metrics_df.withColumns({
        "is_certified": F.when(hit, True).otherwise(F.col("is_certified")),
        "certified_at": F.when(hit, F.lit(at)).otherwise(F.col("certified_at")),
    })


def trust_scores(metrics_df: DataFrame) -> DataFrame:
    """50, plus 30 when certified, 10 for a description and 10 for a formula."""
    def given(c):
        return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, 10.0).otherwise(0.0)

    score = F.lit(50.0) + F.when(F.coalesce("is_certified", F.lit(False)), 30.0).otherwise(0.0) + given("description") + given("formula")
    return metrics_df.select("name", F.least(F.lit(100.0), score).alias("trust_score"))


@dataclass(frozen=True)
class Metric:
    """A named aggregate over tables, e.g. ``sum(l_extendedprice)`` of ``lineitem``."""

    name: str
    formula: str
    tables: tuple[str, ...]


@dataclass(frozen=True)
class Link:
    """A join edge: ``child.child_key = parent.parent_key``."""

    child: str
    child_key: str
    parent: str
    parent_key: str


def check_formula(formula: str, spark: SparkSession | None = None) -> str:
    """Formulas are expressions over aggregates of built-in functions; anything else is refused, by the tree that Spark parses."""
    gate.check_aggregate(spark or SparkSession.active(), formula)
    return formula


def _joined(tables: Mapping[str, DataFrame], links: Sequence[Link], root: str, needed: Sequence[str]) -> DataFrame:
    """Joins ``needed`` tables onto ``root`` along foreign keys, child to parent.

    Rows of the root are kept once each, so aggregates over it are not inflated.
    """
    parent_of: dict[str, Link] = {}
    frontier = [root]
    while frontier:
        nxt = []
        for child in frontier:
            for link in links:
                if link.child == child and link.parent not in parent_of and link.parent != root:
                    parent_of[link.parent] = link
                    nxt.append(link.parent)
        frontier = nxt
    required: list[Link] = []

    def require(table: str) -> None:
        if table == root:
            return
        if table not in parent_of:
            raise ValueError(f"no join path from {root} to {table}")
        link = parent_of[table]
        require(link.child)
        if link not in required:
            required.append(link)

    for table in needed:
        require(table)
    result = tables[root]
    for link in required:
        parent = tables[link.parent]
        result = result.join(parent, result[link.child_key] == parent[link.parent_key], "left")
    return result


def compile_metric(
    metric: str,
    metrics: Mapping[str, Metric],
    tables: Mapping[str, DataFrame],
    links: Sequence[Link],
    dims: Sequence[str] = (),
    filters: Mapping[str, object] | None = None,
) -> DataFrame:
    """Metric by dimensions over the tables it depends on, joined along foreign keys.

    Dimensions and filters may name columns of any table reachable from the metric's first
    table; a name that several tables have raises. Filter keys must be plain identifiers, others are skipped; values are compared typed.
    """
    if metric not in metrics:
        raise ValueError(f"Metric {metric} not found in semantic layer.")
    spec = metrics[metric]
    usable = {k: v for k, v in (filters or {}).items() if k.replace("_", "").isalnum()}
    asked = {*dims, *usable}
    owners: dict[str, str] = {}
    for table, df in tables.items():
        for column in asked.intersection(df.columns):
            if owners.setdefault(column, table) != table:
                raise ValueError(f"column {column} is ambiguous: {owners[column]} and {table} have it")
    wanted = [*spec.tables[1:], *[owners[c] for c in [*dims, *usable] if c in owners]]
    missing = [c for c in [*dims, *usable] if c not in owners]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    base = _joined(tables, links, spec.tables[0], wanted)
    if usable:
        base = base.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in usable.items()]))
    return base.groupBy(*dims).agg(F.expr(check_formula(spec.formula, base.sparkSession)).alias(metric))
