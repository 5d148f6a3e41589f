"""Guarded SQL, query-log rollups, and jobs over logged plans and replies."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Collection, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import gate
from plumbline.session import cut_lineage

# Leading words of the read-only gate, and its bounds.
READ_WORDS = ("select", "with", "show", "describe", "desc", "explain")
MAX_ROWS = 100_000
DEFAULT_ROWS = 1_000


def is_read_only(spark: SparkSession, sql: str, relations: Collection[str] = ()) -> bool:
    """Leading word of a read statement, and a parsed tree that :mod:`plumbline.operators.gate` accepts whole."""
    if not sql.lstrip().lower().startswith(READ_WORDS):
        return False
    try:
        gate.check_statement(spark, sql, relations=relations)
    except gate.NotAllowed:
        return False
    return True


def guarded_query(
    spark: SparkSession, sql: str, params: Mapping | None = None, max_rows: int = DEFAULT_ROWS, frames: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Read-only SQL with a row cap of 1..100000, as a lazy DataFrame; a cap outside these bounds raises.

    ``{name}`` in the statement stands for a DataFrame of ``frames``. Relations must be known to the catalog or bound that way: files
    are not read by their path.
    """
    if not sql or not sql.strip():
        raise ValueError("Query is required")
    if not sql.lstrip().lower().startswith(READ_WORDS):
        raise ValueError("Only read-only queries are allowed")
    frames = dict(frames or {})
    gate.check_statement(spark, sql.format(**{name: f"`{name}`" for name in frames}) if frames else sql, relations=frames)
    if not 1 <= int(max_rows) <= MAX_ROWS:
        raise ValueError(f"max_rows must lie between 1 and {MAX_ROWS}")
    return spark.sql(sql, args=dict(params) if params else None, **frames).limit(int(max_rows))


def guarded_rows(spark: SparkSession, sql: str, params: Mapping | None = None, max_rows: int = DEFAULT_ROWS, timeout_seconds: float = 30.0) -> list:
    """Rows of :func:`guarded_query`; its jobs are cancelled after ``timeout_seconds``, which raises ``TimeoutError``."""
    tag, context, late = f"guarded-{uuid.uuid4().hex}", spark.sparkContext, threading.Event()

    def cancel() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_seconds, cancel)
    context.addJobTag(tag)
    timer.start()
    try:
        return guarded_query(spark, sql, params, max_rows).collect()
    except Exception as exc:
        if late.is_set():
            raise TimeoutError(f"the query took more than {timeout_seconds} seconds") from exc
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def is_truncated(spark: SparkSession, sql: str, params: Mapping | None = None, max_rows: int = DEFAULT_ROWS) -> bool:
    """Whether the result has at least ``max_rows`` rows; the probe stops there."""
    return guarded_query(spark, sql, params, max_rows).count() >= int(max_rows)


def query_over_frames(spark: SparkSession, sql: str, frames: Mapping[str, DataFrame]) -> DataFrame:
    """SQL over named DataFrames, bound for this call only: by ``{name}`` in the statement, else by plain names.

    Plain names are temporary views while Spark resolves the statement; views of these names that were there before come back.
    """
    if any("{" + name + "}" in sql for name in frames):
        return spark.sql(sql, **frames)
    before = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and t.name in {n.lower() for n in frames}}
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        for name in frames:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)


def fingerprint(sql):
    """sha256 of the statement in lower case with whitespace collapsed."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(sql), r"\s+", " ")), 256)


def query_fingerprints(log_df: DataFrame, sql: str = "query_executed", millis: str = "execution_time_ms") -> DataFrame:
    return log_df.groupBy(fingerprint(F.col(sql)).alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg(millis).alias("avg_ms"))


def recover_json(df: DataFrame, col: str) -> DataFrame:
    """Adds ``recovered`` (variant) and ``json_text``: the text itself, else its fenced block, else first { to last }.

    A fence that matches but does not parse gives NULL; the braces are then not tried.
    """
    text = F.col(col)
    fenced = F.regexp_extract(text, r"(?s)```json\n(.*?)\n```", 1)
    has_fence = F.rlike(text, F.lit(r"(?s)```json\n.*?\n```"))
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    direct = F.try_parse_json(text)
    recovered = F.when(direct.isNotNull(), direct).when(has_fence, F.try_parse_json(fenced)).otherwise(
        F.try_parse_json(F.when(braces != "", braces)))
    return df.withColumn("recovered", recovered).withColumn("json_text", F.to_json("recovered"))


def rank_entities(catalog_df: DataFrame, query: str, name: str = "name", last_used: str = "last_used") -> DataFrame:
    """10 per query word found among the name's parts, 5 more when recently used."""
    words = F.array(*[F.lit(w) for w in sorted(set(query.lower().split()))]).cast("array<string>")
    overlap = F.size(F.array_intersect(F.split(F.lower(name), "_"), words))
    used = F.when(F.coalesce(F.col(last_used).cast("string"), F.lit("")).isin("", "false"), 0).otherwise(5)
    return catalog_df.select(F.col(name).alias("name"), (overlap * 10 + used).alias("score")).orderBy(F.desc("score"), "name")


def schema_summary(columns_df: DataFrame, max_cols: int | None = 10) -> DataFrame:
    """One line per table: ``name (type), ...`` of its first columns (all with ``max_cols=None``)."""
    listed = columns_df if max_cols is None else columns_df.filter(F.col("ordinal_position") <= max_cols)
    entry = F.struct("ordinal_position", F.format_string("%s (%s)", "name", "data_type").alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), ", ")
    return listed.groupBy("table_name").agg(F.concat(F.lit("Table "), F.first("table_name"), F.lit(": "), joined).alias("summary"))


def plan_bottlenecks(plan_df: DataFrame) -> DataFrame:
    """Costly nodes of logged JSON plans: large sequential scans and nested loops.

    Plans are walked level by level for all rows at once; each level is one explode.
    """
    roots = F.try_variant_get(F.try_parse_json("plan_json"), "$", "array<variant>")
    level = cut_lineage(plan_df.select("plan_id", F.explode(roots).alias("p")).select(
        "plan_id", F.try_variant_get("p", "$.Plan", "variant").alias("node")).filter("node IS NOT NULL"))
    found = []
    while not level.isEmpty():
        found.append(_flag(level))
        children = F.try_variant_get("node", "$.Plans", "array<variant>")
        level = cut_lineage(level.select("plan_id", F.explode(children).alias("node")))
    if not found:
        return _flag(level)
    return reduce(DataFrame.unionByName, found)


def _flag(nodes: DataFrame) -> DataFrame:
    kind = F.try_variant_get("node", "$['Node Type']", "string")
    rows = F.coalesce(F.try_variant_get("node", "$['Plan Rows']", "double"), F.lit(0.0))
    named = nodes.select("plan_id", kind.alias("kind"), rows.alias("rows"),
                         F.try_variant_get("node", "$['Relation Name']", "string").alias("table_name"))
    scan = (F.col("kind") == "Seq Scan") & (F.col("rows") > 10000)
    loop = (F.col("kind") == "Nested Loop") & (F.col("rows") > 1000)
    return named.filter(scan | loop).select(
        "plan_id",
        F.when(scan, "Performance Risk").otherwise("Optimization Opportunity").alias("type"),
        F.when(scan, "Sequential Scan").otherwise("Nested Loop Join").alias("node"),
        F.when(scan, F.col("table_name")).alias("table_name"),
        F.when(scan, "High").otherwise("Medium").alias("impact"),
        F.when(scan, F.format_string("Add an index to the columns used in the filter for table '%s'.", "table_name")).otherwise(
            "Consider if a Hash Join would be more efficient by ensuring table statistics are up to date.").alias("suggestion"))
