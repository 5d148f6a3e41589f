"""Order-dependent computations that do not need a whole group in one task.

A plain window ``PARTITION BY key ORDER BY t`` sends every row of a key to one task. Here the rows are range-partitioned by key, order
and ties, and stored with the number of their partition, so a part of one key is a stretch of its order however hot the key, or one
single order value, may be. A window runs inside each (key, part); what the parts before it add is a summary with one row for each part
that a key spans. Cut points stay inside Spark's range partitioner: the plan is as large for a million parts as for two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.session import work_path

PART = "__part"
KEY = "__key"
ROW = "__row"


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows with their keys as one struct ``KEY`` and ``PART``, their place in a range partitioning by keys and order.

    The struct groups, windows and joins NULL keys like any other value. Equal rows are told apart by ``ROW``, the place in the input, so even a
    single hot order value falls into several parts. The result is a stored table: parts keep their numbers however often
    they are read, and the input is read once to sample and once to store. Without ``parts`` there are as many as the session's shuffle partitions,
    or fewer where adaptive execution joins small ones.
    """
    spark = df.sparkSession
    keyed = df.withColumn(KEY, F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))).withColumn(ROW, F.monotonically_increasing_id())
    by = [KEY, *order, ROW]
    cut = keyed.repartitionByRange(parts, *by) if parts else keyed.repartitionByRange(*by)
    path = work_path(spark, "ranged")
    cut.withColumn(PART, F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(cut.withColumn(PART, F.spark_partition_id()).schema).parquet(path)


def _inside(*order: str | Column):
    return Window.partitionBy(PART, KEY).orderBy(*order, ROW)


def _carried(cut: DataFrame, summary: Column, fold) -> DataFrame:
    """(PART, KEY, __before): ``fold`` of the summaries of the key's earlier parts; keys within one part have no row."""
    earlier = Window.partitionBy(KEY).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(PART, KEY).agg(summary.alias("__sum"))
    return parts.withColumn("__before", fold("__sum").over(earlier)).filter("__before IS NOT NULL").drop("__sum")


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    out: str = "rn",
    segments: int | None = None,
) -> DataFrame:
    """1-based row number of each row within ``keys`` by ``order`` then ``ties``, NULLs first."""
    cut = ranged(df, keys, [order, *ties], segments)
    local = cut.withColumn(out, F.row_number().over(_inside(order, *ties)).cast("long"))
    joined = local.join(_carried(cut, F.count(F.lit(1)), F.sum), [PART, KEY], "left")
    return joined.withColumn(out, F.col(out) + F.coalesce("__before", F.lit(0))).select(*[c for c in df.columns if c != out], out)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: str, ties: Sequence[str] = (), out: str = "running",
    segments: int | None = None,
) -> DataFrame:
    """Cumulative sum of ``value`` within ``keys`` by ``order`` then ``ties``, NULLs first; NULL values add nothing."""
    cut = ranged(df, keys, [order, *ties], segments)
    local = cut.withColumn(out, F.sum(value).over(_inside(order, *ties).rowsBetween(Window.unboundedPreceding, 0)))
    joined = local.join(_carried(cut, F.sum(value), F.sum), [PART, KEY], "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(0)) + F.coalesce("__before", F.lit(0))).select(*[c for c in df.columns if c != out], out)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    value: str,
    segments: int | None = None,
) -> DataFrame:
    """Adds to every left row the ``value`` of the latest right row at or before its time.

    Both sides are stacked and scanned once per (key, part); no pair of rows is ever formed.
    Right rows that share a time are resolved to the largest value; a latest row whose value is NULL gives NULL. A NULL key
    or a NULL time matches nothing.
    """
    payload = F.struct(*[F.col(c) for c in left.columns])
    lefts = left.select(*keys, F.col(left_time).alias("__t"), payload.alias("__left"),
                        F.lit(None).cast(T.StructType([T.StructField("v", right.schema[value].dataType)])).alias("__v"), F.lit(1).alias("__side"))
    rights = right.dropna(subset=[*keys, right_time]).select(
        *keys, F.col(right_time).alias("__t"), F.lit(None).cast(lefts.schema["__left"].dataType).alias("__left"),
        F.struct(F.col(value).alias("v")).alias("__v"), F.lit(0).alias("__side"))  # a struct, so that a NULL value is still the latest row
    cut = ranged(lefts.unionByName(rights), keys, ["__t", "__side", "__v"], segments)
    window = _inside("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("__seen", F.last("__v", ignorenulls=True).over(window)).filter("__side = 1")
    # parts that hold left rows only still get a carry row
    newest = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct("__t", "__v")))
    joined = local.join(_carried(cut, newest, lambda c: F.last(c, ignorenulls=True)), [PART, KEY], "left")
    return joined.select("__left.*", F.coalesce("__seen", "__before")["v"].alias(value))
