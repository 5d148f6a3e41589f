"""Column profiles: one scan, one shuffle of distinct (column, value) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window



def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def as_text(field: T.StructField) -> Column:
    """Text image of a column under which equal values stay equal and different ones differ."""
    col = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (col + F.lit(0.0)).cast("string")  # folds -0.0 into 0.0
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(col.isNotNull(), F.to_json(F.struct(col.alias("v"))))
    if isinstance(kind, T.BinaryType):
        return F.hex(col)
    return col.cast("string")


def _slot(field: T.StructField) -> tuple[str, Column, Column]:
    """Where a column's values travel: slot name, value as stored, and its text read back from the slot.

    Integers, dates, times and booleans share a long slot, floats a double one, all else text, so
    values of differently typed columns fit one narrow row without being formatted.
    """
    col, kind = F.col(f"`{field.name}`"), field.dataType
    whole, real, text = F.col("l"), F.col("d"), F.col("s")
    if isinstance(kind, T.IntegralType):
        return "l", col.cast("long"), whole.cast("string")
    if isinstance(kind, T.BooleanType):
        return "l", col.cast("long"), (whole == 1).cast("string")
    if isinstance(kind, T.DateType):
        return "l", F.unix_date(col).cast("long"), F.date_from_unix_date(whole.cast("int")).cast("string")
    if isinstance(kind, T.TimestampType):
        return "l", F.unix_micros(col), F.timestamp_micros(whole).cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "d", col.cast("double"), real.cast(kind).cast("string")
    return "s", as_text(field), text


def slot_counts(
    df: DataFrame, names: Sequence[str], keys: Sequence[Column] = (), latest: Column | None = None
) -> DataFrame:
    """(k0.., c, l, d, s, n [, latest]): how often each value of column number ``c`` occurs, NULL included.

    Counting happens map-side first, so a value held by most rows costs one row per task.
    """
    slots = [_slot(df.schema[n]) for n in names]
    types = {"l": "long", "d": "double", "s": "string"}
    cells = F.array(*[
        F.struct(F.lit(i).alias("c"), *[
            (value if slot == s else F.lit(None).cast(types[s])).alias(s) for s in types])
        for i, (slot, value, _) in enumerate(slots)
    ])
    key_names = [f"k{i}" for i in range(len(keys))]
    carried = [k.alias(n) for k, n in zip(keys, key_names)]
    aggs = [F.count(F.lit(1)).alias("n")]
    if latest is not None:
        carried.append(latest.alias("at"))
        aggs.append(F.max("at").alias("latest"))
    return df.select(*carried, F.inline(cells)).groupBy(*key_names, "c", "l", "d", "s").agg(*aggs)


def slot_is_null() -> Column:
    return F.col("l").isNull() & F.col("d").isNull() & F.col("s").isNull()


def _by_number(pairs: Sequence[tuple[int, Column]]) -> Column:
    return F.coalesce(*[F.when(F.col("c") == i, value) for i, value in pairs])


def _column_name(names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col("c") + 1)


def value_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, n) for every distinct value, NULL included; values as text."""
    names = list(cols or df.columns)
    text = _by_number([(i, _slot(df.schema[n])[2]) for i, n in enumerate(names)])
    return slot_counts(df, names).select(_column_name(names).alias("column_name"), text.alias("value"), "n")


def profile_columns(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    approx: bool = False,
    sample: float | None = None,
    seed: int = 42,
    extended: bool = False,
) -> DataFrame:
    """Per column: total, non_null, null_count, distinct_count, cardinality [, min, max, avg].

    ``approx`` swaps the exact distinct count for HyperLogLog, which leaves a single-row
    aggregate and no shuffle of values. ``sample`` profiles a Bernoulli fraction of the rows.
    """
    names = list(cols or df.columns)
    if sample is not None and sample < 1.0:
        df = df.sample(fraction=sample, seed=seed)
    if approx:
        counted = _sketched(df, names)
    else:
        counted = (
            slot_counts(df, names)
            .groupBy("c")
            .agg(
                F.sum("n").alias("total"),
                F.sum(F.when(~slot_is_null(), F.col("n")).otherwise(0)).alias("non_null"),
                F.count_if(~slot_is_null()).alias("distinct_count"),
            )
            .withColumn("column_name", _column_name(names))
        )
        every = df.sparkSession.createDataFrame([(n,) for n in names], "column_name string")
        counted = every.join(counted, "column_name", "left").fillna(0, ["total", "non_null", "distinct_count"])
    result = counted.select(
        "column_name",
        "total",
        "non_null",
        (F.col("total") - F.col("non_null")).alias("null_count"),
        "distinct_count",
        F.when(F.col("total") > 0, F.round(F.col("distinct_count") / F.col("total"), 6)).otherwise(0.0).alias("cardinality"),
    )
    if extended:
        result = result.join(column_ranges(df, names), "column_name")
    return result


def sample_fraction(total_rows: int, sample_size: int = 10000) -> float:
    """Share of rows to read so that about ``sample_size`` remain; 1.0 for small tables."""
    return 1.0 if total_rows <= sample_size else sample_size / total_rows


def hash_sample(df: DataFrame, keys: Sequence[str], fraction: float) -> DataFrame:
    """The rows whose keys hash below ``fraction``: the same ones on every run, in every engine, and in every table that has these keys."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("long")
    return df.where(place < int(fraction * (1 << 32)))


def _sketched(df: DataFrame, names: Sequence[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, name in enumerate(names):
        aggs.append(F.count(F.col(f"`{name}`")).alias(f"c{i}"))
        aggs.append(F.approx_count_distinct(_slot(df.schema[name])[1]).alias(f"d{i}"))
    rows = F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.col("total"), F.col(f"c{i}").alias("non_null"),
                 F.col(f"d{i}").alias("distinct_count"))
        for i, name in enumerate(names)
    ])
    return df.agg(*aggs).select(F.inline(rows))


def column_ranges(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, min_value, max_value, avg_value) in one map-side-combined aggregate."""
    names = list(cols or df.columns)
    aggs, rows = [], []
    for i, name in enumerate(names):
        kind, col = df.schema[name].dataType, F.col(f"`{name}`")
        numeric = isinstance(kind, T.NumericType)
        ordered = isinstance(kind, T.AtomicType) and not isinstance(kind, T.BinaryType)
        aggs += [
            (F.min(col).cast("string") if ordered else F.max(F.lit(None).cast("string"))).alias(f"lo{i}"),
            (F.max(col).cast("string") if ordered else F.max(F.lit(None).cast("string"))).alias(f"hi{i}"),
            (F.round(F.avg(col), 4) if numeric else F.max(F.lit(None).cast("double"))).alias(f"av{i}"),
        ]
        rows.append(F.struct(F.lit(name).alias("column_name"), F.col(f"lo{i}").alias("min_value"),
                             F.col(f"hi{i}").alias("max_value"), F.col(f"av{i}").cast("double").alias("avg_value")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def freshest(df: DataFrame, ts_col: str) -> DataFrame:
    return df.agg(F.max(ts_col).alias("freshness"))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram of a numeric column: (bin, x, y) with x the bin's left edge."""
    low, high = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin long, x double, y long")
    width = (high - low) / bins or 1.0
    position = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(position.cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("y"))
        .select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("x"), "y")
    )


#: Spark limits rows of a rank filter before the exchange up to this rank.
GROUP_LIMIT = 1000
RANK_PARTS = 256


def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most frequent non-null values of each column, ties by value.

    The rank filter lets Spark keep only ``k`` rows per column in every task before the last
    exchange, so no task ever sees a column's full value list. Beyond a thousand ranks Spark drops that
    limit; the values are then ranked within salted parts first.
    """
    counted = value_counts(df, cols).filter(F.col("value").isNotNull())
    if k > GROUP_LIMIT:
        part = Window.partitionBy("column_name", F.pmod(F.xxhash64("value"), F.lit(RANK_PARTS))).orderBy(F.desc("n"), F.asc("value"))
        counted = counted.withColumn("__part_rank", F.row_number().over(part)).filter(F.col("__part_rank") <= k).drop("__part_rank")
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return (
        counted.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("column_name", "value", F.col("n").alias("count"), F.col("rank"))
    )


def completeness_percent(profile: DataFrame) -> DataFrame:
    """Mean of 100 - null% over profiled columns; unknown null counts add 0, no columns gives 50."""
    share = F.when(F.col("total") > 0, 100 - F.col("null_count") * 100.0 / F.col("total"))
    return profile.agg(
        F.coalesce(F.sum(F.coalesce(share, F.lit(0.0))) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(50.0))
        .alias("completeness_percent")
    )


def profile_history(
    df: DataFrame, table_id: str | Column, ts_col: str, period: str = "month", cols: Sequence[str] | None = None
) -> DataFrame:
    """One profile snapshot per (table, period): the history the change detectors read.

    Values are counted per (table, period, column) first; the nested column array is as wide as
    the table, never as long.
    """
    names = [c for c in (cols or df.columns) if c != ts_col]
    key = F.col(table_id) if isinstance(table_id, str) else table_id
    starts = F.date_trunc(period, F.col(ts_col))
    per_column = (
        slot_counts(df.filter(F.col(ts_col).isNotNull()), names, [key, starts], F.col(ts_col))
        .groupBy(F.col("k0").alias("table_id"), F.col("k1").alias("__start"), "c")
        .agg(
            F.sum("n").alias("total"),
            F.sum(F.when(slot_is_null(), F.col("n")).otherwise(0)).alias("nulls"),
            F.count_if(~slot_is_null()).alias("distinct_count"),
            F.max("latest").alias("latest"),
        )
        .withColumn("name", _column_name(names))
    )
    entry = F.struct(
        F.col("name"),
        F.round(F.col("nulls") * 100.0 / F.col("total"), 6).alias("null_percentage"),
        F.col("distinct_count"),
    )
    step = F.expr({"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH",
                   "quarter": "INTERVAL 3 MONTHS", "year": "INTERVAL 1 YEAR"}[period])
    return per_column.groupBy("table_id", "__start").agg(
        F.max("total").alias("row_count"),
        F.max("latest").alias("last_updated"),
        F.array_sort(F.collect_list(entry)).alias("columns"),
    ).select(
        "table_id",
        (F.col("__start") + step).alias("created_at"),
        "last_updated",
        "row_count",
        F.lit(None).cast("double").alias("update_frequency_hours"),
        "columns",
    )
