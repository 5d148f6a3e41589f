"""Filter, group-and-aggregate and user transforms."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.ordered import running_sum

_FILTERS: dict[str, Callable[[Column, Any], Column]] = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "between": lambda c, v: c.between(*v),
    "like": lambda c, v: c.like(v),
    "is_null": lambda c, v: c.isNull() if v in (None, True) else c.isNotNull(),
}


def filter_data(df: DataFrame, column: str, value: Any = None, op: str = "==") -> DataFrame:
    """Rows where ``column op value``; a plain predicate, so it reaches the scan."""
    if op not in _FILTERS:
        raise ValueError(f"unknown operator {op!r}; known: {sorted(_FILTERS)}")
    return df.filter(_FILTERS[op](F.col(f"`{column}`"), value))


_SIMPLE: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "nunique": F.count_distinct,
    "std": F.stddev_samp,
    "var": F.var_samp,
}


def aggregate(
    df: DataFrame,
    group_by: Sequence[str],
    aggs: Mapping[str, str | Sequence[str]],
    keep_null_keys: bool = False,
    order_by: str | None = None,
    approx: bool = False,
    sort: bool = False,
) -> DataFrame:
    """Group and aggregate by function name.

    Rows with a NULL key are left out unless ``keep_null_keys``. ``first`` / ``last`` follow
    ``order_by``. An exact ``median`` is found from value counts and a segmented running count;
    ``approx`` uses a quantile sketch instead. Result columns are ``col`` or, for several
    functions on one column, ``col_fn``.
    """
    keys = list(group_by)
    if not keep_null_keys:
        df = df.filter(reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys]))
    columns, medians = [], []
    for name, wanted in aggs.items():
        fns = [wanted] if isinstance(wanted, str) else list(wanted)
        for fn in fns:
            out, col = (name if len(fns) == 1 else f"{name}_{fn}"), F.col(f"`{name}`")
            if fn in _SIMPLE:
                columns.append(_SIMPLE[fn](col).alias(out))
            elif fn in ("first", "last"):
                if order_by is None:
                    raise ValueError(f"{fn} needs order_by")
                pick = F.min_by if fn == "first" else F.max_by
                columns.append(pick(col, F.when(col.isNotNull(), F.col(order_by))).alias(out))
            elif fn == "median":
                if approx:
                    columns.append(F.percentile_approx(col, 0.5).alias(out))
                else:
                    medians.append((name, out))
            else:
                raise ValueError(f"unknown aggregate {fn!r}")
    grouped = df.groupBy(*keys).agg(*columns) if columns else df.select(*keys).distinct()
    for name, out in medians:
        grouped = _join_on(grouped, exact_median(df, keys, name, out), keys)
    ordered = [*keys, *[_out_name(n, fn, w) for n, w in aggs.items() for fn in ([w] if isinstance(w, str) else w)]]
    result = grouped.select(*[F.col(f"`{c}`") for c in ordered])
    return result.orderBy(*keys) if sort else result


def _out_name(name, fn, wanted):
    return name if isinstance(wanted, str) or len(wanted) == 1 else f"{name}_{fn}"


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that also pairs NULL keys."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, on, "left").drop(*[f"__{k}" for k in keys])


def exact_median(df: DataFrame, keys: Sequence[str], column: str, out: str = "median") -> DataFrame:
    """Exact median per group without holding any group in one task.

    Equal values are counted first; the running count over values comes from equi-depth segments,
    and only the one or two middle values per group are kept.
    """
    counted = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    totals = counted.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    walked = _join_on(running_sum(counted, keys, "__v", "__n", out="__upto"), totals, keys)
    low, high = F.floor((F.col("__total") + 1) / 2), F.floor(F.col("__total") / 2) + 1
    start = F.col("__upto") - F.col("__n") + 1
    def covers(rank):
        return (start <= rank) & (rank <= F.col("__upto"))

    middle = F.when(covers(low), F.col("__v").cast("double")).otherwise(0.0) + F.when(covers(high), F.col("__v").cast("double")).otherwise(0.0)
    return walked.filter(covers(low) | covers(high)).groupBy(*keys).agg((F.sum(middle) / 2).alias(out))


def apply_frame(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """User code over the DataFrame itself; stays in the JVM."""
    return df.transform(fn)


def apply_pandas(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """User pandas code, batch by batch over Arrow, for row-wise logic. The output schema is declared."""
    def batches(frames: Iterator) -> Iterator:
        for pdf in frames:
            yield fn(pdf)

    return df.mapInPandas(batches, schema)
