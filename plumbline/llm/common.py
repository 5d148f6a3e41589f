"""Helpers that several operators share: word patterns, folds, whole-column Python passes, let-bindings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def fold(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id falls into fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % mod


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once: a lambda variable is bound, never inlined again by the optimizer."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between white space; an empty array for null and for blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN, -1), "")


def window_hashes(words: Column, size: int) -> Column:
    """64-bit hashes of all windows of ``size`` consecutive words, by doubling: no window is ever built.

    Fewer words than ``size`` give an empty array. Equal windows have equal hashes, whatever text they stand in.
    """
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda ones: F.slice(
        _hashes_of(ones, size), 1, F.greatest(F.size(ones) - size + 1, F.lit(0))))


def _hashes_of(ones: Column, size: int) -> Column:
    if size == 1:
        return ones
    half = 1 << ((size - 1).bit_length() - 1)  # the largest power of two below size
    left = _hashes_of(ones, half)
    if size == 2 * half:
        return let(left, lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + half))))
    return let(left, lambda a: let(_hashes_of(ones, size - half), lambda b: F.transform(a, lambda x, i: F.xxhash64(x, F.get(b, i + half)))))


def by_batches(fn: Callable[[list], pd.DataFrame | pd.Series], returns: T.DataType | str, setup: Callable[[], object] | None = None):
    """Pandas UDF over one column. ``fn(values)`` or, with ``setup``, ``fn(values, state)``; state is built once a task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        state = setup() if setup else None
        for batch in batches:
            values = batch.tolist()
            yield fn(values, state) if setup else fn(values)

    if isinstance(returns, T.StructType):
        def typed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            yield from run(batches)
    else:
        def typed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from run(batches)
    return F.pandas_udf(typed, returns)


def map_column(df: DataFrame, column: str, returns: dict[str, T.DataType], fn: Callable[[list, object], list[pa.Array]], setup: Callable[[], object], rows: int = 256) -> DataFrame:
    """The input with the columns ``returns`` that ``fn(values, state)`` makes from ``column``, a few rows at a time.

    Arrow batches pass in slices, so a task holds one batch as Arrow and only a slice of it as Python objects.
    """
    kept = without(df, *returns)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(name, kind) for name, kind in returns.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                made = fn(part.column(column).to_pylist(), state)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *returns])

    return kept.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send Python at most ``rows`` rows at a time: a task holds a batch several times over outside of its heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key, None)
    if was is None or not 0 < int(was) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def in_parts(values: list, chars: int) -> Iterator[list]:
    """Consecutive runs of texts with about ``chars`` characters each, at least one text; keeps memory even."""
    part, held = [], 0
    for value in values:
        part.append(value)
        held += len(value or "")
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns that an operator is about to add; names match in any case, as in Spark."""
    wanted = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in wanted])
