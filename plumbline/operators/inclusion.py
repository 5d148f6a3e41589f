"""Inclusion dependencies: which columns hold only values of which other columns, for all pairs from one pass over each table.

Each distinct value is turned round once, from "the values of a column" to "the columns that have a value". Two columns share as many values
as they meet in these lists, so all pairs come out of one aggregation, without a join of any two tables. Values that most rows repeat are
counted map-side first; a list is as long as there are columns, never as long as a table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Families of types whose values are compared with each other; others take no part.
_WHOLE, _TEXT, _DAY, _EXACT = "whole", "text", "day", "exact"


def _family(kind: T.DataType) -> str | None:
    if isinstance(kind, T.IntegralType):
        return _WHOLE
    if isinstance(kind, T.StringType):
        return _TEXT
    if isinstance(kind, T.DateType):
        return _DAY
    if isinstance(kind, T.DecimalType):
        return _EXACT
    return None


def _cell(number: int, column: str, kind: T.DataType) -> Column:
    col, family = F.col(f"`{column}`"), _family(kind)
    text = F.regexp_replace(col.cast("string"), r"\.?0+$", "") if family == _EXACT and kind.scale else col.cast("string")
    whole = col.cast("long") if family == _WHOLE else F.lit(None).cast("long")
    return F.struct(F.lit(number).alias("c"), F.lit(family).alias("family"), whole.alias("l"), (F.lit(None).cast("string") if family == _WHOLE else text).alias("s"))


def inclusions(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(source_table, source_column, target_table, target_column, n_values, n_shared, n_rows, n_matched, containment_pct) of all pairs that share a value.

    ``n_values`` and ``n_rows`` count the distinct values and the non-null rows of the source, ``n_shared`` and ``n_matched`` those whose value
    the target has; ``containment_pct`` is by rows. ``columns`` picks columns; by default all of whole-number, text, date or decimal type take part.
    """
    named: list[tuple[str, str]] = []
    counted = []
    for table, df in tables.items():
        cells = []
        for field in df.schema.fields:
            if _family(field.dataType) and (columns is None or field.name in columns.get(table, ())):
                cells.append(_cell(len(named), field.name, field.dataType))
                named.append((table, field.name))
        if cells:
            counted.append(df.select(F.inline(F.array(*cells))).where("l IS NOT NULL OR s IS NOT NULL").groupBy("c", "family", "l", "s").agg(F.count(F.lit(1)).alias("n")))
    if not counted:
        raise ValueError("no column takes part")
    # a column occurs once with a value, so the list of a value has one entry a column
    held = reduce(DataFrame.unionByName, counted).groupBy("family", "l", "s").agg(F.collect_list(F.struct("c", "n")).alias("held"))
    met = held.select(F.explode("held").alias("a"), "held").select("a.c", "a.n", F.explode("held.c").alias("d"))
    pairs = met.groupBy("c", "d").agg(F.count(F.lit(1)).alias("n_shared"), F.sum("n").alias("n_matched"))
    own = pairs.where("c = d").select("c", F.col("n_shared").alias("n_values"), F.col("n_matched").alias("n_rows"))
    place = lambda c, i: F.element_at(F.array(*[F.lit(n[i]) for n in named]), F.col(c) + 1)
    return pairs.where("c <> d").join(F.broadcast(own), "c").select(  # one row a column
        place("c", 0).alias("source_table"), place("c", 1).alias("source_column"), place("d", 0).alias("target_table"), place("d", 1).alias("target_column"),
        "n_values", "n_shared", "n_rows", "n_matched", F.round(100.0 * F.col("n_matched") / F.col("n_rows"), 4).alias("containment_pct"))


def dependencies(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] | None = None, least_values: int = 1) -> DataFrame:
    """The pairs of :func:`inclusions` where the target has every value of the source, of sources with ``least_values`` distinct ones."""
    return inclusions(tables, columns).where((F.col("n_shared") == F.col("n_values")) & (F.col("n_values") >= least_values))
