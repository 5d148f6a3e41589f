"""Column expressions over names and numbers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed


def contains_any(name: Column, words: Iterable[str]) -> Column:
    """True when the lowercase ``name`` holds one of ``words`` as a substring."""
    alternation = "|".join(w.replace(".", r"\.") for w in words)
    return F.coalesce(F.lower(name).rlike(alternation), F.lit(False))


def title_case(name: Column) -> Column:
    """``order_line_items`` → ``Order Line Items``."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(name, "_+", " "), r"\s+", " ")))


def _or_original(cleaned: Column, name: Column) -> Column:
    return F.when(cleaned == "", name).otherwise(cleaned)


def entity_name(table_name: Column) -> Column:
    return _or_original(title_case(F.regexp_replace(table_name, fixed.ENTITY_SUFFIX, "")), table_name)


def entity_label(table_name: Column) -> Column:
    """Entity name as used in sentences: bridge suffix stripped too, one trailing s dropped."""
    titled = title_case(F.regexp_replace(table_name, fixed.ENTITY_SUFFIX_WIDE, ""))
    return _or_original(F.regexp_replace(titled, "s$", ""), table_name)


def metric_name(column_name: Column) -> Column:
    return _or_original(title_case(F.regexp_replace(column_name, fixed.METRIC_PREFIX, "")), column_name)


def short_number(value: Column) -> Column:
    """1234567 → 1.2M, 1234 → 1.2K."""
    whole = value.cast("long")
    return (
        F.when(whole >= 1_000_000, F.format_string("%.1fM", whole / 1_000_000.0))
        .when(whole >= 1_000, F.format_string("%.1fK", whole / 1_000.0))
        .otherwise(whole.cast("string"))
    )
