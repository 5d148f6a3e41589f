"""Column expressions of the sensitive-data detectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed_values as fixed
from plumbline.functions.text import contains_any


def name_hint(name: Column) -> Column:
    """Kind suggested by a column name, NULL when none."""
    return F.coalesce(*[F.when(contains_any(name, hints), F.lit(kind)) for kind, hints in fixed.NAME_HINTS.items()])


def semantic_kind(name: Column, data_type: Column) -> Column:
    """(kind, confidence) struct from naming rules, NULL when none applies."""
    def has(word):
        return F.contains(F.lower(name), F.lit(word))

    def found(kind, confidence):
        return F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))

    dated = F.coalesce(F.contains(F.lower(data_type), F.lit("date")), F.lit(False))
    return (
        F.when(has("uuid") & has("token"), found("password", 0.6))
        .when(has("hash") & (has("password") | has("pwd")), found("password", 0.7))
        .when(dated & (has("birth") | has("dob")), found("date_of_birth", 0.7))
    )


def matches(value: Column, kind: str) -> Column:
    return F.coalesce(F.rlike(F.trim(value), F.lit("(?i)" + fixed.VALUE_PATTERNS[kind])), F.lit(False))


def is_testable(value: Column) -> Column:
    return F.coalesce(~F.trim(value).isin("", "None"), F.lit(False))


@F.arrow_udf(T.DoubleType())
def entropy(values: pa.Array) -> pa.Array:
    """Shannon bits per character; 0 for the empty string, NULL for NULL.

    The characters of a batch are sorted together, text by text, so that equal ones of a text are adjacent; then the run lengths are
    summed by text: linear after the sort, whatever the texts' length.
    """
    values = values.cast(pa.large_binary())
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)
    ends = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.append(data[ends[0] : ends[-1]], np.zeros(3, dtype=np.uint8)).astype(np.int64)
    n_bytes, owner = len(data) - 3, np.repeat(np.arange(len(values)), np.diff(ends))
    # a character's code is its bytes, put together; a text's first byte starts one in any case
    first = (data[:n_bytes] & 0xC0) != 0x80
    first[1:] |= owner[1:] != owner[:-1]
    first[:1] = True
    starts = np.flatnonzero(first)
    width = np.diff(np.append(starts, n_bytes))
    codes = data[starts]
    for k in range(1, min(4, int(width.max(initial=1)))):
        codes |= np.where(width > k, data[starts + k], 0) << (8 * k)
    owner = owner[starts]
    marks = np.sort(owner << 32 | codes)
    edges = np.flatnonzero(np.append(True, marks[1:] != marks[:-1])) if len(marks) else np.zeros(0, dtype=np.int64)
    run = np.diff(np.append(edges, len(marks)))
    summed = np.bincount(marks[edges] >> 32, run * np.log2(run), minlength=len(values))
    size = np.maximum(np.bincount(owner, minlength=len(values)), 1)
    return pa.array(np.maximum(np.log2(size) - summed / size, 0.0), mask=values.is_null().to_numpy(zero_copy_only=False))


def sensitivity(kind: Column) -> Column:
    return (
        F.when(kind.isin(fixed.RESTRICTED_KINDS), "restricted")
        .when(kind.isin(fixed.CONFIDENTIAL_KINDS), "confidential")
        .otherwise("internal")
    )


# the value patterns without anchors, for finding hits inside running text
FREE_TEXT_PATTERNS = {kind: pattern[1:-1] for kind, pattern in fixed.VALUE_PATTERNS.items()}


def may_hold_hits(text: Column) -> Column:
    """Cheap necessary condition of every pattern: an @, three digits in a row, or a dotted digit."""
    return F.contains(text, F.lit("@")) | F.rlike(text, F.lit(r"[0-9]{3}|[0-9]\.[0-9]"))


def text_hits(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit("(?i)" + FREE_TEXT_PATTERNS[kind]))
