"""Masking as column expressions; they run inside whole-stage codegen, batch or stream."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed

STARS = "****"


def _local_masked(text: Column) -> Column:
    parts = F.split(text, "@")
    local, domain = F.get(parts, 0), F.get(parts, 1)
    return F.when(F.length(local) > 3, F.concat(F.substring(local, 1, 3), F.lit("****@"), domain)).otherwise(
        F.concat(F.repeat(F.lit("*"), F.length(local)), F.lit("@"), domain))


# kind -> (whether the mask applies to a text, the masked text); built only for the kind in use
_KINDS = {
    "email": (lambda t: F.contains(t, F.lit("@")), lambda t, p: _local_masked(t)),
    "ssn": (lambda t: F.length(t) >= 9, lambda t, p: F.concat(F.lit("***-**-"), F.right(t, F.lit(4)))),
    "credit_card": (lambda t: F.length(t) >= 4, lambda t, p: F.concat(F.lit("****-****-****-"), F.right(t, F.lit(4)))),
    "phone": (lambda t: F.length(t) >= 4, lambda t, p: F.concat(F.lit("****-****-"), F.right(t, F.lit(4)))),
    "name": (lambda t: F.length(t) > 0, lambda t, p: F.concat(F.substring(t, 1, 1), F.lit(STARS))),
    "generic": (lambda t: t.isNotNull(), lambda t, p: F.lit(STARS)),
    "custom": (lambda t: t.isNotNull(), lambda t, p: F.lit(p.get("mask_pattern", STARS))),
    "hash": (lambda t: t.isNotNull(), lambda t, p: F.sha2(t, 256)),
}


def is_masked(col: Column, kind: str | None) -> Column:
    """Whether :func:`mask_column` changes the value; NULL is never masked."""
    if kind not in _KINDS:
        return F.lit(False)
    return F.coalesce(_KINDS[kind][0](col.cast("string")), F.lit(False))


def mask_column(col: Column, kind: str | None, params: Mapping[str, str] | None = None) -> Column:
    """Masked text of ``col``; values the kind does not apply to stay as they are."""
    text = col.cast("string")
    if kind not in _KINDS:
        return text
    applies, masked = _KINDS[kind]
    return F.when(applies(text), masked(text, params or {})).otherwise(text)


def partial_redaction(col: Column) -> Column:
    """First and last two characters kept; short values vanish, NULL stays NULL."""
    text = col.cast("string")
    stars = F.repeat(F.lit("*"), F.greatest(F.length(text) - 4, F.lit(0)))
    return F.when(F.length(text) <= 4, F.lit(STARS)).when(
        text.isNotNull(), F.concat(F.substring(text, 1, 2), stars, F.right(text, F.lit(2))))


def redact(df: DataFrame, role: str) -> DataFrame:
    """Partial redaction of the columns with a sensitive word in their name, for all but admins."""
    if role == "admin":
        return df
    return df.select(*[
        partial_redaction(F.col(f"`{c}`")).alias(c) if any(w in c.lower() for w in fixed.REDACTED_WORDS)
        else F.col(f"`{c}`")
        for c in df.columns
    ])


def is_sensitive_key(name: str) -> bool:
    return any(name.lower() in hints for hints in fixed.NAME_HINTS.values())


def redact_stream(df: DataFrame) -> DataFrame:
    """``****`` in every column whose name is a known hint, NULLs included; works on streams."""
    return df.select(*[
        F.lit(STARS).alias(c) if is_sensitive_key(c) else F.col(f"`{c}`") for c in df.columns
    ])


def mask_by_role(col: Column, role: str) -> Column:
    """admin sees the value, analyst a partial e-mail mask, viewer a fixed shape, others nothing."""
    if role == "admin":
        return col.cast("string")
    if role == "analyst":
        return mask_column(col, "email")
    if role == "viewer":
        return F.when(col.isNotNull(), F.lit("***@***"))
    return F.lit(None).cast("string")
