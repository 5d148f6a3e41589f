"""Sensitive-column scan: four detectors over names, types and frequent values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import detectors as D
from plumbline.functions import fixed_values as fixed
from plumbline.operators.profiling import top_values
from plumbline.session import dealt

METHODS = ["column_name", "data_pattern", "entropy", "semantic"]


def pattern_counts(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Per ``keys``: number of values and hits of each pattern; one map-side-combined aggregate."""
    usable = D.is_testable(F.col(value))
    return values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_values"),
        *[F.count_if(usable & D.matches(F.col(value), kind)).alias(kind) for kind in fixed.VALUE_PATTERNS],
    )


def best_pattern(counts: DataFrame) -> DataFrame:
    """Adds pii_type (most hits, earliest pattern on ties), hits and confidence."""
    kinds = list(fixed.VALUE_PATTERNS)
    top = F.greatest(*[F.col(k) for k in kinds])
    return (
        counts.withColumn("hits", top)
        .withColumn("pii_type", F.coalesce(*[F.when((top > 0) & (F.col(k) == top), F.lit(k)) for k in kinds]))
        .withColumn("confidence", F.when(top > 0, F.least(F.lit(1.0), top / F.col("n_values") * fixed.PATTERN_BOOST)))
    )


def value_entropy(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean entropy of the values per ``keys``."""
    return values.groupBy(*keys).agg(F.avg(D.entropy(F.col(value))).alias("avg_entropy"))


def name_detections(columns: DataFrame) -> DataFrame:
    """Name-hint and semantic findings per catalog column (needs name, data_type)."""
    semantic = D.semantic_kind(F.col("name"), F.col("data_type"))
    hinted = D.name_hint(F.col("name"))
    return columns.withColumn("hint_type", hinted).withColumn("semantic", semantic)


def combine(detected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per ``keys`` from the findings of all methods.

    ``detected`` has one struct<kind,confidence> column per method (NULL = not found). The most
    confident method wins, the earlier one on ties, and agreement adds confidence.
    """
    found = F.array_compact(F.array(*[
        F.when(F.col(m).isNotNull(), F.struct(
            F.col(m)["confidence"].alias("confidence"),
            F.lit(-i).alias("order"),
            F.col(m)["kind"].alias("kind"),
            F.lit(m).alias("method"),
        ))
        for i, m in enumerate(METHODS)
    ]))
    best = F.array_max(F.col("__found"))
    agreeing = F.size(F.filter(F.col("__found"), lambda d: d["kind"] == F.col("__best")["kind"]))
    return (
        detected.withColumn("__found", found)
        .filter(F.size("__found") > 0)
        .withColumn("__best", best)
        .select(
            *keys,
            F.col("__best")["kind"].alias("pii_type"),
            F.round(F.least(F.lit(1.0), F.col("__best")["confidence"] + fixed.AGREEMENT_BONUS * (agreeing - 1)), 6)
            .alias("confidence"),
            F.transform("__found", lambda d: d["method"]).alias("methods"),
            D.sensitivity(F.col("__best")["kind"]).alias("sensitivity_level"),
        )
    )


def detect_columns(columns: DataFrame, values: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Findings for catalog ``columns`` (keys, name, data_type), given their frequent ``values``
    (keys, value); without values only the name-based methods run."""
    named = columns.select(
        *keys,
        F.when(D.name_hint(F.col("name")).isNotNull(),
               F.struct(D.name_hint(F.col("name")).alias("kind"), F.lit(fixed.NAME_CONFIDENCE).alias("confidence")))
        .alias("column_name_hit"),
        D.semantic_kind(F.col("name"), F.col("data_type")).alias("semantic"),
    )
    nothing = F.lit(None).cast("struct<kind:string,confidence:double>")
    if values is None:
        joined = named.withColumn("data_pattern", nothing).withColumn("entropy", nothing)
    else:
        usable = D.is_testable(F.col("value"))
        measured = values.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_values"),
            F.avg(D.entropy(F.col("value"))).alias("avg_entropy"),
            *[F.count_if(usable & D.matches(F.col("value"), k)).alias(k) for k in fixed.VALUE_PATTERNS],
        )
        scored = best_pattern(measured).select(
            *keys,
            F.when(F.col("pii_type").isNotNull(),
                   F.struct(F.col("pii_type").alias("kind"), F.col("confidence"))).alias("data_pattern"),
            F.when(F.col("avg_entropy") > fixed.ENTROPY_LIMIT,
                   F.struct(F.lit("password").alias("kind"), F.lit(fixed.ENTROPY_CONFIDENCE).alias("confidence")))
            .alias("entropy"),
        )
        joined = named.join(scored, list(keys), "left")
    renamed = joined.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("column_name_hit").alias("column_name"),
                            "data_pattern", "entropy", "semantic")
    return combine(renamed, [f"__k_{k}" for k in keys]).withColumnsRenamed({f"__k_{k}": k for k in keys})


def scan_pii(
    df: DataFrame, table_name: str, types: Mapping[str, str] | None = None, top_k: int | None = None
) -> DataFrame:
    """Sensitive columns of one table.

    ``types`` overrides the declared type text of a column. Every non-null value is tested;
    ``top_k=10`` is the compatibility option that looks at a column's most frequent values only.
    """
    declared = {f.name: f.dataType.simpleString() for f in df.schema.fields} | dict(types or {})
    columns = df.sparkSession.createDataFrame(
        [(c, c, declared[c]) for c in df.columns], "column_name string, name string, data_type string")
    if top_k is None:
        from plumbline.operators.profiling import as_text

        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), as_text(df.schema[c]).alias("value")) for c in df.columns])
        values = dealt(df).select(F.inline(cells)).filter(F.col("value").isNotNull())
    else:
        values = top_values(df, k=top_k).select("column_name", "value")
    return detect_columns(columns, values, ["column_name"]).select(
        F.lit(table_name).alias("table_name"), "column_name", "pii_type", "confidence", "methods", "sensitivity_level")


def scan_summary(findings: DataFrame, columns: DataFrame) -> DataFrame:
    """Per table: scanned columns and sensitive ones; ``table_name`` NULL is the grand total."""
    flagged = columns.join(findings.select("table_name", "column_name", F.lit(1).alias("hit")),
                           ["table_name", "column_name"], "left")
    return flagged.rollup("table_name").agg(
        F.count(F.lit(1)).alias("columns_scanned"), F.count("hit").alias("pii_columns"),
        F.count_distinct(F.when(F.col("hit") == 1, F.col("table_name"))).alias("tables_with_pii"))


def text_pii_hits(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hits of every pattern in running text: (id, pii_type, n_hits), hits only; whole texts are read.

    Texts that cannot hold a hit are dropped by one linear test before the eight patterns run.
    """
    hits = F.array(*[
        F.struct(F.lit(kind).alias("pii_type"), D.text_hits(F.col(text_col), kind).cast("long").alias("n_hits"))
        for kind in fixed.VALUE_PATTERNS
    ])
    candidates = df.select(id_col, text_col).filter(D.may_hold_hits(F.col(text_col)))
    return candidates.select(F.col(id_col).alias("id"), F.inline(hits)).filter(F.col("n_hits") > 0)
