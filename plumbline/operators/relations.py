"""Foreign keys: imported, inferred from names, and told in words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import entity_label

MANY_TO_ONE = "Many-to-One"


def _lower(name: str) -> Column:
    return F.lower(F.col(name))


def connection_of(tables_df: DataFrame) -> Column:
    """Connection of each catalog table; one for all where the catalog names none."""
    return F.coalesce("connection_id", F.lit("")) if "connection_id" in tables_df.columns else F.lit("")


def explicit_relationships(columns_df: DataFrame, tables_df: DataFrame, constraints_df: DataFrame) -> DataFrame:
    """Declared constraints resolved against the catalog, names compared without case.

    ``constraints_df``: source_table, source_column, target_table, target_column, and optionally connection_id. Both ends lie in
    one connection.
    """
    named = columns_df.select("table_id", "column_id", "name").join(
        tables_df.select("table_id", "table_name", connection_of(tables_df).alias("conn")), "table_id")

    def side(prefix):
        return named.select(
            "conn", F.lower("table_name").alias(f"{prefix}_t"), F.lower("name").alias(f"{prefix}_c"),
            F.col("table_name").alias(f"{prefix}_table"), F.col("name").alias(f"{prefix}_column"),
            F.col("table_id").alias(f"{prefix}_table_id"), F.col("column_id").alias(f"{prefix}_column_id"))

    scope = ["connection_id"] if "connection_id" in constraints_df.columns else []
    wanted = constraints_df.select(
        *[F.col(c).alias("conn") for c in scope], _lower("source_table").alias("source_t"), _lower("source_column").alias("source_c"),
        _lower("target_table").alias("target_t"), _lower("target_column").alias("target_c")).distinct()
    source_on = ["source_t", "source_c", *(["conn"] if scope else [])]
    found = wanted.join(side("source"), source_on).join(side("target"), ["target_t", "target_c", "conn"])
    return _relation(found, 0.95, "explicit_fk_constraint")


def _relation(df: DataFrame, confidence: float, method: str) -> DataFrame:
    return df.select(
        "source_table_id", "source_column_id", "source_table", "source_column",
        "target_table_id", "target_column_id", "target_table", "target_column",
        F.lit(MANY_TO_ONE).alias("relationship_type"), F.lit(confidence).alias("confidence_score"),
        F.lit(method).alias("discovery_method"))


def column_base(name: Column, suffixes: Sequence[str], strip_prefix: bool) -> Column:
    """Entity part of a key column: all suffix texts removed, then trailing underscores and s."""
    base = F.lower(name)
    if strip_prefix:
        base = F.regexp_replace(base, "^[a-z]{1,2}_", "")
    for suffix in suffixes:
        base = F.replace(base, F.lit(suffix), F.lit(""))
    return F.regexp_replace(F.regexp_replace(base, "_+$", ""), "s+$", "")


def infer_relationships(
    columns_df: DataFrame,
    tables_df: DataFrame,
    explicit_df: DataFrame | None = None,
    suffixes: Sequence[str] = ("_id", "id"),
    strip_prefix: bool = False,
    target_key: str = "id",
) -> DataFrame:
    """Columns such as ``customer_id`` matched to the table ``customers`` by name.

    An equi-join on the connection and the normalised name. The target must own a column called ``target_key``, or,
    for ``target_key="same"``, a column equal to the source column after prefix removal. Pairs
    already declared in ``explicit_df`` are left out.
    """
    ends = F.lit(False)
    for suffix in suffixes:
        ends = ends | F.endswith(F.lower("name"), F.lit(suffix))
    named = columns_df.select("table_id", "column_id", "name").join(
        tables_df.select("table_id", "table_name", connection_of(tables_df).alias("__conn")), "table_id")
    sources = named.filter(ends).select(
        "__conn",
        F.col("table_id").alias("source_table_id"), F.col("column_id").alias("source_column_id"),
        F.col("table_name").alias("source_table"), F.col("name").alias("source_column"),
        column_base(F.col("name"), suffixes, strip_prefix).alias("__base"))
    bare = F.lower("name")
    if strip_prefix:
        bare = F.regexp_replace(bare, "^[a-z]{1,2}_", "")
    targets = named.select(
        "__conn", F.col("table_id").alias("target_table_id"), F.col("column_id").alias("target_column_id"),
        F.col("table_name").alias("target_table"), F.col("name").alias("target_column"),
        bare.alias("__key"), F.regexp_replace(F.lower("table_name"), "s+$", "").alias("__base"))
    if target_key == "same":
        sources = sources.withColumn("__key", F.regexp_replace(F.lower("source_column"), "^[a-z]{1,2}_", ""))
        joined = sources.join(targets, ["__conn", "__base", "__key"])
    else:
        joined = sources.join(targets.filter(F.col("__key") == target_key), ["__conn", "__base"])
    found = _relation(joined.filter(F.col("source_table_id") != F.col("target_table_id")), 0.75, "heuristic_name_match")
    if explicit_df is not None:
        found = found.join(explicit_df.select("source_column_id", "target_table_id"),
                           ["source_column_id", "target_table_id"], "left_anti")
        found = found.join(explicit_df.select("source_column_id", "target_column_id"),
                           ["source_column_id", "target_column_id"], "left_anti")
    return found.select(
        "source_table_id", "source_column_id", "source_table", "source_column",
        "target_table_id", "target_column_id", "target_table", "target_column",
        "relationship_type", "confidence_score", "discovery_method")


def relationship_text(rel_df: DataFrame) -> DataFrame:
    """Adds one sentence per relationship, with a note for low or high confidence."""
    kind = F.replace(F.lower(F.coalesce("relationship_type", F.lit("unknown"))), F.lit("-"), F.lit("_"))
    source, target = entity_label(F.col("source_table")), entity_label(F.col("target_table"))
    join_on = F.format_string("Join on %s = %s.", "source_column", "target_column")

    def is_kind(word, short):
        return F.contains(kind, F.lit(word)) | F.contains(kind, F.lit(short))

    sentence = (
        F.when(is_kind("one_to_many", "1:n"), F.format_string("Each %s can have zero or more %ss. ", source, target))
        .when(is_kind("many_to_one", "n:1"), F.format_string("Each %s belongs to exactly one %s. ", target, source))
        .when(is_kind("many_to_many", "n:n"), F.format_string("Each %s can be related to many %ss, and vice versa. ", source, target))
        .when(is_kind("one_to_one", "1:1"), F.format_string("Each %s maps to exactly one %s. ", source, target))
        .otherwise(F.format_string("There is a relationship between %s and %s. ", source, target))
    )
    confidence = F.col("confidence_score")
    percent = F.format_string("%.0f%%", confidence * 100)
    note = (
        F.when((confidence > 0) & (confidence < 0.80), F.concat(F.lit(" ⚠️ (Low confidence: "), percent, F.lit(")")))
        .when(confidence >= 0.95, F.concat(F.lit(" ✓ (High confidence: "), percent, F.lit(")")))
        .otherwise("")
    )
    return rel_df.withColumn("explanation", F.concat(sentence, join_on, note))


def many_to_many_text(rel_df: DataFrame, junctions: DataFrame | None = None) -> DataFrame:
    """Sentence for every two tables that a junction table points to.

    ``junctions`` (table_name) says which tables are junctions; without it each table with two foreign keys is taken for one. A junction's targets are as many as its foreign keys, so they travel as one short sorted array
    per junction and each is paired with those after it.
    """
    if junctions is not None:
        rel_df = rel_df.join(junctions.select(F.col("table_name").alias("source_table")).distinct(), "source_table", "left_semi")
    ends = rel_df.groupBy("source_table").agg(F.array_sort(F.collect_set("target_table")).alias("ends")).filter(
        F.size("ends") >= 2)
    lefts = ends.select("source_table", "ends", F.posexplode("ends").alias("at", "left_table"))
    pairs = lefts.select(
        "left_table", F.explode(F.slice("ends", F.col("at") + 2, F.size("ends"))).alias("right_table"),
        F.col("source_table").alias("junction_table"))
    return pairs.withColumn("explanation", F.format_string(
        "Each %s can be associated with many %ss, and vice versa, through the %s table.",
        entity_label(F.col("left_table")), entity_label(F.col("right_table")), entity_label(F.col("junction_table"))))


def join_path_text(paths_df: DataFrame, path: str = "path") -> DataFrame:
    """Tells a join path, given as an array of table names."""
    names = F.transform(F.col(path), lambda t: entity_label(t))
    arrows = F.array_join(names, " → ")
    first, last, size = F.get(names, 0), F.get(names, F.size(names) - 1), F.size(F.col(path))
    told = (
        F.when(size < 2, "Join path too short.")
        .when(size == 2, F.concat(F.lit("To join "), first, F.lit(" to "), last, F.lit(", use: "), arrows))
        .otherwise(F.concat(F.lit("To join "), first, F.lit(" to "), last, F.lit(", traverse: "), arrows))
    )
    return paths_df.withColumn("explanation", told)
