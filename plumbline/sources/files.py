"""CSV and NDJSON files, and file inventories."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENSIONS = ("csv", "xls", "xlsx")


def view_name(path: str) -> str:
    """File name up to the first dot, blanks and dashes as underscores."""
    return os.path.basename(path.rstrip("/")).split(".")[0].replace(" ", "_").replace("-", "_")


def read_csv(spark: SparkSession, path: str, view: str | None = None, schema: T.StructType | str | None = None,
             sampling_ratio: float = 1.0, delimiter: str = ",", multi_line: bool | None = None) -> DataFrame:
    """CSV with a header as a named view; doubled quotes and line breaks inside quotes belong to the value.

    Files whose lines hold quotes in pairs only are split and read in parallel. A line with an odd number of quotes may go on in the next one;
    such files can't be split. A first pass over the lines tells, which ends at the first such line; ``multi_line`` says it instead.
    Without ``schema`` the types are inferred, which reads the files once more; ``sampling_ratio``
    shortens that pass.
    """
    if multi_line is None:
        multi_line = has_open_quotes(spark, path)
    reader = spark.read.options(header=True, sep=delimiter, quote='"', escape='"', multiLine=multi_line)
    if schema is not None:
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", True).option("samplingRatio", sampling_ratio).csv(path)
    df.createOrReplaceTempView(view or view_name(path))
    return df


def has_open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line of text files holds an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def file_inventory(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, view_name, extension, size_bytes, modified_at) of the readable table files below a folder.

    Only file metadata is read: the content column is pruned.
    """
    either_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    pattern = "*.{" + ",".join(either_case) + "}"
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    )
    base = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path",
        F.regexp_replace(F.substring_index(base, ".", 1), r"[ -]", "_").alias("view_name"),
        F.lower(F.substring_index(base, ".", -1)).alias("extension"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


def file_check(spark: SparkSession, path: str) -> DataFrame:
    """One row: success, message, size_bytes. Never raises for a missing or unsupported file."""
    schema = "success boolean, message string, size_bytes long"
    if not path.lower().endswith(tuple("." + e for e in EXTENSIONS)):
        return spark.createDataFrame([(False, "Unsupported file extension. Supported: .csv, .xlsx, .xls", None)], schema)
    try:
        found = spark.read.format("binaryFile").load(path).agg(F.count(F.lit(1)), F.sum("length")).first()
    except AnalysisException:
        return spark.createDataFrame([(False, f"File not found at path: {path}", None)], schema)
    return spark.createDataFrame([(True, "File successfully verified and accessible", found[1])], schema)


def as_json_ready(df: DataFrame) -> DataFrame:
    """Dates, timestamps and decimals as text, everything else native."""
    def shown(f: T.StructField):
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
            micros = F.date_format(col, "SSSSSS")
            return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros)).alias(f.name)
        if isinstance(f.dataType, (T.DateType, T.DecimalType)):
            return col.cast("string").alias(f.name)
        return col

    return df.select(*[shown(f) for f in df.schema.fields])


def write_ndjson(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Newline-delimited JSON, one object per row, NULL fields kept; written in parallel."""
    writer = as_json_ready(df).write.mode("overwrite").option("ignoreNullFields", False)
    (writer.option("compression", compression) if compression else writer).json(path)
