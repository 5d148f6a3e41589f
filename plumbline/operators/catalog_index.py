"""A stored trigram index over the names and descriptions of a catalog.

A search term of three characters or more is contained in a text only if all its trigrams are. The index lists, for each trigram, the entries
that hold it, in files sorted by trigram: a search reads the row groups of a few trigrams, intersects their lists, and looks at the texts of the
entries that are left. Shorter terms say too little for that; they look at every entry.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.search import match_score, relevance
from plumbline.session import work_path

GRAM = 3
#: Entries whose numbers share this quotient lie in one list, so a list has a bound however common its trigram.
CHUNK = 65_536
#: Characters whose trigrams are sorted together; a list of very long texts comes in parts.
PART_CHARS = 4_000_000


def _grams(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and owner of each stretch of three characters; a number is the three code points, put together."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    place = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    whole = np.flatnonzero(place[2:] == place[:-2])
    return codes[whole] << 42 | codes[whole + 1] << 21 | codes[whole + 2], owner[place[whole]]


def _listed(size: int):
    """Turns (entry, name, description), lowered, into the lists of their trigrams; ``size`` bounds a list."""

    def lists(held: list[tuple[np.ndarray, list[str], list[str]]], chunk: int) -> pa.RecordBatch:
        entries = np.concatenate([e for e, _, _ in held])
        owner = np.arange(len(entries))
        names, abouts = ([t for part in held for t in part[i]] for i in (1, 2))
        gram, row = map(np.concatenate, zip(_grams(names, owner), _grams(abouts, owner)))
        order = np.lexsort((row, gram))
        gram, row = gram[order], row[order]
        new = np.append(True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])) if len(gram) else np.zeros(0, dtype=bool)
        gram, row = gram[new], row[new]
        starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, dtype=np.int64)
        found = gram[starts]
        text = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
        offsets = pa.array(np.append(starts, len(gram)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([text[i : i + GRAM] for i in range(0, len(text), GRAM)], pa.string()), pa.array(np.full(len(found), chunk), pa.int64()),
             pa.ListArray.from_arrays(offsets, pa.array(entries[row], pa.int64()))], names=["gram", "chunk", "entries"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars, at = [], 0, -1
        for batch in filter(len, batches):
            numbers, names, abouts = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            lengths = np.fromiter((len(n) + len(d) for n, d in zip(names, abouts)), dtype=np.int64, count=len(names))
            chunks, parts = numbers // size, np.cumsum(lengths) // PART_CHARS
            cuts = [0, *(np.flatnonzero((chunks[1:] != chunks[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and (chars > PART_CHARS or chunks[lo] != at):
                    yield lists(held, at)
                    held, chars = [], 0
                held.append((numbers[lo:hi], names[lo:hi], abouts[lo:hi]))
                chars, at = chars + int(lengths[lo:hi].sum()), int(chunks[lo])
        if held:
            yield lists(held, at)

    return read


class CatalogIndex:
    """Entries (tables and columns) and the lists of their trigrams, below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def build(tables_df: DataFrame, columns_df: DataFrame, path: str | None = None) -> CatalogIndex:
        """Stores the index of a catalog and opens it."""
        spark = tables_df.sparkSession
        index = CatalogIndex(spark, path or work_path(spark, "catalog-index"))
        none = F.lit(None).cast("string")

        def given(df: DataFrame, name: str) -> Column:
            return F.col(name).alias(name) if name in df.columns else none.alias(name)

        tables = tables_df.select(
            F.lit("table").alias("kind"), F.col("table_id").alias("id"), "table_id", F.col("table_name").alias("name"), "table_name", given(tables_df, "schema_name"),
            given(tables_df, "connection_id"), given(tables_df, "workspace_id"), none.alias("data_type"), none.alias("pii_tag"), given(tables_df, "description"), F.col("created_at"))
        own = columns_df.select("column_id", "table_id", "name", given(columns_df, "data_type"), given(columns_df, "pii_tag"), given(columns_df, "description"))
        parents = tables.select("table_id", "table_name", "schema_name", "connection_id", "workspace_id", "created_at")
        columns = own.join(parents, "table_id").select(
            F.lit("column").alias("kind"), F.col("column_id").alias("id"), "table_id", "name", "table_name", "schema_name", "connection_id", "workspace_id", "data_type", "pii_tag",
            "description", "created_at")
        # numbers follow the order of the stored files, so the entries of a list are near each other
        tables.unionByName(columns).withColumn("entry", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{index.path}/entries")
        entries = spark.read.parquet(f"{index.path}/entries")
        lowered = entries.select("entry", *[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("name", "description")])
        # the entries of a list come from one task, which makes the list without a shuffle; each task writes files sorted by trigram
        lists = lowered.mapInArrow(_listed(CHUNK), "gram string, chunk long, entries array<long>")
        lists.sortWithinPartitions("gram", "chunk").write.mode("overwrite").parquet(f"{index.path}/lists")
        return index

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/entries")

    def candidates(self, terms: Sequence[str]) -> DataFrame:
        """Entries with all trigrams of some term in their name and description together; every entry if a term is too short to tell."""
        low = sorted({t.lower() for t in terms})
        if any(len(t) < GRAM for t in low):
            return self.entries()
        wanted = [(t, t[i : i + GRAM]) for t in low for i in range(len(t) - GRAM + 1)]
        grams = sorted({g for _, g in wanted})
        asked = self.spark.createDataFrame(sorted(set(wanted)), "term string, gram string")
        needed = asked.groupBy("term").agg(F.count("*").alias("needed"))
        lists = self.spark.read.parquet(f"{self.path}/lists").where(F.col("gram").isin(grams))
        held = lists.join(F.broadcast(asked), "gram").select("term", F.explode("entries").alias("entry")).groupBy("term", "entry").agg(F.count("*").alias("held"))
        hits = held.join(F.broadcast(needed), "term").where("held = needed").select("entry").distinct()
        return self.entries().join(hits, "entry", "left_semi")

    def search(self, query: str, connection_id: str | None = None) -> DataFrame:
        """:func:`plumbline.operators.search.metadata_search` over the index."""
        wanted = query.lower()
        held = F.contains(F.lower("name"), F.lit(wanted)) | F.coalesce(F.contains(F.lower("description"), F.lit(wanted)), F.lit(False))
        found = self.candidates([wanted]).where(held)
        found = found if connection_id is None else found.where(F.col("connection_id") == connection_id)
        return found.select("kind", "id", "name", "table_name", "schema_name", "data_type", "pii_tag", match_score(F.col("name"), query).alias("score")).orderBy(
            F.desc("kind"), F.desc("score"), "name", "id")

    def relevant(self, terms: Sequence[str], workspace_id: str | None = None) -> DataFrame:
        """(resource_type, id, name, relevance_score, updated) of the tables and columns that some term fits; columns by their name alone."""
        found = self.candidates(terms)
        if workspace_id is not None:
            found = found.where((F.col("kind") == "column") | (F.col("workspace_id") == workspace_id))
        about = F.when(F.col("kind") == "table", F.col("description")).otherwise(F.col("name"))
        shown = F.when(F.col("kind") == "table", F.col("name")).otherwise(F.concat_ws(".", "table_name", "name"))
        # scored before the select that gives "name" another meaning, which a lambda would take
        scored = found.withColumn("relevance_score", relevance(terms, F.col("name"), about)).where("relevance_score > 0")
        return scored.select(F.col("kind").alias("resource_type"), "id", shown.alias("name"), "relevance_score", F.col("created_at").alias("updated"))
