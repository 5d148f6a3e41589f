"""Cleaning of a corpus in five stages; each stage is one Parquet table in the shared folder.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
``documents``. Null texts are no language and go in the first stage; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, language_id, ngram_jaccard, secrets, sentencepiece_codec
from plumbline.llm.common import fold
from plumbline.llm.queries import piece_model
from plumbline.session import work_path
from plumbline.sources.tables import load


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts whose language stays open (score below 0.3)."""
    model = language_id.train(docs.where(fold("doc_id", 4) != 2))
    scored = language_id.predict(docs, model)
    return scored.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= 0.3)).select(docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group whose 5-word shingles link at a Jaccard of 0.8 or more."""
    return ngram_jaccard.keep_one(docs, size=5, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.remove_documents(docs, load(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret; ``n_chars`` follows the text."""
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text again."""
    back = sentencepiece_codec.encode_and_decode(docs, piece_model())
    return back.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", decontaminate_benchmark),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Trained models stand between the stages; a small fixture is compared with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = work_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
