"""Registered queries of the operators: each derives the agreed columns from what its operator returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import block_names, brown_lm, conversation_trie, decontaminate, fill_in_middle, language_id, licenses, ngram_jaccard, quality_model, quality_rules, secrets, sentencepiece_codec, toxicity
from plumbline.llm.common import fold
from plumbline.sources.tables import load


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return quality_rules.clean_documents(docs).drop("text", "clean_text")


def piece_model() -> str:
    """The public 32,000-piece model; an installed package, so every executor has it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    both = sentencepiece_codec.encode_and_decode(load(spark, sf, "documents").select("doc_id", "text"), piece_model())
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    spans = secrets.scan(docs, secrets.train(docs)).select("doc_id", "spans")

    def joined(kinds: list[str]):
        own = F.filter("spans", lambda s: s["kind"].isin(kinds))
        return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *map(count, secrets.KINDS), F.sha2(joined(secrets.KINDS[:3]), 256).alias("base_sha256"), joined(secrets.KINDS).alias("spans"))


def op4_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    model = quality_model.train(docs, load(spark, sf, "labels").where(fold("doc_id", 5) != 0))
    return quality_model.predict(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    found = licenses.scan(docs, licenses.train(docs))
    return found.select("doc_id", F.size("paragraphs").cast("long").alias("n_paragraphs"),
                        F.array_join(F.array_sort(F.array_distinct(F.transform("paragraphs", lambda p: p["family"]))), ",").alias("families"), "paragraphs")


def op6_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_jaccard.connect(load(spark, sf, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.train(docs, load(spark, sf, "labels").where(fold("doc_id", 5) != 0))
    return toxicity.predict(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence")


def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(fold("doc_id", 4) != 2))
    return language_id.predict(docs.drop("lang"), model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    hits = decontaminate.find_hits(load(spark, sf, "documents"), load(spark, sf, "benchmark"))
    return hits.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


def op10_language_model(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    learn = fold("doc_id", 7) != 2
    counts = brown_lm.stored_counts(docs, learn)
    encoded = brown_lm.encode(docs, brown_lm.frequent(counts), learn, "doc_id")
    model = brown_lm.train(docs, counts, learn, encoded=encoded)
    return brown_lm.score(docs, counts, model, encoded=encoded).withColumn("held_out", fold("doc_id", 7) == 2)


def op11_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    nodes, ends = conversation_trie.build(load(spark, sf, "conversations"))
    hashed = nodes.join(conversation_trie.hash_ends(ends), "key", "left")
    return hashed.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(conversation_trie.NO_ENDS))).drop("key")


def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    made = fill_in_middle.transform(load(spark, sf, "documents").select("doc_id", "text"), check=True)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim_text", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return block_names.find_copies(load(spark, sf, "documents"), carry=["doc_id"])


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_sentencepiece, op3_secret_scan, op4_quality_classifier, op5_license_scan, op6_ngram_jaccard, op7_toxicity, op8_language_id, op9_decontamination, op10_language_model,
                                 op11_conversation_trie, op12_fill_in_middle, op13_exact_dedup)}
