"""Operator 8: language identification by words first, then by shorter and shorter character n-grams.

A word that the model knows scores by its log frequency in each language. An unseen word backs off: its
n-grams of the longest size that has any known one give the mean log frequency of that size. Training counts cover
all given documents. The most frequent words travel as a broadcast; every other word stays in a stored table and is joined. The n-grams
are bounded, and each language and size has its share of them. Languages are those of all training rows that hold a word.

Defined results: null texts and texts without a letter are ``und`` with score 0. Ties go to the first language in
alphabetical order. Rows are never merged, so repeated rows get equal results. Without training rows everything is
``und``. Columns of the result replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import in_parts, without
from plumbline.session import work_path

LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Distinct words that one task holds before it hands its counts on.
FLUSH_WORDS = 200_000
#: Scores behave as if a text had at most so many words, which keeps them off 0 and 1.
EVIDENCE_WORDS = 20
CACHED_CELLS = 1_200_000
PART_CHARS = 2_000_000


@dataclass
class LanguageModel:
    """``words`` maps a word to its row of log frequencies, one column for each of ``langs``; ``grams`` holds, for each
    size, sorted n-gram numbers over ``alphabet`` and their rows."""

    langs: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    alphabet: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    max_gram: int
    #: Where the table of the words outside ``words`` lies; empty if there are none.
    others: str = ""

    def scores_of(self, words: list[str]) -> np.ndarray:
        """One row of log frequencies for each word."""
        out = np.zeros((len(words), len(self.langs)))
        known = np.fromiter((self.words.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        out[known >= 0] = self.word_scores[known[known >= 0]]
        left = np.flatnonzero(known < 0)
        for size in range(self.max_gram, 0, -1):
            if not len(left) or size not in self.grams:
                continue
            keys, scores = self.grams[size]
            owner, _, key = _gram_keys([words[i] for i in left], size, self.alphabet)
            at = np.searchsorted(keys, key).clip(max=len(keys) - 1)
            hit = keys[at] == key
            n = np.bincount(owner[hit], minlength=len(left))
            sums = np.stack([np.bincount(owner[hit], scores[at[hit], j], minlength=len(left)) for j in range(len(self.langs))], axis=1)
            done = n > 0
            out[left[done]] = sums[done] / n[done, None]
            left = left[~done]
        return out


def _gram_keys(words: list[str], size: int, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each n-gram: the word it stands in, where it starts in the joined words, and a number for its characters.

    Characters outside the alphabet count as 0, a digit that no kept n-gram has.
    """
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    at = np.searchsorted(alphabet, codes).clip(max=len(alphabet) - 1)
    digits = np.where(alphabet[at] == codes, at + 1, 0).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :]) if len(owner) >= size else np.zeros(0, dtype=np.int64)
    key = np.zeros(len(starts), dtype=np.int64)
    for i in range(size):
        key = key * (len(alphabet) + 1) + digits[starts + i]
    return owner[starts], starts, key


def train(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 50_000, max_grams: int = 60_000, max_gram: int = 4) -> LanguageModel:
    """Counts words and n-grams of all rows with a language. The ``max_words`` most frequent words and ``max_grams`` n-grams, dealt evenly to
    languages and sizes, are for the broadcast; all other words stay in a table that :func:`predict` joins."""
    schema = "is_word boolean, key string, lang string, n long"

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for value, language in zip(batch["text"], batch["lang"]):
                counts[language].update(LETTERS.findall(value.lower()))
            if sum(map(len, counts.values())) > FLUSH_WORDS:
                yield from _rows(counts, max_gram)
                counts.clear()
        yield from _rows(counts, max_gram)

    spark = docs.sparkSession
    given = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sums = given.mapInPandas(counted, schema).groupBy("is_word", "key", "lang").agg(F.sum("n").alias("n"))
    path = work_path(spark, "languages")
    sums.groupBy("is_word", "key").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("counts")).write.parquet(f"{path}/counts")
    by_key = spark.read.parquet(f"{path}/counts")
    all_words, all_grams = by_key.where("is_word"), by_key.where("not is_word")
    totals = {r["lang"]: r["n"] for r in all_words.select(F.inline("counts")).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs, types = sorted(totals), all_words.count()
    words = all_words.orderBy(F.col("total").desc(), F.col("key")).limit(max_words).collect()
    grams = all_grams.where(_dealt(all_grams, max_grams)).collect() if langs else []
    alphabet = np.unique(np.array([ord(c) for r in grams for c in r["key"]], dtype=np.uint32))
    by_size = {}
    for size in range(1, max_gram + 1):
        if own := [r for r in grams if len(r["key"]) == size]:
            keys = _gram_keys([r["key"] for r in own], size, alphabet)[2]
            order = np.argsort(keys)
            by_size[size] = keys[order], _log_frequencies(own, langs)[order]
    mass = np.array([totals[x] for x in langs], dtype=np.float64) + 0.5 * types
    scores = np.log(_counts(words, langs) + 0.5) - np.log(mass)
    model = LanguageModel(langs, {r["key"]: i for i, r in enumerate(words)}, scores, alphabet, by_size, max_gram)
    if types > len(words):
        _other_words(all_words, model, mass).write.parquet(f"{path}/others")
        model.others = f"{path}/others"
    return model


def _dealt(grams: DataFrame, most: int) -> Column:
    """Which rows to keep, at most ``most``: each size of each language has an equal share of n-grams, and what some leave goes to the rest.

    Within a share the frequent come first, in quarters of an octave; a hash splits equally frequent ones.
    """
    size, level = F.char_length("key"), F.floor(F.log2(F.col("n")) * 4) * 16 + F.pmod(F.xxhash64("key"), F.lit(16))
    found = grams.select("key", F.inline("counts")).groupBy("lang", size.alias("size"), level.alias("level")).agg(F.count("*").alias("n")).collect()
    held = defaultdict(dict)
    for row in found:
        held[row["lang"], row["size"]][row["level"]] = row["n"]
    cut, left = {}, most
    for i, group in enumerate(sorted(held, key=lambda g: (sum(held[g].values()), g))):
        share, taken = left // (len(held) - i), 0
        for at in sorted(held[group], reverse=True):
            if taken + held[group][at] > share:
                break
            taken += held[group][at]
            cut[group] = at
        left -= taken
    marks = [F.lit(x) for (lang, n), at in cut.items() for x in (f"{n} {lang}", int(at))]
    if not marks:
        return F.lit(False)
    cuts = F.create_map(*marks)
    of = lambda c: F.floor(F.log2(c["n"]) * 4) * 16 + F.pmod(F.xxhash64("key"), F.lit(16))
    return F.exists("counts", lambda c: F.coalesce(of(c) >= F.try_element_at(cuts, F.concat_ws(" ", size.cast("string"), c["lang"])), F.lit(False)))


def _other_words(words: DataFrame, model: LanguageModel, mass: np.ndarray) -> DataFrame:
    """``word, more``: for each word outside the broadcast, its log frequencies less what its n-grams give."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            batch = batch[[w not in model.words for w in batch["key"]]]
            held = batch["key"].tolist()
            if held:
                rows = [{"counts": c} for c in batch["counts"]]
                more = np.log(_counts(rows, model.langs) + 0.5) - np.log(mass) - model.scores_of(held)
                yield pd.DataFrame({"word": held, "more": list(more.astype(np.float32))})

    return words.select("key", "counts").mapInPandas(compared, "word string, more array<float>")


def _rows(counts: dict[str, Counter], max_gram: int) -> Iterator[pd.DataFrame]:
    for language, words in counts.items():
        held = [w for w in words]
        n = np.fromiter(words.values(), dtype=np.int64, count=len(held))
        yield pd.DataFrame({"is_word": True, "key": held, "lang": language, "n": n})
        joined = "".join(held)
        alphabet = np.unique(np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32))
        for size in range(1, max_gram + 1) if held else ():
            owner, starts, key = _gram_keys(held, size, alphabet)
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            sums = np.bincount(which, n[owner], minlength=len(first)).astype(np.int64)
            yield pd.DataFrame({"is_word": False, "key": [joined[i : i + size] for i in starts[first].tolist()], "lang": language, "n": sums})


def _counts(rows: list, langs: list[str]) -> np.ndarray:
    at = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((len(rows), len(langs)))
    for i, row in enumerate(rows):
        for cell in row["counts"]:
            if (j := at.get(cell["lang"])) is not None:
                counts[i, j] = cell["n"]
    return counts


def _log_frequencies(rows: list, langs: list[str]) -> np.ndarray:
    """With half a count added."""
    counts = _counts(rows, langs)
    return np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(rows)))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The input with ``lang_pred`` and ``score``. The bounded part of the model is broadcast; words outside it meet the stored table in a join."""
    kept = without(docs, "lang_pred", "score", "__row", "__md5", "__rid")
    columns = [F.col(f"`{c}`") for c in kept.columns]
    if not model.langs:
        return kept.select(*columns, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cells = max(60_000, CACHED_CELLS // len(model.langs))
        rows, table = {}, np.zeros((cells, len(model.langs)), dtype=np.float32)
        for batch in batches:
            at = 0
            for part in in_parts(batch.column("text").to_pylist(), PART_CHARS):
                found = [LETTERS.findall(v.lower()) if v is not None and any(map(str.isalpha, v)) else None for v in part]
                new = [w for w in set(chain.from_iterable(f for f in found if f)) if w not in rows]
                if len(rows) + len(new) > len(table):
                    rows.clear()
                    new = list(set(chain.from_iterable(f for f in found if f)))
                if len(new) > len(table):
                    table = np.zeros((len(new), len(model.langs)), dtype=np.float32)
                table[len(rows) : len(rows) + len(new)] = model.scores_of(new)
                rows.update(zip(new, range(len(rows), len(rows) + len(new))))
                whole, others, owner = [], [], []
                for i, words in enumerate(found):
                    whole.append(table[[rows[w] for w in words]].sum(axis=0, dtype=np.float64).tolist() if words else [0.0] * len(model.langs))
                    if words and model.others:
                        own = [(w, n) for w, n in Counter(words).items() if w not in model.words]
                        others += own
                        owner += [i] * len(own)
                ids = batch.column("__rid").take(pa.array([*range(at, at + len(part)), *(at + i for i in owner)], pa.int64()))
                # a document's own row has a word of its own, so those rows spread over the join
                word = pa.array([*(f" {i}" for i in ids.slice(0, len(part)).to_pylist()), *(w for w, _ in others)], pa.string())
                none = [None] * len(others)
                marks = [pa.concat_arrays([batch.column(c).slice(at, len(part)), pa.array(none, kind)]) for c, kind in (("__row", pa.int64()), ("__md5", pa.binary()))]
                yield pa.RecordBatch.from_arrays([
                    ids, *marks, word, pa.array([*[0] * len(part), *(n for _, n in others)], pa.int64()), pa.array([*(-1 if f is None else len(f) for f in found), *none], pa.int64()),
                    pa.array([*whole, *none], pa.list_(pa.float64()))], names=["__rid", "__row", "__md5", "word", "times", "n_words", "sums"])
                at += len(part)

    # equal texts differ in other columns; rows equal in all of them share one result
    marked = kept.select(*columns, F.xxhash64(*columns).alias("__row"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("__md5"))
    given = marked.select(F.monotonically_increasing_id().alias("__rid"), "__row", "__md5", F.col(text).alias("text"))
    rows = given.mapInArrow(read, "__rid long, __row long, __md5 binary, word string, times long, n_words long, sums array<double>")
    if model.others:
        rows = rows.join(docs.sparkSession.read.parquet(model.others), "word", "left")
    else:
        rows = rows.withColumn("more", F.lit(None).cast("array<double>"))
    zero = F.lit(0.0)
    parts = [F.sum(F.coalesce(F.col("sums")[j], zero) + F.coalesce(F.col("times") * F.col("more")[j], zero)).alias(f"s{j}") for j in range(len(model.langs))]
    summed = rows.groupBy("__rid").agg(F.max("__row").alias("__row"), F.max("__md5").alias("__md5"), F.max("n_words").alias("n_words"), *parts)
    n = F.greatest(F.col("n_words"), F.lit(1))
    odds = F.array(*[F.col(f"s{j}") / n * F.least(n, F.lit(EVIDENCE_WORDS)) for j in range(len(model.langs))])
    best = F.element_at(F.array(*[F.lit(x) for x in model.langs]), F.array_position("odds", F.array_max("odds")).cast("int"))
    share = 1 / F.aggregate("odds", zero, lambda total, x: total + F.exp(x - F.array_max("odds")))
    named = summed.select("__row", "__md5", "n_words", odds.alias("odds")).select(
        "__row", "__md5", F.when(F.col("n_words") < 0, F.lit(UNDETERMINED)).otherwise(best).alias("lang_pred"), F.when(F.col("n_words") < 0, zero).otherwise(share).alias("score"))
    named = named.groupBy("__row", "__md5").agg(F.max("lang_pred").alias("lang_pred"), F.max("score").alias("score"))
    return marked.join(named, ["__row", "__md5"], "left").select(*columns, "lang_pred", "score")
