"""Operator 1: line-first cleaning with column expressions only.

Each line is held against punctuation, navigation and boilerplate rules; failing lines go, and a document that loses too much of
its text is rejected. Text-wide counts (words, symbols, repeated lines, repeated 8-word windows) stand beside the verdict.

Everything is computed inside the document's row: no row is made for a line or a window, and nothing is shuffled. Repeated
windows are found by hash first; only documents with an equal hash sort their windows, as text, so the count is exact.

Defined results: null, empty and blank texts have no words, all counts 0, no kept lines and fail. Every input row gives one
result row. Long texts cost n log n in their own words. Columns of the result replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let, window_hashes, without, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document is rejected when the lines that fail hold more than this share of its words.
MAX_LOST_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"
#: Characters that the noise and navigation rules and the symbol count look for.
ANY_MARK = r"[#*$%&|<>»›•·!]"
#: Phrases of page furniture, in lower case.
BOILERPLATE = ("all rights reserved|cookie policy|privacy policy|terms of use|terms of service|lorem ipsum|click here|sign in|sign up|log in|"
               "subscribe to|newsletter|enable javascript|use of cookies|skip to content|back to top|share this")
SENTENCE_END = r"[.!?:;…。！？][\"'»”’)\]\s]*$"
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_kept_lines", "n_lost_words", "clean_text", "kept"]


def clean_documents(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
                    max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """The input with counts, the text of its passing lines (``clean_text``) and the verdict ``kept``."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    marked = F.coalesce(F.col(text).rlike(ANY_MARK), F.lit(False))
    judged = let(marked, lambda m: F.transform(F.filter(lines, _has_word), lambda line: F.struct(line.alias("line"), line_verdict(line, m).alias("v"))))
    facts = let(words_of(F.col(text)), lambda ws: let(judged, lambda ls: let(F.filter(ls, lambda x: x["v"]["passes"])["line"], lambda good: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        repeated_words(ws).alias("n_repeat_words"),
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls["line"]))).cast("long").alias("n_dup_lines"),
        F.size(good).cast("long").alias("n_kept_lines"),
        F.aggregate(ls, F.lit(0), lambda n, x: n + F.when(x["v"]["passes"], 0).otherwise(x["v"]["n"])).cast("long").alias("n_lost_words"),
        F.array_join(good, "\n").alias("clean_text")))))
    kept = without(docs, *RESULT, "__facts")
    symbols = F.when(marked, F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).otherwise(F.lit(0)).cast("long")
    full = kept.withColumn("n_symbols", symbols).withColumn("__facts", facts).select(*[f"`{c}`" for c in kept.columns], "n_symbols", "__facts.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    lost = 100 * F.col("n_lost_words") > max_lost_percent * F.col("n_words")
    full = full.withColumn("base_failed", failed)
    return full.withColumn("kept", ~F.col("base_failed") & ~lost)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_verdict(line: Column, marked: Column) -> Column:
    """Words of a line, and whether no rule fails. ``marked``: the text has a character of :data:`ANY_MARK` at all."""
    return let(words_of(line), lambda ws: F.struct(
        F.size(ws).alias("n"),
        (~((marked & (noisy(line, ws) | navigation(line, ws))) | unpunctuated(line, ws) | one_word_over_and_over(ws) | furniture(line, ws))).alias("passes")))


def furniture(line: Column, words: Column) -> Column:
    """Boilerplate rule: a phrase of page furniture in a line of at most 25 words."""
    return (F.size(words) <= 25) & F.lower(line).rlike(BOILERPLATE)


def noisy(line: Column, words: Column) -> Column:
    """Punctuation rule: symbols on a third of the words, or shouting (half of the words end in exclamation marks)."""
    symbols = F.length(line) - F.length(F.regexp_replace(line, r"[#*$%&<>]", ""))
    shouts = F.length(line) - F.length(F.replace(line, F.lit("!"), F.lit("")))
    return (3 * symbols > F.size(words)) | (shouts > F.size(words))


def navigation(line: Column, words: Column) -> Column:
    """Navigation rule: three or more separators of menu entries, one for at most four words."""
    bars = F.length(line) - F.length(F.regexp_replace(line, "[|»›•·]", ""))
    return (bars >= 3) & (4 * bars >= F.size(words) - bars)


def unpunctuated(line: Column, words: Column) -> Column:
    """Punctuation rule: a long line without any sentence end, comma or other mark within or after it."""
    return (F.size(words) >= 30) & ~F.right(line, F.lit(4)).rlike(SENTENCE_END) & ~line.rlike(r"[.,;:!?…。，！？]")


def one_word_over_and_over(words: Column) -> Column:
    """Boilerplate rule: a line of ten words or more with fewer than a quarter of them distinct."""
    return (F.size(words) >= 10) & (4 * F.size(F.array_distinct(words)) < F.size(words))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of consecutive words that occur twice or more in the text, the first occurrence included."""
    last = F.size(words) - window + 1
    starts = F.sequence(F.lit(1), last)
    suspicious = let(window_hashes(words, window), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    as_text = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, window), " ").alias("win"), i.alias("at"))))
    twice = let(as_text, lambda s: F.array_sort(F.filter(F.transform(s, lambda x, i: F.when(
        ((i > 0) & (F.get(s, i - 1)["win"] == x["win"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["win"] == x["win"])), x["at"])), lambda at: at.isNotNull())))
    # each window adds the words up to the next window's start
    added = let(twice, lambda t: F.aggregate(F.transform(t, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(t, i + 1) - at, F.lit(window)))),
                                             F.lit(0), lambda total, n: total + n))
    return F.when(last < 2, F.lit(0)).when(suspicious, added).otherwise(F.lit(0)).cast("long")
