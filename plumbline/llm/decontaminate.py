"""Operator 9: benchmark decontamination with column expressions only.

Words are runs of digits, letters a to z (A-Z lowered) and anything beyond ASCII. A window is ten consecutive words of a
benchmark item, or the whole item if it is shorter. The windows' hashes go to every task as one literal set; each document
row tests its own windows against it in place, so no row is made for a window that misses. Hits are then compared word
by word with the benchmark windows, and merged into hit words and matched items.

The set is used up to ``max_windows`` distinct windows, a bound that is counted first. A larger benchmark takes the second
way: window hashes of documents become rows and meet the benchmark in a join.

Defined results: null and blank texts have no words and no hits. Null or blank items have no windows. Repeated items
both match; a null item_id never shows among the items. Every input row gives one result row, repeated rows included. An empty benchmark
leaves every document clean. Input columns other than the id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let, window_hashes

WINDOW = 10
MAX_WINDOWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lowers A-Z and nothing else; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN, -1), "")


def windows_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows with the items that hold them: ``win array<string>, items array<string>``."""
    words = benchmark.select(F.col(item_id).cast("string").alias("item"), normal_words(F.col(text)).alias("ws")).where("size(ws) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - size + 1, F.lit(1)))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("ws", i, size))).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item").alias("items"))


def _spots(words: Column, length: int, hashes: list[int]) -> Column:
    """Positions (from 1) where a window of ``length`` words starts whose hash is in the set."""
    at = F.transform(window_hashes(words, length), lambda h, i: F.when(h.isin(hashes), i + 1))
    return F.transform(F.filter(at, lambda i: i.isNotNull()), lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len")))


def _hash(window: Column, lengths: list[int]) -> Column:
    """Hash of a whole window of any of the ``lengths``."""
    choice = F.lit(None).cast("bigint")
    for n in lengths:
        choice = F.when(F.size(window) == n, window_hashes(window, n)[0]).otherwise(choice)
    return choice


def find_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
              item_text: str = "text", size: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row for each document row: ``doc_id, n_words, hit_words array<int>`` (positions from 1), ``items array<string>``."""
    windows = windows_of(benchmark, item_id, item_text, size)
    lengths = [r["n"] for r in windows.select(F.size("win").alias("n")).distinct().collect()]  # at most ``size`` values
    keyed = windows.select(F.size("win").alias("len"), _hash(F.col("win"), lengths).alias("h"))
    known = keyed.distinct().limit(max_windows + 1).collect()
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), normal_words(F.col(text)).alias("ws"))
    if len(known) <= max_windows:
        by_length: dict[int, list[int]] = {}
        for row in known:
            by_length.setdefault(row["len"], []).append(row["h"])
        scanned = docs.select(
            F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"),
            let(normal_words(F.col(text)), lambda ws: _scan(ws, by_length)).alias("s")).select("rid", "doc_id", "s.*")
        windows = F.broadcast(windows)
    else:
        scanned = _scan_by_join(base, keyed, lengths)
    each = scanned.select("rid", "doc_id", "n_words", "ws", F.explode_outer("spots").alias("spot"))
    each = each.select("rid", "doc_id", "n_words", "spot", F.slice("ws", F.col("spot.pos"), F.col("spot.len")).alias("win"))
    met = each.join(windows, "win", "left")
    covered = F.when(F.col("items").isNotNull(), F.sequence(F.col("spot.pos"), F.col("spot.pos") + F.col("spot.len") - 1))
    whole = met.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                   F.collect_list(covered).alias("covered"), F.collect_list("items").alias("found"))
    return whole.select("doc_id", "n_words", F.array_distinct(F.flatten("covered")).alias("hit_words"),
                        F.array_sort(F.array_distinct(F.flatten("found"))).alias("items"))


def _scan(words: Column, by_length: dict[int, list[int]]) -> Column:
    found = [_spots(words, n, hashes) for n, hashes in sorted(by_length.items())]
    spots = F.concat(*found) if found else F.array().cast("array<struct<pos:int,len:int>>")
    return let(spots, lambda s: F.struct(F.size(words).cast("long").alias("n_words"), s.alias("spots"),
                                         F.when(F.size(s) > 0, words).alias("ws")))


def _scan_by_join(base: DataFrame, keyed: DataFrame, lengths: list[int]) -> DataFrame:
    """The same columns as the set scan, for a benchmark of any size: only hashes and positions are shuffled."""
    keyed = keyed.distinct()
    def windows(n: int) -> Column:
        return F.transform(window_hashes(F.col("ws"), n), lambda h, i: F.struct((i + 1).alias("pos"), F.lit(n).alias("len"), h.alias("h")))

    empty = F.array().cast("array<struct<pos:int,len:int,h:bigint>>")
    rows = base.select("rid", F.explode(F.concat(empty, *map(windows, lengths))).alias("w")).select("rid", "w.*")
    spots = rows.join(keyed, ["len", "h"], "left_semi").groupBy("rid").agg(F.collect_list(F.struct("pos", "len")).alias("spots"))
    joined = base.join(spots, "rid", "left")
    return joined.select("rid", "doc_id", F.size("ws").cast("long").alias("n_words"), F.when(F.col("spots").isNotNull(), F.col("ws")).alias("ws"), "spots")


def remove_documents(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """Documents without a hit. All rows that share the id of a hit document go."""
    bad = find_hits(docs, benchmark, doc_id, **options).where("size(hit_words) > 0").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["__bad"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All documents; hit words go together with the characters between them and the word before. Ids must be unique."""
    hits = find_hits(docs, benchmark, doc_id, text, **options).where("size(hit_words) > 0")
    hits = hits.select(F.col("doc_id").alias("__hit_doc"), F.col("hit_words").alias("__hits"))
    words, gaps = F.regexp_extract_all(F.col(text), F.lit(_lowered(_WORD)), F.lit(0)), F.split(F.col(text), _lowered(_WORD), -1)
    rest = let(words, lambda ws: let(gaps, lambda gs: F.concat(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(ws)), F.col("__hits")), lambda i: F.concat(gs[i - 1], ws[i - 1])), ""),
        gs[F.size(ws)])))
    joined = docs.join(hits, docs[doc_id].eqNullSafe(hits["__hit_doc"]), "left")
    changed = F.when(F.col("__hits").isNotNull(), rest).otherwise(F.col(text))
    return joined.select(*[changed.alias(c) if c == text else docs[c] for c in docs.columns])


def _lowered(pattern: str) -> str:
    """The word pattern for texts whose A-Z are not lowered yet."""
    return pattern.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
