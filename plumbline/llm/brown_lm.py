"""Operator 10: language-model scores from Brown classes.

Tasks count their words and Spark sums the counts into one table of the whole vocabulary. Texts become stored lists of word numbers, which the
further passes read. Exchange clustering makes the classes: the ``max_items`` most frequent words and the text end are items of their own, and
the other words start together by their shape; items move between classes while the likelihood of the class bigrams grows. Then every
other word of the vocabulary gets a class of its own: Spark brings the classes to the left and right of all its places together, and it joins
the class that makes them likeliest. Class bigrams are counted anew under the classes of all words. Texts are scored by class transition
times the share of the class that the word has; only words never seen in training go by their shape.

Counts and classes of frequent words travel as a broadcast of fixed size (``max_broadcast`` words); the other words of a text meet the
stored tables of counts and classes in a join, and only those move. A unigram baseline with one count added comes along.

Defined results: null is the empty text, which scores its end alone. Without training rows every count is 0. Words never seen count 0.
Every input row gives one result row, repeated rows included; a null id belongs to fold 0. Texts of any length are read whole. The input's
other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import in_parts
from plumbline.session import remove, work_path

#: Stands for the text end; no word holds a space.
END = " "
FLUSH_WORDS = 200_000
PART_CHARS = 2_000_000
PART_IDS = 1_000_000
MAX_ITEMS = 1_000
MAX_BROADCAST = 150_000
CLASSES = 48
#: Groups of numbered words whose contexts travel as one row.
BUCKETS = 1_000


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z lowered, without the end. Only space, tab and the line breaks up to 0x0D separate bytes."""
    return text.lower().split() if text else []


def _bytes(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


def shape(word: str) -> int:
    """What a word looks like: its last letter's code and its length, folded to 64. Words start by it, and those never seen in training stay there."""
    core = word.rstrip(".,;:!?\"')")
    tail = 0 if core == word else 1
    return (ord(core[-1]) % 8 if core else 0) * 8 + tail * 4 + min(3, len(core) // 5)


SHAPES = 64
TEXT = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("learn", pa.bool_()), ("ids", pa.list_(pa.int32())), ("rare", pa.list_(pa.string()))])
SUMS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("class_logs", pa.float64())])
RARE = pa.schema([("rid", pa.int64()), ("learn", pa.bool_()), ("pos", pa.int64()), ("word", pa.string()), ("before", pa.int32()), ("after", pa.int32()), ("unseen", pa.int32())])


@dataclass
class BrownModel:
    """Classes of all words. Logs are to base ten.

    ``count`` maps frequent words to their counts; a word's number is its place there. Shapes follow, then the end. ``of`` gives the class of
    each of these numbers. ``placed`` is the stored table (word, class, n) of the words that are not in ``count``. Emission is that of items: the
    first ``n_items`` words, the other words of each class as one, the end; ``classes`` are their classes. ``within`` is what
    the other words of a class share.
    """

    count: dict[str, int]
    n_items: int
    of: np.ndarray
    placed: DataFrame
    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    within: np.ndarray
    train_tokens: int
    train_types: int
    end_count: int
    #: What training was given as ``encoded``, and the places of words without a number in these texts.
    encoded: Encoded | None = None
    rare: DataFrame | None = None


def count_words(docs: DataFrame, learn: Column, text: str = "text") -> DataFrame:
    """``word, n`` over rows where ``learn`` holds; the end counts once a text."""

    def held(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in _bytes(batch.column("text")):
                counts.update(tokens(value))
            if batch.num_rows:
                counts[END.encode()] += batch.num_rows
            if len(counts) > FLUSH_WORDS:
                yield held(counts)
                counts.clear()
        if counts:
            yield held(counts)

    given = docs.where(learn).select(F.col(text).alias("text"))
    return given.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, counts: DataFrame, learn: Column, text: str = "text", max_items: int = MAX_ITEMS, max_broadcast: int = MAX_BROADCAST,
          classes: int = CLASSES, encoded: Encoded | None = None) -> BrownModel:
    """``counts`` is the stored result of :func:`count_words` over the same rows; ``encoded`` that of :func:`encode` over all ``docs``, if it is there already."""
    spark = docs.sparkSession
    source = encoded or encode(docs.where(learn), frequent(counts, max_broadcast), text=text)
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("types"), F.max(F.when(F.col("word") == END, F.col("n"))).alias("end")).first()
    count, texts = source.count, source.texts.where("learn")
    n_known, n_items = len(count), min(max_items, len(count))
    # the frequent words one by one, the others by their shape
    item = np.concatenate([np.arange(n_items), [n_items + shape(w) for w in list(count)[n_items:]], n_items + np.arange(SHAPES + 1)]).astype(np.int64)
    pairs = _count_pairs(texts, item)
    own = exchange(pairs, min(classes, len(pairs)))
    k = int(own.max()) + 1
    between = _by_class(pairs, own, k)
    # every other word joins the class under which its neighbours' classes are likeliest
    before, after = _shares(between.T), _shares(between)
    of = own[item]
    found = _place_numbered(_contexts(texts, of, n_items, n_known, k), n_known, before, after).toArrow()
    of[found["key"].to_numpy()] = found["class"].to_numpy()
    path = work_path(spark, "classes")
    _place(_rare_contexts(texts, own[item], n_known), "string", before, after).withColumnRenamed("key", "word").write.parquet(path)
    placed = spark.read.schema("word string, class int, n long").parquet(path)
    # class bigrams, and what the other words of each class hold, under the classes of all words
    known = np.where(_is_rare(np.arange(len(of)), n_known), -1, of)
    between = _count_pairs(texts, known, k)
    path = work_path(spark, "rare")
    every = _classed(source.texts, of, placed, path)
    rare = every.where("learn")
    for row in rare.groupBy("before", "class", "after").count().collect():  # at most k cubed, and few of them
        for a, b in ((row["before"], row["class"]), (row["class"], row["after"])):
            if a >= 0 and b >= 0:
                between[a, b] += row["count"]
    for row in _between_rare(rare).groupBy("a", "b").count().collect():
        between[row["a"], row["b"]] += row["count"]
    if not encoded:
        remove(spark, [source.path, path])
    transition = _shares(between)
    held = np.zeros((k, 2))
    for row in placed.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        held[row["class"]] = row["n"], row["types"]
    amounts = np.array(list(count.values()), dtype=np.float64)
    rest = of[n_items:n_known]
    held += np.stack([np.bincount(rest, amounts[n_items:], minlength=k), np.bincount(rest, minlength=k)], axis=1)
    own = np.concatenate([of[:n_items], np.arange(k), of[-1:]])
    mass = np.concatenate([amounts[:n_items], held[:, 0], [float(totals["end"] or 0)]])
    emission = np.log10((mass + 0.5) / np.bincount(own, mass + 0.5, minlength=k)[own])
    return BrownModel(count, n_items, of, placed, own, transition, emission, np.log10(held.sum(axis=1) + 1), int(totals["n"] or 0), int(totals["types"] or 0), int(totals["end"] or 0),
                      encoded, every if encoded else None)


def _shares(between: np.ndarray) -> np.ndarray:
    """Logs of each row's shares, half a count added to every cell."""
    return np.log10((between + 0.5) / (between.sum(axis=1, keepdims=True) + 0.5 * len(between)))


@dataclass(frozen=True)
class Encoded:
    """``texts``: rid, doc_id, learn, ids, rare, stored below ``path``; ids are places in ``count``, shapes after those, and ``rare`` lists the words with a shape's id."""

    count: dict[str, int]
    texts: DataFrame
    path: str


def frequent(counts: DataFrame, max_broadcast: int = MAX_BROADCAST) -> dict[str, int]:
    """Counts of the most frequent words, in this order."""
    top = counts.where(F.col("word") != END).orderBy(F.col("n").desc(), "word").limit(max_broadcast).toArrow()
    return dict(zip(top["word"].to_pylist(), top["n"].to_pylist()))


def encode(docs: DataFrame, count: dict[str, int], learn: Column | None = None, doc_id: str | None = None, text: str = "text") -> Encoded:
    """Texts as lists of word numbers; without ``learn``, training may read all of them."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({w.encode(): i for i, w in enumerate(count)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            at = 0
            for part in in_parts(_bytes(batch.column("text")), PART_CHARS):
                own = [tokens(value) for value in part]
                words = list(chain.from_iterable(own))
                ids = np.fromiter(map(number.get, words, repeat(-1)), dtype=np.int32, count=len(words))
                missing = np.flatnonzero(ids < 0)
                rare = [words[i].decode() for i in missing.tolist()]
                ids[missing] = len(number) + np.fromiter((shape(w) for w in rare), dtype=np.int32, count=len(rare))
                ends = np.cumsum([0, *map(len, own)])
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).slice(at, len(part)) for c in ("rid", "doc_id", "learn")], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(missing, ends), pa.int32()), pa.array(rare, pa.string()))], schema=TEXT)
                at += len(part)

    own_id = F.col(doc_id).cast("long") if doc_id else F.lit(None).cast("long")
    chosen = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    given = docs.select(F.monotonically_increasing_id().alias("rid"), own_id.alias("doc_id"), chosen.alias("learn"), F.col(text).alias("text"))
    path = work_path(spark, "encoded")
    given.mapInArrow(read, "rid long, doc_id long, learn boolean, ids array<int>, rare array<string>").write.parquet(path)
    return Encoded(count, spark.read.parquet(path), path)


def _is_rare(ids: np.ndarray, n_known: int) -> np.ndarray:
    return (ids >= n_known) & (ids < n_known + SHAPES)


def _sequences(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A few texts at a time: their rows, their ids with an end before the first and after each, and where in these the texts' ends are."""
    for batch in batches:
        sizes = batch.column("ids").value_lengths().to_numpy()
        done = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(done, done[start] + PART_IDS)))
            part, own = batch.slice(start, stop - start), sizes[start:stop]
            ids = np.full(own.sum() + len(own) + 1, end, dtype=np.int64)
            ids[np.arange(own.sum()) + np.repeat(np.arange(1, len(own) + 1), own)] = part.column("ids").flatten().to_numpy()
            yield part, ids, np.cumsum(own + 1)
            start = stop


def _count_pairs(texts: DataFrame, of: np.ndarray, size: int | None = None) -> np.ndarray:
    """How often two neighbours stand in two groups, an end before the first word and after the last; ``of`` is the group of each id, -1 for none."""
    size = size or int(of.max()) + 1
    shared = texts.sparkSession.sparkContext.broadcast(of)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        sums = np.zeros(size * size, dtype=np.int64)
        for _, ids, _ in _sequences(batches, len(of) - 1):
            own = of[ids]
            a, b = own[:-1], own[1:]
            both = (a >= 0) & (b >= 0)
            sums += np.bincount(a[both] * size + b[both], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at // size, at % size, sums[at])], ["a", "b", "n"])

    found = texts.select("ids").mapInArrow(counted, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()  # at most size squared
    pairs = np.zeros((size, size))
    pairs[found["a"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    return pairs


def _contexts(texts: DataFrame, of: np.ndarray, n_items: int, n_known: int, k: int) -> DataFrame:
    """(bucket, cells, n): neighbours' classes of the words ``n_items`` to ``n_known``, a bucket of words as one row for each run of texts.

    A cell is ``(word // BUCKETS * k + before) * k + after`` and ``word % BUCKETS`` the bucket; ``n`` tells how often each cell occurs.
    """
    shared = texts.sparkSession.sparkContext.broadcast(of)
    size = _width(n_known) * k * k

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for _, ids, _ in _sequences(batches, len(of) - 1):
            at = np.flatnonzero((ids >= n_items) & (ids < n_known))
            own = (ids[at] // BUCKETS * k + of[ids[at - 1]]) * k + of[ids[at + 1]]
            cells, n = np.unique(ids[at] % BUCKETS * size + own, return_counts=True)
            buckets, starts = np.unique(cells // size, return_index=True)
            ends = pa.array([*starts.tolist(), len(cells)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *[pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((cells % size, pa.int64()), (n, pa.int32()))]], ["bucket", "cells", "n"])

    return texts.select("ids").mapInArrow(read, "bucket int, cells array<long>, n array<int>")


def _width(n_known: int) -> int:
    return -(-n_known // BUCKETS)


def _place_numbered(contexts: DataFrame, n_known: int, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """(key, class, n) like :func:`_place` for the words of :func:`_contexts`; a task holds the counts of one bucket's words."""
    shared = contexts.sparkSession.sparkContext.broadcast((before, after))
    width, k = _width(n_known), len(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = shared.value
        bucket, left, right = -1, np.zeros((width, k)), np.zeros((width, k))

        def chosen() -> pa.RecordBatch:
            n = left.sum(axis=1).astype(np.int64)
            at = np.flatnonzero(n)
            gains = left[at] @ before.T + right[at] @ after.T
            return pa.RecordBatch.from_arrays([pa.array(at * BUCKETS + bucket, pa.int32()), pa.array(gains.round(9).argmax(axis=1), pa.int32()), pa.array(n[at])], ["key", "class", "n"])

        for batch in batches:
            buckets, cells, counts = batch.column("bucket").to_numpy(), batch.column("cells"), batch.column("n")
            starts = np.flatnonzero(np.diff(buckets, prepend=-1)).tolist()
            for start, stop in zip(starts, [*starts[1:], len(buckets)]):
                if buckets[start] != bucket:
                    if bucket >= 0:
                        yield chosen()
                    bucket, left, right = int(buckets[start]), np.zeros((width, k)), np.zeros((width, k))
                cell, n = (x.slice(start, stop - start).flatten().to_numpy() for x in (cells, counts))
                word = cell // (k * k) * k
                left += np.bincount(word + cell // k % k, n, minlength=width * k).reshape(width, k)
                right += np.bincount(word + cell % k, n, minlength=width * k).reshape(width, k)
        if bucket >= 0:
            yield chosen()

    return contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key int, class int, n long")


def _rare_contexts(texts: DataFrame, of: np.ndarray, n_known: int) -> DataFrame:
    """(key, before, after, n): neighbours' classes of the words that have no number, themselves as keys."""
    shared = texts.sparkSession.sparkContext.broadcast(of)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for part, ids, _ in _sequences(batches, len(of) - 1):
            at = np.flatnonzero(_is_rare(ids, n_known))
            yield pa.RecordBatch.from_arrays([part.column("rare").flatten(), *[pa.array(of[ids[at + d]], pa.int32()) for d in (-1, 1)], pa.array(np.ones(len(at), dtype=np.int64))],
                                             ["key", "before", "after", "n"])

    return texts.select("ids", "rare").mapInArrow(read, "key string, before int, after int, n long")


def _place(contexts: DataFrame, kind: str, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """(key, class, n): the class under which the neighbours of all the key's places are likeliest, and the number of places.

    ``before`` and ``after`` are logs of the shares of neighbours' classes, a row for each class. To first order this is the class
    whose choice makes the class bigrams likeliest. Rows of one key come one after another, so a task holds a batch.
    """
    shared = contexts.sparkSession.sparkContext.broadcast((np.ascontiguousarray(before.T), np.ascontiguousarray(after.T)))
    names = ["key", "class", "n"]

    def chosen(keys: pa.Array, gains: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.array(gains.round(9).argmax(axis=1), pa.int32()), pa.array(n, pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = shared.value
        held: tuple | None = None  # key, gains and places of the last key so far
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = batch.column("key"), batch.column("n").to_numpy()
            gains = (before[batch.column("before").to_numpy()] + after[batch.column("after").to_numpy()]) * n[:, None]
            new = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + 1
            starts = np.concatenate([[0], new])
            keys, gains, n = keys.take(pa.array(starts)), np.add.reduceat(gains, starts, axis=0), np.add.reduceat(n, starts)
            if held and held[0].equals(keys.slice(0, 1)):
                gains[0] += held[1]
                n[0] += held[2]
            elif held:
                yield chosen(held[0], held[1][None, :], [held[2]])
            if len(keys) > 1:
                yield chosen(keys.slice(0, len(keys) - 1), gains[:-1], n[:-1])
            held = keys.slice(len(keys) - 1), gains[-1], int(n[-1])
        if held:
            yield chosen(held[0], held[1][None, :], [held[2]])

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"key {kind}, class int, n long")


def _classed(texts: DataFrame, of: np.ndarray, placed: DataFrame, path: str) -> DataFrame:
    """(rid, learn, pos, before, after, class, n), stored below ``path``: the places of words without a number.

    ``before`` and ``after`` are the neighbours' classes, -1 where the neighbour has no number either. Words that ``placed`` lacks have their shape's class.
    """
    spark = texts.sparkSession
    n_known = len(of) - SHAPES - 1
    shared = spark.sparkContext.broadcast(of)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for part, ids, ends in _sequences(batches, len(of) - 1):
            is_rare = _is_rare(ids, n_known)
            own = of[ids]
            near = np.where(is_rare, -1, own)
            at = np.flatnonzero(is_rare)
            own_text = pa.array(np.searchsorted(ends, at))
            yield pa.RecordBatch.from_arrays([*[part.column(c).take(own_text) for c in ("rid", "learn")], pa.array(at), part.column("rare").flatten(), *[pa.array(x, pa.int32()) for x in (near[at - 1], near[at + 1], own[at])]], schema=RARE)

    rows = texts.select("rid", "learn", "ids", "rare").mapInArrow(read, "rid long, learn boolean, pos long, word string, before int, after int, unseen int")
    joined = rows.join(placed, "word", "left").select("rid", "learn", "pos", "before", "after", F.coalesce("class", "unseen").alias("class"), F.coalesce("n", F.lit(0)).alias("n"))
    joined.write.parquet(path)
    return spark.read.schema(joined.schema).parquet(path)


def _between_rare(rare: DataFrame) -> DataFrame:
    """(rid, a, b): classes of neighbours that both have no number."""
    none = F.lit(None).cast("int")
    ends = rare.where("after < 0").select("rid", "pos", F.col("class").alias("a"), none.alias("b")).unionByName(
        rare.where("before < 0").select("rid", (F.col("pos") - 1).alias("pos"), none.alias("a"), F.col("class").alias("b")))
    return ends.groupBy("rid", "pos").agg(F.max("a").alias("a"), F.max("b").alias("b")).drop("pos")


def _by_class(pairs: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    member = np.zeros((len(own), k))
    member[np.arange(len(own)), own] = 1
    return member.T @ pairs @ member


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Classes of items: each in turn moves to the class that makes the class bigrams most likely, until none moves."""
    n = len(pairs)
    mass = pairs.sum(axis=0) + pairs.sum(axis=1)
    own = np.zeros(n, dtype=np.int64)
    own[np.argsort(-mass, kind="stable")] = np.minimum(np.arange(n), k - 1) if n <= k else np.arange(n) % k
    between = _by_class(pairs, own, k)
    out, into = between.sum(axis=1), between.sum(axis=0)
    for _ in range(rounds):
        moved = 0
        for w in np.argsort(-mass, kind="stable").tolist():
            a = own[w]
            to = np.bincount(own, pairs[w], minlength=k)
            frm = np.bincount(own, pairs[:, w], minlength=k)
            self_pair = pairs[w, w]
            to[a] -= self_pair
            frm[a] -= self_pair
            # without w
            between[a, :] -= to
            between[:, a] -= frm
            between[a, a] -= self_pair
            w_out, w_in = to.sum() + self_pair, frm.sum() + self_pair
            out[a] -= w_out
            into[a] -= w_in
            # gain of putting w into each class c: its row, its column and the cell where they meet
            rows = _plogp(between + to[None, :]).sum(axis=1) - _plogp(between).sum(axis=1)
            cols = _plogp(between + frm[:, None]).sum(axis=0) - _plogp(between).sum(axis=0)
            cell = np.diag(between)
            meet = _plogp(cell + to + frm + self_pair) - _plogp(cell + to) - _plogp(cell + frm) + _plogp(cell)
            gain = rows + cols + meet - _plogp(out + w_out) + _plogp(out) - _plogp(into + w_in) + _plogp(into)
            c = int(gain.argmax())
            if gain[c] <= gain[a] + 1e-9:
                c = int(a)
            own[w] = c
            moved += c != a
            between[c, :] += to
            between[:, c] += frm
            between[c, c] += self_pair
            out[c] += w_out
            into[c] += w_in
        if not moved:
            break
    return own


def _listed(values: np.ndarray) -> Column:
    return F.expr(f"array({','.join(f'{float(x)!r}D' for x in values.ravel())})")


def score(docs: DataFrame, counts: DataFrame, model: BrownModel, doc_id: str = "doc_id", text: str = "text", encoded: Encoded | None = None) -> DataFrame:
    """One row for each document row: ``doc_id, n_tokens, n_known, base_score, score, perplexity``.

    ``encoded`` is the stored result of :func:`encode` over ``docs``, if it is there already. The model's own tables hold all that is read of ``counts``.
    """
    n_known, n_items, k = len(model.count), model.n_items, len(model.transition)
    texts = (encoded or encode(docs, model.count, None, doc_id, text)).texts
    once = np.log10(np.array([*model.count.values(), *[0] * SHAPES, model.end_count], dtype=np.float64) + 1)  # rare words add theirs after the join
    rest = model.emission[n_items : n_items + k] - model.within
    share = np.concatenate([model.emission[:n_items], rest[model.of[n_items:n_known]] + once[n_items:n_known], np.zeros(SHAPES), model.emission[-1:]])
    shared = docs.sparkSession.sparkContext.broadcast((model.of, model.transition, once, share, model.end_count > 0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, transition, once, share, end_known = shared.value
        for part, ids, ends in _sequences(batches, len(of) - 1):
            rare, own, inner = _is_rare(ids, n_known), of[ids], ids[1:]
            step = np.where(rare[:-1] | rare[1:], 0.0, transition[own[:-1], own[1:]])
            starts = np.concatenate([[0], ends[:-1]])  # of each text's tokens in inner
            n_tokens = np.diff(ends, prepend=0)
            seen = np.add.reduceat((inner < n_known).astype(np.int64), starts) + int(end_known)
            yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), *[pa.array(x) for x in (
                n_tokens, seen, np.add.reduceat(once[inner], starts), np.add.reduceat(share[inner] + step, starts))]], schema=SUMS)

    sums = texts.select("rid", "doc_id", "ids").mapInArrow(read, "rid long, doc_id long, n_tokens long, n_known long, logs double, class_logs double")
    rare = model.rare if encoded and encoded is model.encoded else _classed(texts, model.of, model.placed, work_path(docs.sparkSession, "rare"))
    n, own = F.col("n"), F.col("class")
    logs, no_id, zero = F.log10(n + 1), F.lit(None).cast("long"), F.lit(0).cast("long")
    step = lambda a, b: F.when((a >= 0) & (b >= 0), F.get(_listed(model.transition), a * k + b)).otherwise(0.0)
    places = rare.select("rid", no_id.alias("doc_id"), zero.alias("n_tokens"), (n > 0).cast("long").alias("n_known"), logs.alias("logs"),
                         (logs + F.get(_listed(rest), own) + step(F.col("before"), own) + step(own, F.col("after"))).alias("class_logs"))
    steps = _between_rare(rare).select("rid", no_id.alias("doc_id"), zero.alias("n_tokens"), zero.alias("n_known"), F.lit(0.0).alias("logs"),
                                       step(F.col("a"), F.col("b")).alias("class_logs"))
    whole = sums.unionByName(places).unionByName(steps).groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "logs")], F.sum("class_logs").alias("score"))
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(model.train_tokens + model.train_types + 1)))
    return whole.select("doc_id", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
                        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def stored_counts(docs: DataFrame, learn: Column, text: str = "text") -> DataFrame:
    """The vocabulary table, written to the shared folder once and read by the steps after it."""
    spark = docs.sparkSession
    path = work_path(spark, "words")
    count_words(docs, learn, text).write.parquet(path)
    return spark.read.parquet(path)
