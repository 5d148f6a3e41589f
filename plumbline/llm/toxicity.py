"""Operator 7: toxicity by the nearest labelled examples, with exact TF-IDF cosine from a block-max inverted index.

A bounded sample of labelled rows (``max_examples``, default 10,000, chosen by a hash of the id) gives the examples. Terms are the
words whose document counts among them depend on the label. Their document frequencies are counted over all documents. The
index over the examples is small and is broadcast. A query adds up the block maxima of its terms, opens blocks from the highest
bound down and stops when no bound reaches the k-th best cosine, so the k nearest are exact. Votes weighted by cosine become
a probability by a logistic curve fitted on the examples' own leave-one-out votes.

Defined results: null and empty texts and texts without a term take the share of toxic examples among examples without
a term, and no evidence. Equal cosines go to the lower example id. Without examples the score is 0. Repeated rows score alike;
repeated labels of one document count once, by the largest. Columns of the result replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import by_batches, without

TERM = re.compile(r"[^\W\d_]+")
MAX_EXAMPLES = 10_000
MAX_TERMS = 4_096
MIN_CHI2 = 40.0
MIN_LIFT = 3.0
BLOCK = 64
RESULT = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("label", T.IntegerType())])))])


@dataclass
class ToxicityModel:
    """Examples in order of id; postings of term ``t`` lie at ``starts[t]:starts[t + 1]``, by example."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray
    posting: np.ndarray
    weight: np.ndarray
    block_max: np.ndarray
    k: int = 15
    prior: float = 0.0
    curve: tuple[float, float] = (0.0, 1.0)

    def vector(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text and their TF-IDF weights, at length one."""
        counts = Counter([t for w in words if (t := self.terms.get(w)) is not None])
        at = np.array(sorted(counts), dtype=np.int64)
        if not len(at):
            return at, np.zeros(0)
        weight = (1 + np.log(np.array([counts[t] for t in at.tolist()], dtype=np.float64))) * self.idf[at]
        return at, weight / np.linalg.norm(weight)

    def nearest(self, at: np.ndarray, weight: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine, above 0, best first."""
        bound = weight @ self.block_max[at]
        best, at_best = np.zeros(0), np.zeros(0, dtype=np.int64)
        spans = [(self.posting[a:b], self.weight[a:b], w) for a, b, w in zip(self.starts[at].tolist(), self.starts[at + 1].tolist(), weight.tolist())]
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or (len(best) == self.k and bound[block] < best[-1] - 1e-12):
                break
            scores = np.zeros(BLOCK)
            for posting, held, w in spans:
                lo, hi = np.searchsorted(posting, (block * BLOCK, (block + 1) * BLOCK))
                scores[posting[lo:hi] - block * BLOCK] += held[lo:hi] * w
            own = np.flatnonzero(scores > 0)
            example, score = own + block * BLOCK, scores[own]
            if leave >= 0:
                score, example = score[example != leave], example[example != leave]
            at_best, best = np.r_[at_best, example], np.r_[best, score]
            order = np.lexsort((at_best, -np.round(best, 12)))[: self.k]
            at_best, best = at_best[order], best[order]
        return at_best, best

    def vote(self, examples: np.ndarray, similarity: np.ndarray) -> float:
        """Share of toxic neighbours by weight, drawn to the prior where there is little."""
        return float(((similarity * self.labels[examples]).sum() + 0.1 * self.prior) / (similarity.sum() + 0.1))

    def calibrated(self, vote: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a + b * vote))))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", max_examples: int = MAX_EXAMPLES,
          max_terms: int = MAX_TERMS, k: int = 15) -> ToxicityModel:
    """``labels`` must hold only rows that may be learned from; document frequencies come from all of ``docs``."""
    ids, marks, texts = _examples(docs, labels, label, doc_id, text, max_examples)
    terms = _choose_terms(texts, marks, max_terms)
    frequency, n_docs = _document_frequencies(docs, text, terms)
    idf = np.log((n_docs + 1) / (frequency + 1)) + 1
    model = ToxicityModel(terms, idf, ids, marks, np.zeros(len(terms) + 1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((len(terms), 1)), k)
    vectors = [model.vector(_words(t)) for t in texts]
    owner = np.concatenate([np.full(len(at), i) for i, (at, _) in enumerate(vectors)] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
    term = np.concatenate([at for at, _ in vectors] or [np.zeros(0, dtype=np.int64)])
    weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
    order = np.lexsort((owner, term))
    model.posting, model.weight = owner[order], weight[order]
    model.starts = np.searchsorted(term[order], np.arange(len(terms) + 1))
    model.block_max = np.zeros((len(terms), max(1, -(-len(ids) // BLOCK))))
    np.maximum.at(model.block_max, (term, owner // BLOCK), weight)
    bare = np.array([not len(at) for at, _ in vectors], dtype=bool)
    model.prior = float((marks[bare].sum() + 0.5) / (bare.sum() + 1)) if len(ids) else 0.0
    votes = np.array([model.vote(*model.nearest(at, w, leave=i)) for i, (at, w) in enumerate(vectors) if len(at)])
    model.curve = _logistic(votes, marks[~bare])
    return model


def _examples(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, max_examples: int) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    marked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__label"))
    n = marked.count()
    share = min(1.0, max_examples / n) if n else 1.0
    few = marked.where(F.pmod(F.xxhash64(F.col("__id"), F.lit("examples")), F.lit(1_000_000)) < int(share * 1_000_000))
    # about max_examples rows of two numbers: a proven bound for the broadcast
    joined = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(few), "__id")
    rows = sorted(joined.groupBy("__id").agg(F.first("__label").alias("label"), F.max("__text").alias("text")).collect(), key=lambda r: r["__id"])
    return np.array([r["__id"] for r in rows], dtype=np.int64), np.array([int(r["label"]) for r in rows], dtype=np.int64), [r["text"] for r in rows]


def _words(text: str | None) -> list[str]:
    return TERM.findall(text.lower()) if text else []


def _choose_terms(texts: list[str | None], marks: np.ndarray, max_terms: int) -> dict[str, int]:
    """Words that occur at least three times as often under one label as under the other, beyond chance."""
    of = [Counter(), Counter()]
    for text, mark in zip(texts, marks.tolist()):
        of[min(1, max(0, mark))].update(set(_words(text)))
    n1, n0 = int((marks > 0).sum()), int((marks <= 0).sum())
    scored = []
    for word, a in of[1].items():
        b = of[0][word]
        c, d = n1 - a, n0 - b
        chi2 = (n1 + n0) * (a * d - b * c) ** 2 / max(1, (a + b) * (c + d) * n1 * n0)
        if chi2 >= MIN_CHI2 and a * n0 >= MIN_LIFT * b * n1:
            scored.append((-chi2, word))
    return {word: i for i, (_, word) in enumerate(sorted(scored)[:max_terms])}


def _document_frequencies(docs: DataFrame, text: str, terms: dict[str, int]) -> tuple[np.ndarray, int]:
    """Over all documents; each task hands on one number a term at most."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(terms))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts, n = shared.value, Counter(), 0
        for batch in batches:
            n += len(batch)
            for value in batch["text"]:
                if value:
                    counts.update(known.intersection(TERM.findall(value.lower())))
        yield pd.DataFrame({"term": [*counts, None], "n": [*counts.values(), n]})

    sums = docs.select(F.col(text).alias("text")).mapInPandas(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    frequency, n_docs = np.zeros(len(terms)), 0
    for row in sums:
        if row["term"] is None:
            n_docs = row["n"]
        else:
            frequency[terms[row["term"]]] = row["n"]
    return frequency, n_docs


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton steps with a small ridge."""
    a, b = 0.0, 1.0
    for _ in range(50 if len(x) else 0):
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(p - y).sum() + 1e-2 * a, ((p - y) * x).sum() + 1e-2 * b])
        w = p * (1 - p)
        h = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(a), float(b)


def predict(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The input with ``score``, ``predicted`` and ``evidence`` (the nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(values: list, model: ToxicityModel) -> pd.DataFrame:
        out = []
        for value in values:
            at, weight = model.vector(TERM.findall(value.lower())) if value else ((), ())
            if not len(at):
                out.append((model.prior, []))
                continue
            examples, similarity = model.nearest(at, weight)
            near = [{"doc_id": int(model.ids[e]), "similarity": float(s), "label": int(model.labels[e])} for e, s in zip(examples, similarity)]
            out.append((model.calibrated(model.vote(examples, similarity)), near))
        return pd.DataFrame(out, columns=["score", "evidence"])

    run = by_batches(scored, RESULT, lambda: shared.value)
    kept = without(docs, "score", "predicted", "evidence", "__near")
    out = kept.withColumn("__near", run(F.col(text))).select(*[F.col(f"`{c}`") for c in kept.columns], "__near.score", "__near.evidence")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
