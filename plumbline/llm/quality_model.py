"""Operator 4: a sparse ensemble of conjunctive rules over text statistics.

Statistics are column expressions of one document row. Small trees, each grown on its own part of a bounded sample of labelled
rows, give paths; every path is a rule ("symbols per word > 0.2 and ..."). Logistic regression with an L1 penalty keeps few
rules, and these compile to one column expression, so scoring all documents is a projection without a shuffle or Python.

The sample holds about ``max_examples`` labelled rows (default 20,000), chosen by a hash of the id, so it is the same at every run.

Defined results: null, empty and blank texts have all statistics 0 and the score that follows from them. Without
examples, or with one class only, the score is that class's share (0.5 without any). Repeated rows score alike; repeated labels of one
document count once, by the largest label. Null labels are left out. Columns of the result replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let, without, words_of

MAX_EXAMPLES = 20_000
STATISTICS = ["words", "word_length", "symbols", "bars", "shouts", "capitals", "digits", "distinct", "echoes", "stops", "line_words", "repeated_lines"]


def statistics(text: Column) -> Column:
    """Struct of :data:`STATISTICS` as doubles; shares are a word or a character, and 0 for texts without words."""

    def count(pattern: str) -> Column:
        return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

    def facts(ws: Column) -> Column:
        n, chars = F.greatest(F.size(ws), F.lit(1)), F.greatest(F.length(text), F.lit(1))
        lines = F.split(text, "\n", -1)
        echoes = F.size(F.filter(F.transform(ws, lambda w, i: w == F.get(ws, i + 1)), lambda same: same))
        values = [F.size(ws), F.length(F.array_join(ws, "")) / n, count(r"[#*$%&<>]") / n, (F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))) / n,
                  (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))) / n, count(r"\p{Lu}") / chars, count("[0-9]") / chars,
                  F.size(F.array_distinct(ws)) / n, echoes / n,
                  (F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))) / n, n / F.size(lines),
                  let(lines, lambda ls: 1 - F.size(F.array_distinct(ls)) / F.size(ls))]
        return F.struct(*[v.cast("double").alias(name) for v, name in zip(values, STATISTICS)])

    none = F.struct(*[F.lit(0.0).alias(name) for name in STATISTICS])
    return let(words_of(text), lambda ws: F.when(F.size(ws) > 0, facts(ws)).otherwise(none))


@dataclass
class RuleModel:
    """``rules``: conjunctions of (statistic, above, cut) with their weights."""

    bias: float
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]]

    def score(self, facts: Column) -> Column:
        """Probability of label 1 from the statistics struct."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, above, cut in rule:
                holds = holds & ((facts[name] > cut) if above else (facts[name] <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
          max_examples: int = MAX_EXAMPLES, trees: int = 40, seed: int = 7) -> RuleModel:
    """Fits on labelled rows; ``labels`` must hold only rows that may be learned from."""
    values, marks = examples(docs, labels, label, doc_id, text, max_examples)
    if len(set(marks.tolist())) < 2:
        share = min(max(float(marks.mean()) if len(marks) else 0.5, 0.001), 0.999)
        return RuleModel(float(np.log(share / (1 - share))), [])
    rules = sorted({rule for tree in range(trees) for rule in _paths(values, marks, np.random.default_rng(seed + tree))})
    fires = np.stack([_fires(values, rule) for rule in rules], axis=1).astype(np.float64)
    weights, bias = lasso(fires, marks)
    named = [(tuple((STATISTICS[j], above, cut) for j, above, cut in rule), float(w)) for rule, w in zip(rules, weights) if w]
    return RuleModel(float(bias), named)


def examples(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, max_examples: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the bounded sample, on the driver."""
    marked = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__label"))
    n = marked.count()
    share = min(1.0, max_examples / n) if n else 1.0
    few = marked.where(F.pmod(F.xxhash64(F.col("__id"), F.lit("examples")), F.lit(1_000_000)) < int(share * 1_000_000))
    # about max_examples rows of two numbers: a proven bound for the broadcast
    joined = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(few), "__id")
    rows = joined.select("__label", statistics(F.col("__text")).alias("s")).select("__label", "s.*").toPandas()
    return rows[STATISTICS].to_numpy(dtype=np.float64), rows["__label"].to_numpy(dtype=np.float64)


def _paths(values: np.ndarray, marks: np.ndarray, rng: np.random.Generator, depth: int = 3, cuts: int = 24) -> list[tuple]:
    """Paths of one tree over a random half of the rows and statistics."""
    rows = np.sort(rng.choice(len(values), max(2, len(values) // 2), replace=False))
    columns = np.sort(rng.choice(values.shape[1], (values.shape[1] + 1) // 2, replace=False))
    found: list[tuple] = []

    def grow(at: np.ndarray, path: tuple) -> None:
        if path:
            found.append(tuple(sorted(path)))
        own = marks[at]
        if len(path) == depth or len(at) < 20 or own.min() == own.max():
            return
        best = None
        for j in columns:
            x = values[at, j]
            points = np.unique(np.quantile(x, np.linspace(0, 1, cuts + 2)[1:-1]))
            order = np.argsort(x, kind="stable")
            sums, left = np.r_[0, np.cumsum(own[order])], np.searchsorted(x[order], points, side="right")
            ok = (left >= 5) & (left <= len(at) - 5)
            if not ok.any():
                continue
            left, points = left[ok], points[ok]
            right, ones = len(at) - left, sums[left]
            rest = sums[-1] - ones
            impurity = ones * (left - ones) / left + rest * (right - rest) / right
            i = int(impurity.argmin())
            if best is None or impurity[i] < best[0] - 1e-12:
                best = impurity[i], int(j), float(points[i])
        if best is None or best[0] >= own.sum() * (len(at) - own.sum()) / len(at) - 1e-9:
            return
        above = values[at, best[1]] > best[2]
        grow(at[above], (*path, (best[1], True, best[2])))
        grow(at[~above], (*path, (best[1], False, best[2])))

    grow(rows, ())
    return found


def _fires(values: np.ndarray, rule: tuple) -> np.ndarray:
    holds = np.ones(len(values), dtype=bool)
    for j, above, cut in rule:
        holds &= (values[:, j] > cut) == above
    return holds


def lasso(x: np.ndarray, y: np.ndarray, penalty: float = 0.002, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps; the bias is free."""
    n = len(y)
    step = 4.0 / (np.linalg.norm(np.c_[np.ones(n), x], 2) ** 2 / n)
    w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x @ v + c))) - y
        raw = v - step * (x.T @ error) / n
        fresh = np.sign(raw) * np.maximum(np.abs(raw) - step * penalty, 0)
        fresh_b = c - step * error.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = fresh + (t - 1) / s * (fresh - w), fresh_b + (t - 1) / s * (fresh_b - b)
        w, b, t = fresh, fresh_b, s
    return w, b


def predict(docs: DataFrame, model: RuleModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The input with ``score`` and ``predicted``."""
    kept = without(docs, "score", "predicted", "__facts")
    scored = kept.withColumn("score", let(statistics(F.col(text)), model.score))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
