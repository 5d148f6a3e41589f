"""Operator 5: licence families of paragraphs, with column expressions only.

A paragraph is a line. Its features are distinct word pairs and triples. One logistic regression with an L1 penalty for each family is fitted
on notices of that family and their cuttings against other families and against lines of a bounded sample of documents (about
``max_lines``, default 4,000, by a hash). The largest margin, put through a curve fitted on examples held back, gives the probability that the
paragraph is of any known family; the rest is the unknown class. A prediction counts only if the paragraph shares enough pairs and
triples with a notice of the predicted family.

Scoring stays in the document's row until a line has a feature of non-zero weight. Only those lines become rows, meet the weights
(bounded, broadcast) and are summed up.

Defined results: null, empty and blank texts have no paragraphs of any family. Every input row gives one result row,
repeated rows included. Lines of any length are read whole. Without sample lines the field of unknown lines rests on the other families.
Input columns other than id and text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let
from plumbline.llm.decontaminate import normal_words
from plumbline.llm.quality_model import lasso

MAX_LINES = 4_000
#: Share of the shorter side's pairs and triples that a notice and a paragraph must have in common.
MIN_SHARED = 0.5
#: Opening words and customary notices of public licences.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
                   "This project is distributed under the Apache License 2.0."],
    "BSD": ["Released under the BSD License.", "This software is distributed under the 3-Clause BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 2.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 3.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "all-rights-reserved": ["Copyright. All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission."],
}


def grams(line: Column) -> Column:
    """Hashes of a line's distinct word pairs and triples; the last words stand alone."""
    return let(normal_words(line), lambda ws: let(F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1))), lambda pairs: F.array_distinct(F.concat(
        pairs, F.transform(pairs, lambda p, i: F.xxhash64(p, F.get(ws, i + 2)))))))


@dataclass
class LicenseModel:
    """``weights[gram]`` has one number for each family; ``notices`` are the grams of (family, notice); ``curve`` gives the known class."""

    families: list[str]
    bias: np.ndarray
    weights: dict[int, np.ndarray]
    notices: list[tuple[str, list[int]]]
    curve: tuple[float, float]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_lines: int = MAX_LINES, notices: dict[str, list[str]] | None = None) -> LicenseModel:
    spark, notices = docs.sparkSession, notices or NOTICES
    families = sorted(notices)
    cut = [(family, line, whole) for family in families for notice in notices[family] for line, whole in _cuttings(notice)]
    made = spark.createDataFrame(cut, "family string, line string, whole boolean").select("family", "whole", grams(F.col("line")).alias("g")).collect()
    held = sorted({(r["family"], tuple(sorted(r["g"])), r["whole"]) for r in made})
    whole = [(f, set(g)) for f, g, w in held if w]
    other = [g for g in _sample_lines(docs, doc_id, text, max_lines) if not any(_shared(set(g), t) >= MIN_SHARED for _, t in whole)]
    examples = [(f, g) for f, g, _ in held] + [(None, tuple(g)) for g in other]
    columns = sorted({g for _, gs, _ in held for g in gs})
    at = {g: i for i, g in enumerate(columns)}
    x = np.zeros((len(examples), len(columns)))
    for i, (_, gs) in enumerate(examples):
        x[i, [at[g] for g in gs if g in at]] = 1
    apart = np.arange(len(examples)) % 4 == 3
    fitted = [lasso(x[~apart], np.array([f == family for f, _ in examples], dtype=float)[~apart], penalty=0.0003, rounds=400) for family in families]
    weights, bias = np.stack([w for w, _ in fitted], axis=1), np.array([b for _, b in fitted])
    margin = (x @ weights + bias).max(axis=1)
    curve = _curve(margin[apart], np.array([f is not None for f, _ in examples], dtype=float)[apart])
    kept = {g: weights[i] for g, i in at.items() if np.abs(weights[i]).max() > 1e-6}
    return LicenseModel(families, bias, kept, [(f, sorted(g)) for f, g in whole], curve)


def _cuttings(notice: str) -> list[tuple[str, bool]]:
    """A notice, its beginnings and ends, and the notice with words around it."""
    words = notice.split(" ")
    parts = [" ".join(words[:n]) for n in range(max(4, len(words) // 2), len(words))] + [" ".join(words[n:]) for n in range(1, len(words) // 3 + 1)]
    return [(notice, True), *((p, False) for p in parts), (f"Note: {notice}", False), (f"{notice} See the file for details.", False)]


def _sample_lines(docs: DataFrame, doc_id: str, text: str, max_lines: int) -> list[list[int]]:
    n = docs.count()
    share = min(1.0, max_lines / 8 / n) if n else 1.0
    few = docs.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit("licenses")), F.lit(1_000_000)) < int(share * 1_000_000))
    lines = few.select(F.explode(F.split(F.col(text), "\n", -1)).alias("line")).where("length(line) > 0")
    # the plan is bounded by the sample; the limit only guards against single texts of very many lines
    return [r["g"] for r in lines.select(grams(F.col("line")).alias("g")).orderBy(F.xxhash64("g")).limit(max_lines).collect()]


def _shared(a: set, b: set) -> float:
    return len(a & b) / max(1, min(len(a), len(b)))


def _curve(margin: np.ndarray, known: np.ndarray) -> tuple[float, float]:
    a, b = 0.0, 1.0
    for _ in range(40):
        p = 1 / (1 + np.exp(-(a + b * margin)))
        g = np.array([(p - known).sum() + 0.1 * a, ((p - known) * margin).sum() + 0.1 * (b - 1)])
        w = p * (1 - p)
        h = np.array([[w.sum() + 0.1, (w * margin).sum()], [(w * margin).sum(), (w * margin**2).sum() + 0.1]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(a), float(b)


def scan(docs: DataFrame, model: LicenseModel, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each document: ``doc_id, paragraphs array<struct<line, family, score>>``, lines counted from 1."""
    spark = docs.sparkSession
    known = sorted({*model.weights, *(x for _, g in model.notices for x in g)})
    heavy = sorted(model.weights)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    marked = F.transform(lines, lambda line, i: F.struct((i + 1).alias("line"), let(grams(line), lambda g: F.struct(
        F.filter(g, lambda h: h.isin(known)).alias("hits"), F.size(g).alias("size"))).alias("g")))
    found = F.filter(marked, lambda x: F.exists(x["g"]["hits"], lambda h: h.isin(heavy)))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), found.alias("found"))
    rows = rows.select("rid", "doc_id", F.explode_outer("found").alias("p"))
    rows = rows.select("rid", "doc_id", "p.line", F.col("p.g.size").alias("size"), F.explode_outer("p.g.hits").alias("gram"))
    table = spark.createDataFrame([(g, [float(w) for w in model.weights[g]]) for g in heavy], "gram long, w array<double>")
    shared = _notice_rows(model)
    joined = rows.join(F.broadcast(table), "gram", "left").join(F.broadcast(spark.createDataFrame(shared, "gram long, notice array<int>")), "gram", "left")
    k = len(model.families)
    sums = [F.sum(F.coalesce(F.get("w", F.lit(i)), F.lit(0.0))).alias(f"w{i}") for i in range(k)]
    each = joined.groupBy("rid", "line").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.collect_list("notice").alias("met"), *sums)
    margins = F.array(*[F.col(f"w{i}") + F.lit(float(model.bias[i])) for i in range(k)])
    each = each.withColumn("margins", margins).withColumn("top", F.array_max("margins"))
    place = F.array_position("margins", F.col("top")).cast("int") - 1
    score = 1 / (1 + F.exp(-(F.lit(model.curve[0]) + F.lit(model.curve[1]) * F.col("top"))))
    each = each.select("rid", "doc_id", "line", "size", F.flatten("met").alias("met"), place.alias("place"), score.alias("score"))
    confirmed = F.lit(False)
    for j, (family, g) in enumerate(model.notices):
        both = F.size(F.filter("met", lambda x: x == j))
        confirmed = confirmed | ((F.col("place") == model.families.index(family)) & (both >= MIN_SHARED * F.least(F.col("size"), F.lit(len(g)))))
    names = F.array(*[F.lit(f) for f in model.families])
    paragraph = F.when(F.col("line").isNotNull() & (F.col("score") >= threshold) & confirmed,
                       F.struct("line", F.get(names, F.col("place")).alias("family"), F.col("score").alias("score")))
    return each.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(paragraph)).alias("paragraphs")).drop("rid")


def _notice_rows(model: LicenseModel) -> list[tuple[int, list[int]]]:
    """For each gram, the notices that hold it."""
    held: dict[int, list[int]] = {}
    for j, (_, g) in enumerate(model.notices):
        for x in g:
            held.setdefault(x, []).append(j)
    return sorted(held.items())
