"""Licence families of paragraphs: sparse n-gram logistic regression, confirmed by comparison with templates.

The classifier is trained here, on variants of short public notices (words dropped, years and names put in) and on
a bounded sample of ordinary paragraphs for the class ``unknown``.  Its n-grams are those of the notices; words
outside them count as one further feature.  A temperature, fitted on variants that training has not seen,
calibrates the probabilities.  A prediction is confirmed if a template of its family lies in the paragraph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsearch.llm.common import bounded_sample, ready

NEGATIVE_ROWS = 2_000  # documents whose paragraphs teach what is no licence, at most; chosen by the hash of their id
NEGATIVES_EACH = 3  # paragraphs of each
VARIANTS = 40  # of each template
PROBABILITY, SIMILARITY = 0.5, 0.8
UNKNOWN = "unknown"
GRAMS = 3

# --- fixed values: short notices of well-known public licences ----------------------------------------
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is licensed under the terms of the Apache 2.0 license.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL v3.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
}
# ------------------------------------------------------------------------------------------------------
FAMILIES = (UNKNOWN, *sorted(TEMPLATES))
_WORD = re.compile(r"[a-z0-9]+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[i:i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)]


@dataclass(frozen=True)
class Classifier:
    """Weights per n-gram (rows) and family (columns); rows of bias and of the share of other words come last."""

    index: dict[str, int]
    words: frozenset[str]
    weight: np.ndarray
    temperature: float
    templates: dict[str, list[list[str]]]

    def row(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and values of a paragraph's features, a sparse row of length one but for bias and share."""
        known = sorted({self.index[g] for g in grams(words) if g in self.index})
        other = sum(w not in self.words for w in words) / max(len(words), 1)
        n = len(self.index)
        return np.array([*known, n, n + 1]), np.array([1 / np.sqrt(max(len(known), 1))] * len(known) + [1.0, other])

    def probabilities(self, words: list[str]) -> np.ndarray:
        at, value = self.row(words)
        z = value @ self.weight[at] / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def similarity(self, words: list[str], family: str) -> float:
        """Best share of a template's words, in order, that a stretch of the paragraph as long as it has in common with it."""
        best = 0.0
        for template in self.templates.get(family, ()):
            n, wanted = len(template), set(grams(template))
            has = set(grams(words))
            best = max(best, len(wanted & has) / len(wanted) if n else 0.0)
        return best


def _variants(template: str, rng: np.random.Generator, many: int) -> list[list[str]]:
    words = tokens(template)
    out = [words]
    fill = ["copyright", "2019", "2021", "2024", "see", "notice", "project", "by", "the", "authors", "c", "all", "rights", "reserved"]
    for _ in range(many):
        kept = [w for w in words if rng.random() > 0.06] or words
        before = [fill[i] for i in rng.integers(0, len(fill), rng.integers(0, 5))]
        behind = [fill[i] for i in rng.integers(0, len(fill), rng.integers(0, 5))]
        out.append([*before, *kept, *behind])
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(negatives: list[str], rounds: int = 300, seed: int = 0) -> Classifier:
    """Multinomial logistic regression by gradient steps; the temperature by a search on rows set apart."""
    rng = np.random.default_rng(seed)
    templates = {f: [tokens(t) for t in ts] for f, ts in TEMPLATES.items()}
    texts = [(w, FAMILIES.index(f)) for f in FAMILIES[1:] for t in TEMPLATES[f] for w in _variants(t, rng, VARIANTS)]
    texts += [(tokens(t), 0) for t in sorted(negatives)]
    texts += [(tokens(t), 0) for t in ("", "license", "all rights reserved", "the terms of this work", "public domain of words", "version 2.0")]
    index = {g: i for i, g in enumerate(sorted({g for ts in templates.values() for t in ts for g in grams(t)}))}
    blank = Classifier(index, frozenset(w for w in index if " " not in w), np.zeros((len(index) + 2, len(FAMILIES))), 1.0, templates)
    x = np.zeros((len(texts), len(index) + 2), np.float32)
    for r, (words, _) in enumerate(texts):
        at, value = blank.row(words)
        x[r, at] = value
    y = np.array([f for _, f in texts])
    apart = np.arange(len(y)) % 5 == 0
    count = np.bincount(y[~apart], minlength=len(FAMILIES))
    share = (1 / count)[y[~apart]]
    share /= share.sum()
    w, momentum = np.zeros_like(blank.weight), np.zeros_like(blank.weight)
    target = np.eye(len(FAMILIES))[y[~apart]]
    for _ in range(rounds):
        slope = x[~apart].T @ ((_softmax(x[~apart] @ w) - target) * share[:, None]) + 1e-4 * w
        momentum = 0.9 * momentum + slope
        w = w - 2.0 * momentum
    z = x[apart] @ w
    loss = {t: -np.log(_softmax(z / t)[np.arange(apart.sum()), y[apart]] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
    return Classifier(index, blank.words, w, float(min(loss, key=loss.get)), templates)


def fit(docs: DataFrame, rows: int = NEGATIVE_ROWS) -> Classifier:
    """Train with paragraphs of at most ``rows`` documents as examples of no licence.

    Paragraphs that speak of a licence or copyright at all are no such examples.
    """
    ready(docs.sparkSession)
    chosen = bounded_sample(docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null"), rows, "doc_id")
    parts = F.filter(F.split("text", "\n"), lambda p: ~F.lower(p).rlike("licen|copyright|public|permi|free soft") & (F.length(p) > 0))
    return train([p for r in chosen.select(F.slice(parts, 1, NEGATIVES_EACH).alias("p")).collect() for p in r.p])


def _starts(c: Classifier) -> dict[tuple[str, ...], set[tuple[int, int]]]:
    """Where in a template of which length each of its three-word runs lies."""
    out: dict[tuple[str, ...], set[tuple[int, int]]] = {}
    for t in (t for ts in c.templates.values() for t in ts):
        for k in range(len(t) - 2):
            out.setdefault(tuple(t[k:k + 3]), set()).add((k, len(t)))
    return out


def wrapped(c: Classifier, starts: dict, lines: list[list[str]], first: int, hits: list[dict]) -> list[dict]:
    """Hits of a paragraph's lines, the first of them numbered ``first``, with those of windows over its words.

    A window is as long as a template and lies where three words of it stand; a similarity of 0.8 needs such a run.
    The words about it, half as many on each side, count for the similarity.  A window that overlaps a hit of its
    family counts only if it is confirmed and the hit is not; it takes the hit's place.
    """
    words = [w for ws in lines for w in ws]
    at = [n for n, ws in enumerate(lines, first) for _ in ws]
    spots = {(max(0, p - k), n) for p in range(len(words) - 2) if words[p] in c.words for k, n in starts.get(tuple(words[p:p + 3]), ())}
    found = []
    for s, n in spots:
        prob = c.probabilities(words[s:s + n])
        best = int(prob.argmax())
        if best and prob[best] >= PROBABILITY:
            like = c.similarity(words[max(0, s - n // 2):s + n + n // 2], FAMILIES[best])
            where = [x for x in range(s, min(s + n, len(words))) if words[x] in c.words]
            found.append((like, float(prob[best]), -where[0], at[where[0]], at[where[-1]], FAMILIES[best]))
    taken = [(h["paragraph"], h["paragraph"], h) for h in hits]
    for like, prob, _, low, high, family in sorted(found, reverse=True):
        met = [x for x in taken if x[2]["family"] == family and x[0] <= high and low <= x[1]]
        if not met or like >= SIMILARITY and not any(x[2]["confirmed"] for x in met):
            taken = [x for x in taken if x not in met]
            taken.append((low, high, {"paragraph": low, "family": family, "probability": prob, "similarity": like, "confirmed": like >= SIMILARITY}))
    return sorted((x[2] for x in taken), key=lambda h: (h["paragraph"], h["family"]))


def scan(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, paragraphs, found): found lists (paragraph, family, probability, similarity, confirmed).

    Paragraphs are numbered by lines: each line is judged, and then windows over neighbouring lines that are not blank,
    so that wrapped notices and notices inside long lines are found; these are listed at their first line.  Listed are those whose likeliest family is not ``unknown``, with its calibrated
    probability; those below PROBABILITY are unknown too.  Confirmed means SIMILARITY or more of a template's
    n-grams.  A null or empty text has none; every row gives a row; other columns are not read.
    """
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()),
                                   ("similarity", pa.float64()), ("confirmed", pa.bool_())]))
        blank: dict[int, bool] = {}
        starts = _starts(c)
        for b in batches:
            counts, found = [], []
            for t in b.column(1):
                text = t.as_py()
                lines = text.split("\n") if text else []
                counts.append(len(lines))
                hits = []
                told = [tokens(line) for line in lines]
                for n, words in enumerate(told):
                    known = sum(w in c.words for w in words)
                    # without two words of the notices the features are bias and share alone, or nearly so
                    if known < 2 and not blank.setdefault(known, int(c.probabilities(["zz"] * 5).argmax()) != 0):
                        continue
                    p = c.probabilities(words)
                    best = int(p.argmax())
                    if best and p[best] >= PROBABILITY:
                        like = c.similarity(words, FAMILIES[best])
                        hits.append({"paragraph": n, "family": FAMILIES[best], "probability": float(p[best]),
                                     "similarity": like, "confirmed": like >= SIMILARITY})
                full, n = [], 0
                while n < len(lines):
                    end = n
                    while end < len(lines) and lines[end].strip():
                        end += 1
                    if end > n:
                        full += wrapped(c, starts, told[n:end], n, [h for h in hits if n <= h["paragraph"] < end])
                    n = end + 1
                found.append(full)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int32()), pa.array(found, kind)], ["doc_id", "paragraphs", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, paragraphs int, found array<struct<paragraph:int,family:string,"
                                "probability:double,similarity:double,confirmed:boolean>>")
