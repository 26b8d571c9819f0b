"""Licence scans by a trained paragraph classifier.

A paragraph (line) is a sparse bag of word 1- to 3-grams; multinomial logistic
regression gives it a licence family or none. Probabilities are calibrated by
temperature on held-out examples, and a paragraph whose best family stays
below the calibrated threshold is unknown. A prediction counts only if the
paragraph also resembles one of the family's templates (share of a template's
distinctive words). Training uses generated variants of the templates and
invented prose, a fixed number of examples, on the driver.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases by which licences identify themselves in running text; families by name.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("licensed under the apache license version 2.0", "apache license version 2.0 january 2004", "spdx-license-identifier: apache-2.0"),
    "mit": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "spdx-license-identifier: mit", "licensed under the mit license"),
    "gpl": ("this work is licensed under the gnu general public license version 3", "gnu general public license as published by the free software foundation", "spdx-license-identifier: gpl-3.0-or-later", "licensed under the gpl version 2"),
    "lgpl": ("gnu lesser general public license version 2.1", "licensed under the lgpl version 3"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd 3-clause license", "spdx-license-identifier: bsd-3-clause"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"),
    "cc-by": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "cc-by-sa": ("licensed under cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international license"),
    "cc-by-nc": ("licensed under cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 international license"),
    "cc0": ("released under cc0 1.0 universal public domain dedication", "dedicated to the public domain"),
    "proprietary": ("all rights reserved", "copyright all rights reserved no part may be reproduced without permission", "confidential and proprietary"),
}
UNKNOWN = "unknown"
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Words common in prose: no evidence on their own.
COMMON = frozenset("the a an of and or to in is are as by for with under this that it be no any from on was at work part person may use version source".split())
EXAMPLES, STEPS, BATCH = 6000, 400, 256
#: Least share of a template's distinctive words in a confirmed paragraph; least precision on held-out examples.
RESEMBLANCE, PRECISION = 0.6, 0.99


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def ngrams(w: list[str]) -> set[str]:
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


@dataclass
class Model:
    families: list[str]
    index: dict[str, int]
    weights: np.ndarray  # n-grams x (families + unknown)
    bias: np.ndarray
    temperature: float
    threshold: float
    anchors: tuple[str, ...]  # a paragraph without any of these words can't resemble a template
    marks: dict[str, list[frozenset[str]]]

    def probabilities(self, w: list[str]) -> np.ndarray:
        known = [self.index[g] for g in ngrams(w) if g in self.index]
        z = (self.weights[known].sum(axis=0) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def classify(self, paragraph: str) -> tuple[str, float]:
        """(family or "unknown", probability)."""
        w = words(paragraph)
        p = self.probabilities(w)
        k = int(p.argmax())
        if k == len(self.families) or p[k] < self.threshold:
            return UNKNOWN, float(p[-1])
        have = set(w)
        if not any(len(m & have) >= RESEMBLANCE * len(m) for m in self.marks[self.families[k]]):
            return UNKNOWN, float(p[-1])
        return self.families[k], float(p[k])


def _examples(n: int) -> list[tuple[list[str], str]]:
    r = random.Random(11)
    stems = ("an", "er", "ti", "on", "re", "st", "he", "la", "do", "que", "ei", "sch", "ment")
    prose = lambda k: [r.choice(list(COMMON)) if r.random() < 0.4 else "".join(r.choice(stems) for _ in range(r.randint(1, 4))) for _ in range(k)]
    loose = ("license", "licensed", "public", "copyright", "rights", "permission", "free", "software", "version", "2.0", "3", "4.0", "commons", "mit", "apache", "reserved", "domain")
    out = []
    for _ in range(n):
        if r.random() < 0.5:
            family = r.choice(list(TEMPLATES))
            w = words(r.choice(TEMPLATES[family]))
            if r.random() < 0.3:
                w.pop(r.randrange(len(w)))
            w = prose(r.choice((0, 0, 2, 8, 40))) + w + prose(r.choice((0, 0, 2, 8)))
        else:
            family, w = UNKNOWN, prose(r.randint(1, 60))
            for _ in range(r.choice((0, 0, 1, 2))):
                w.insert(r.randrange(len(w) + 1), r.choice(loose))
        out.append((w, family))
    return out


_fitted: list[Model] = []


def fit() -> Model:
    """The classifier of this driver, fitted once on EXAMPLES generated paragraphs."""
    if _fitted:
        return _fitted[0]
    families = list(TEMPLATES)
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in ngrams(words(t)) if g not in COMMON})
    index = {g: i for i, g in enumerate(vocabulary)}
    label = {f: i for i, f in enumerate([*families, UNKNOWN])}
    rows = [([index[g] for g in ngrams(w) if g in index], label[f]) for w, f in _examples(EXAMPLES)]
    half = len(rows) * 2 // 3
    weights, bias = np.zeros((len(index), len(label))), np.zeros(len(label))
    bias[-1] = 2.0
    r = np.random.default_rng(0)
    for step in range(STEPS):
        grad, gb = np.zeros_like(weights), np.zeros_like(bias)
        for i in r.integers(half, size=BATCH):
            known, y = rows[i]
            z = weights[known].sum(axis=0) + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            grad[known] += p
            gb += p
        rate = 4.0 / (1 + step / 100)
        weights -= rate * (grad / BATCH + 1e-5 * weights)
        bias -= 0.2 * rate * gb / BATCH
    held = np.array([weights[k].sum(axis=0) + bias for k, _ in rows[half:]])
    y = np.array([k for _, k in rows[half:]])

    def soft(t: float) -> np.ndarray:
        e = np.exp((held - held.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log(soft(t)[np.arange(len(y)), y] + 1e-12).mean())
    p = soft(temperature)
    best, top = p.argmax(axis=1), p.max(axis=1)
    named = best < len(families)
    threshold = next((t for t in np.arange(0.3, 0.96, 0.05) if (best == y)[named & (top >= t)].mean() >= PRECISION), 0.95)
    marks = {f: [frozenset(w for w in words(t) if w not in COMMON) for t in ts] for f, ts in TEMPLATES.items()}
    # a paragraph with the needed share of a template's words has one of any (size - needed + 1) of them
    anchors = {w for ms in marks.values() for m in ms for w in sorted(m, key=lambda w: (-len(w), w))[: len(m) - math.ceil(RESEMBLANCE * len(m) - 1e-9) + 1]}
    _fitted.append(Model(families, index, weights, bias, float(temperature), float(threshold), tuple(sorted(anchors)), marks))
    return _fitted[0]


def scan_text(model: Model, text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, family, probability) of the licence paragraphs of a text."""
    out, at = [], 0
    low = (text or "").lower()
    present = [a for a in model.anchors if a in low]
    for line in (text or "").split("\n") if present else ():
        low = line.lower()
        if any(a in low for a in present):
            family, p = model.classify(line)
            if family != UNKNOWN:
                out.append((at, at + len(line), family, p))
        at += len(line) + 1
    return out


def _scan(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("p", pa.float64())]))
        for batch in batches:
            found = [[dict(zip(("start", "end", "family", "p"), x, strict=True)) for x in scan_text(model, t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], ["id", "licenses"])

    return run


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, licenses array<struct<start, end, family, p>> in order of offsets (code points, ends exclusive).

    Null and empty texts have none. Rows are neither dropped nor merged, so
    repeated rows are scanned each and a null id stays null; other columns are
    ignored; an empty table gives an empty table.
    """
    sent = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = sent.mapInArrow(_scan(fit()), "id long, licenses array<struct<start:long,end:long,family:string,p:double>>")
    return made.withColumnRenamed("id", id_col)


def license_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_licenses, families (sorted, comma-joined), spans (family:start:end, comma-joined)."""
    made = scan_licenses(docs, id_col=id_col, text_col=text_col)
    return made.select(
        id_col, F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
    )
