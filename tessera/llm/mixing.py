"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic. The cell table is raked until
its three marginals meet the targets; a cell's factor is its raked weight over
its tokens. Documents are then sampled with probabilities proportional to the
factors, calibrated so that the expected number of tokens meets the budget.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize

#: Cells up to which raking runs on the driver and the probabilities are sent to all rows; beyond, the same steps run on tables.
CELLS = 50_000
DIMENSIONS = ("source", "lang", "topic")
BLANKS = " \t\n\x0b\f\r"


def token_count(text: Column) -> Column:
    """Words of a text: starts of runs outside blanks (null: none)."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def text_topic(text: Column) -> Column:
    """A topic by form, for tables that have none: empty, listing, shouting, markup or prose of a length class."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    marks = F.regexp_count(t, F.lit(r"[#*$%&|<>]"))
    return (
        F.when(F.trim(t) == "", "empty")
        .when(marks * 20 > F.length(t), "markup")
        .when(~t.rlike(r"\p{Ll}"), "shouting")
        .when(F.length(t) < 1000, "short")
        .when(F.length(t) < 8000, "medium")
        .otherwise("long")
    )


@dataclass(frozen=True)
class Cell:
    key: tuple[str, ...]
    tokens: int


def rake(cells: list[Cell], targets: list[dict[str, float]], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of the cells whose marginals meet the targets as nearly as the empty cells allow.

    Targets are renormalised over the values that occur; a value without a
    target keeps its own share of the tokens.
    """
    w = np.array([c.tokens for c in cells], float)
    if not w.sum():
        return w
    w /= w.sum()
    plans = []
    for d, target in enumerate(targets):
        values, at = np.unique([c.key[d] for c in cells], return_inverse=True)
        have = np.bincount(at, w, len(values))
        aim = np.array([target.get(v, h) for v, h in zip(values, have, strict=True)], float) * (have > 0)
        plans.append((at, aim / aim.sum() if aim.sum() else have))
    for _ in range(rounds):
        off = 0.0
        for at, aim in plans:
            have = np.bincount(at, w, len(aim))
            off = max(off, float(np.abs(have - aim).max()))
            w = w * np.divide(aim, have, out=np.zeros_like(aim), where=have > 0)[at]
        if off < tolerance:
            break
    return w


def calibrate(cells: list[Cell], weights: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, s * weight / tokens) whose expected tokens are ``budget`` (all, if that is more)."""
    tokens = np.array([c.tokens for c in cells], float)
    ratio = np.divide(weights, tokens, out=np.zeros_like(weights), where=tokens > 0)
    p = (ratio > 0).astype(float)
    if budget >= (p * tokens).sum():
        return p
    full = np.zeros(len(cells), bool)
    while True:
        free = ~full & (ratio > 0)
        left = budget - tokens[full].sum()
        s = left / max((ratio * tokens)[free].sum(), 1e-300)
        over = free & (ratio * s > 1)
        if not over.any():
            return np.where(full, 1.0, np.clip(ratio * s, 0, 1))
        full |= over


def smoothed(cells: list[Cell], d: int, power: float = 0.5) -> dict[str, float]:
    """Default targets: the shares of the values raised to ``power``, which lifts the rare ones."""
    have: dict[str, float] = {}
    for c in cells:
        have[c.key[d]] = have.get(c.key[d], 0.0) + c.tokens
    total = sum(v**power for v in have.values()) or 1.0
    return {k: v**power / total for k, v in have.items()}


def factors(cells: DataFrame, targets: dict[str, dict[str, float]], total: float, rounds: int = 200, tolerance: float = 1e-9) -> list[DataFrame]:
    """``rake`` on tables: for each dimension (value, aim, f, gap); a cell's weight is its share of the tokens times its three f."""
    made = []
    for d in DIMENSIONS:
        plan = cells.groupBy(d).agg((F.sum("tokens") / total).alias("have")).withColumn("aim", F.sqrt("have"))
        if targets.get(d):
            wanted = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} string, want double")
            plan = plan.join(wanted, d, "left").withColumn("aim", F.coalesce("want", "have"))
        plan = plan.select(d, "have", F.when(F.col("have") > 0, F.col("aim")).otherwise(0.0).alias("aim"))
        whole = plan.agg(F.sum("aim")).first()[0]
        made.append(materialize(plan.select(d, (F.col("aim") / whole if whole else F.col("have")).alias("aim"), F.lit(1.0).alias("f")), "factors"))
    for _ in range(rounds):
        off = 0.0
        for k, d in enumerate(DIMENSIONS):
            part, others = F.col("tokens") / total, [j for j in range(len(DIMENSIONS)) if j != k]
            scaled = cells
            for j in others:
                scaled, part = scaled.join(made[j].select(DIMENSIONS[j], F.col("f").alias(f"f_{j}")), DIMENSIONS[j]), part * F.col(f"f_{j}")
            sums = scaled.groupBy(d).agg(F.sum(part).alias("m"))
            have = F.col("m") * F.col("f")
            made[k] = materialize(made[k].join(sums, d).select(d, "aim", F.when(have > 0, F.col("aim") / F.col("m")).otherwise(0.0).alias("f"), F.abs(have - F.col("aim")).alias("gap")), "factors")
            off = max(off, made[k].agg(F.max("gap")).first()[0])
        if off < tolerance:
            break
    return made


def chances(cells: DataFrame, targets: dict[str, dict[str, float]], budget: float) -> DataFrame:
    """``cells`` with p: ``rake`` and ``calibrate`` on tables; only sums come to the driver. ``budget`` is a share."""
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("p", F.lit(0.0))
    rated, ratio = cells, F.lit(1.0)
    for k, made in enumerate(factors(cells, targets, float(total))):
        rated, ratio = rated.join(made.select(DIMENSIONS[k], F.col("f").alias(f"f_{k}")), DIMENSIONS[k]), ratio * F.col(f"f_{k}")
    rated = materialize(rated.select(*DIMENSIONS, "tokens", F.when(F.col("tokens") > 0, ratio).otherwise(0.0).alias("ratio")), "rated")
    ratio, size = F.col("ratio"), F.col("tokens")
    if budget * total >= (rated.agg(F.sum(F.when(ratio > 0, size))).first()[0] or 0):
        return rated.withColumn("p", (ratio > 0).cast("double"))
    full, held, s = F.lit(False), 0, 0.0
    while True:
        taken, free, capped = rated.agg(F.sum(F.when(full, size).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(ratio * size)), F.count_if(full)).first()
        if s and capped == held:
            return rated.withColumn("p", F.when(full, 1.0).otherwise(F.least(F.lit(1.0), ratio * s)))
        held, s = capped, (budget * total - taken) / max(free, 1e-300)
        full = ratio * s > 1


def _value(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


#: Columns that ``mix`` adds.
ADDED = ("_mix_tokens", "_mix_source", "_mix_lang", "_mix_topic", "_mix_p", "_mix_taken")


def mix(docs: DataFrame, *, budget: float = 0.5, targets: dict[str, dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with the columns ADDED.

    ``budget`` is the share of all tokens to expect in the sample. ``targets``
    maps source, lang and topic to wanted shares; by default the shares of the
    square roots. A document is taken when a hash of its id and text, uniform
    on [0, 1), is below its cell's probability, so repeated rows fare alike.
    Null values of a dimension are the value ""; a null or empty text has no
    tokens and, in a cell without tokens, probability 0. Rows are neither
    dropped nor merged; columns named as in ADDED are replaced, all others may
    have any name; an empty table gives an empty table. Texts are measured
    once where ``keep`` leaves them out, else again as the rows are returned.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    topic = text_topic(docs[text_col]) if topic is None else topic
    values = {"source": _value(docs[source_col]), "lang": _value(docs[lang_col]), "topic": _value(topic)}
    draw = F.pmod(F.xxhash64(F.lit(seed), docs[id_col], docs[text_col]), F.lit(1 << 40)) / float(1 << 40)
    # by place, so that no name can clash
    measured = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(keep)), *(v.alias(k) for k, v in values.items()), token_count(docs[text_col]).alias("tokens"), draw.alias("draw"))
    if text_col not in keep:
        measured = materialize(measured, "measured")
    light = materialize(measured.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    targets = targets or {}
    if light.count() <= CELLS:
        cells = [Cell((r["source"], r["lang"], r["topic"]), int(r["tokens"])) for r in light.orderBy(*DIMENSIONS).collect()]
        weights = rake(cells, [targets.get(d) or smoothed(cells, k) for k, d in enumerate(DIMENSIONS)])
        chance = calibrate(cells, weights, budget * sum(c.tokens for c in cells))
        schema = ", ".join(f"{d} string" for d in DIMENSIONS) + ", p double"
        table = F.broadcast(docs.sparkSession.createDataFrame([(*c.key, float(p)) for c, p in zip(cells, chance, strict=True)], schema))
    else:
        table = chances(light, targets, budget).select(*DIMENSIONS, "p")
    p = F.coalesce("p", F.lit(0.0))
    joined = measured.join(table, list(DIMENSIONS), "left")
    return joined.select(*(f"c{i}" for i in range(len(keep))), "tokens", *DIMENSIONS, p, F.col("draw") < p).toDF(*keep, *ADDED)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per row: id, tokens, source, lang, topic, p, taken."""
    key = options.get("id_col", "doc_id")
    made = mix(docs, keep=[key], **options)
    return made.select(key, F.col("_mix_tokens").alias("tokens"), F.col("_mix_source").alias("source_cell"), F.col("_mix_lang").alias("lang_cell"), F.col("_mix_topic").alias("topic"), F.round("_mix_p", 9).alias("p"), F.col("_mix_taken").alias("taken"))


def sample_mixture(docs: DataFrame, **options) -> DataFrame:
    """The taken rows of ``docs``, with its columns."""
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    named = {k: f"c{docs.columns.index(options.pop(k, name))}" for k, name in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"), ("lang_col", "lang"))}
    return mix(own, **named, **options).where("_mix_taken").select(*own.columns).toDF(*docs.columns)
