"""Personal data by candidate gradient boosting, as native expressions.

High-recall generators (regular expressions) propose spans of each kind, which
may overlap. Boosted trees score the proposals from their format and their
context; thresholds calibrated on held-out examples choose among them. The
spans of the base rules are always kept. The trees are fitted once per driver
on generated examples (EXAMPLES of them, a fixed bound); they are applied as
CASE expressions, so no Python runs on the executors.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.native import digits, find_all, let, luhn, none_found

#: Generated training examples, half of them for calibration.
EXAMPLES = 2400
TREES, DEPTH, RATE = 24, 3, 0.3
#: Precision that a kind's threshold must reach on the calibration half.
PRECISION = 0.97

KINDS = ("email", "ip", "card", "phone", "id", "iban", "secret")
BASE = KINDS[:4]
# (?:...|\G) lets a match begin where the last one ended, as a plain leftmost
# scan does; elsewhere only starts of runs are tried, so long runs stay linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators beyond the base rules: kind, what a text must contain, pattern.
GENERATORS = (
    ("email", r"(?i)[\[( ]\x20?at\x20?[\]) ]", r"(?i)(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{2,}+(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{2,}+(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,}+)++"),
    ("phone", r"[0-9]", r"(?<![0-9A-Za-z+.,/-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,5}(?![0-9A-Za-z])"),
    ("id", r"[0-9]-[0-9]", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,4})?(?![0-9A-Za-z])"),
    ("secret", r"(?i)(?:token|key|secret|passw)", r"(?i)(?<![A-Za-z])(?:token|api[_-]?key|key|secret|password|passwd)[\x20\"']{0,3}[:=][\x20\"']{0,3}[A-Za-z0-9_+/-]{6,}+=*+"),
)
CUES = r"(?i)(?:tel|phone|call|fax|mobile|cell|contact|mail|write|reach|ssn|social|iban|account|bank|token|key|secret|password)[^0-9A-Za-z]*$"
OTHER = r"(?i)(?:version|v\.|release|order|invoice|page|isbn|issn|doi|section|figure|chapter|score|ratio|total|no\.|date|on|\$|€|#)[^0-9A-Za-z]*$"
FEATURES = ("kind", "length", "digits", "groups", "distinct", "letters", "cue", "other", "glued", "unit", "zero", "luhn")


def _features(kind: int, m: Column) -> Column:
    x, b, a = m["text"], m["before"], m["after"]
    as_one = lambda c: F.when(c, 1.0).otherwise(0.0)
    d = digits(x)
    values = (
        F.lit(float(kind)), F.length(x), F.length(d), F.regexp_count(x, F.lit(r"[0-9A-Za-z]+")),
        F.size(F.array_distinct(F.split(F.lower(x), ""))), F.regexp_count(x, F.lit("[A-Za-z]")),
        as_one(b.rlike(CUES)), as_one(b.rlike(OTHER)), as_one(b.rlike(r"[0-9A-Za-z]$")), as_one(a.rlike(r"^(?:[0-9%€]|\x20?(?:kg|km|cm|mm|eur|usd|%))")),
        as_one(x.rlike(r"^\(?0|^\(")), as_one((F.length(d) >= 12) & luhn(F.substring(F.concat(F.lit("0"), d), 1, 40))),
    )
    return F.struct(*(v.cast("double").alias(n) for n, v in zip(FEATURES, values, strict=True)))


@dataclass(frozen=True)
class Tree:
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    value: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.predict(x), self.high.predict(x))

    def column(self, f: Column) -> Column:
        if self.low is None:
            return F.lit(self.value)
        return F.when(f[FEATURES[self.feature]] <= self.cut, self.low.column(f)).otherwise(self.high.column(f))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Tree:
    leaf = Tree(value=round(float(RATE * g.sum() / (h.sum() + 1.0)), 6))
    if depth == 0 or len(x) < 20:
        return leaf
    best, parent = (1e-3, -1, 0.0), g.sum() ** 2 / (h.sum() + 1.0)
    for j in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 16))):
            low = x[:, j] <= cut
            if 5 <= low.sum() <= len(x) - 5:
                gain = g[low].sum() ** 2 / (h[low].sum() + 1.0) + g[~low].sum() ** 2 / (h[~low].sum() + 1.0) - parent
                if gain > best[0]:
                    best = (gain, j, float(cut))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


@dataclass(frozen=True)
class Model:
    trees: tuple[Tree, ...]
    thresholds: tuple[float, ...]  # of the summed leaf values, by kind

    def margin(self, f: Column) -> Column:
        return reduce(lambda a, b: a + b, (t.column(f) for t in self.trees))


def _examples(n: int) -> list[dict]:
    """Labelled spans in invented contexts: personal data and look-alikes."""
    r = random.Random(7)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "ti", "on", "re", "st", "he", "la", "do", "que", "ei")) for _ in range(r.randint(1, 4)))
    code = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    rows = []
    for _ in range(n):
        kind = r.choice(("email", "phone", "phone", "id", "iban", "secret"))
        good = r.random() < 0.5
        cue = r.random() < 0.75
        if kind == "email":
            span = f"{word()}{r.choice((' at ', ' (at) ', '[at]'))}{word()}{r.choice((' dot ', ' (dot) ', '[dot]'))}{r.choice(('com', 'org', 'net', 'de'))}" if good else f"{word()} at {word()} dot {word()}"
            lead = r.choice(("mail", "write to", "contact")) if good and cue else word()
        elif kind == "phone":
            sep = r.choice(" -.")
            span = r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"0{num(2)}{sep}{num(3)}{sep}{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}")) if good else r.choice((f"20{num(2)}-0{num(1)}-1{num(1)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(2)} {num(3)}", f"{num(2)}.{num(2)}.{num(2)}", f"{num(4)}-{num(4)}", f"{num(3)} {num(2)} {num(2)}"))
            lead = r.choice(("tel", "phone:", "call", "fax", "mobile")) if good and cue else r.choice((word(), "version", "order", "on", "page", "invoice", word()))
        elif kind == "id":
            span = f"{num(3)}-{num(2)}-{num(4)}"
            lead = r.choice(("SSN", "social:", "ssn")) if good else r.choice((word(), "order", "isbn", "invoice", "version"))
        elif kind == "iban":
            span = f"{r.choice(('DE', 'FR', 'ES', 'GB'))}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}" if good else f"{r.choice(('AB', 'XK', 'RT', 'OL'))}{num(2)}{num(4)}{code(4).upper()}"
            lead = r.choice(("IBAN", "account", "bank")) if good and cue else r.choice((word(), "order", "version"))
        else:
            span = f'{r.choice(("token", "api_key", "secret", "password"))} = "{code(r.randint(16, 40))}"' if good else f"{r.choice(('key', 'token', 'secret'))}: {word()}{word()}{word()}"
            lead = word()
        rows.append({"kind": kind, "y": int(good), "text": f"{word()} {lead} {span} {word()} {word()}"})
    return rows


def _proposals(text: Column) -> Column:
    """array<struct<kind, m: MATCH, f: features>> of every generator."""

    def one(kind: str, needs: str, pattern: str) -> Column:
        found = F.when(text.rlike(needs), find_all(text, pattern)).otherwise(none_found())
        return F.transform(found, lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m.alias("m"), _features(KINDS.index(kind), m).alias("f")))

    return F.concat(*(one(*g) for g in GENERATORS))


_fitted: list[Model] = []


def fit(spark: SparkSession) -> Model:
    """The model of this driver: fitted on the first half of the examples, calibrated on the second."""
    if _fitted:
        return _fitted[0]
    rows = _examples(EXAMPLES)
    table = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<kind:string,y:int,text:string>>")).alias("e")).select("e.*")
    kinds = F.array(*map(F.lit, KINDS))
    made = table.select("y", "kind", F.explode(_proposals(F.col("text"))).alias("p")).where(F.get(kinds, F.col("p.kind")) == F.col("kind")).select("y", "p.f.*").collect()
    data = np.array([list(r) for r in made], float)
    y, x = data[:, 0], data[:, 1:]
    order = np.random.default_rng(0).permutation(len(y))
    y, x = y[order], x[order]
    half = len(y) // 2
    margin, trees = np.zeros(half), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x[:half], y[:half] - p, p * (1 - p), DEPTH)
        margin += tree.predict(x[:half])
        trees.append(tree)
    held = sum(t.predict(x[half:]) for t in trees)
    thresholds = []
    for k in range(len(KINDS)):
        own = x[half:, 0] == k
        cut = float("inf")
        for t in sorted(set(held[own].tolist()), reverse=True):
            chosen = own & (held >= t)
            if y[half:][chosen].mean() >= PRECISION:
                cut = t
        thresholds.append(round(cut - 1e-6, 6) if cut < float("inf") else 1e9)
    _fitted.append(Model(tuple(trees), tuple(thresholds)))
    return _fitted[0]


def _span(kind: str, m: Column) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"))


def _base_spans(text: Column) -> Column:
    def part_fits(p: Column) -> Column:
        bare = F.ltrim(p, F.lit("0"))
        return (F.length(bare) <= 3) & (F.when(bare == "", "0").otherwise(F.substring(bare, 1, 3)).cast("int") <= 255)

    def card_fits(m: Column) -> Column:
        return let(digits(m["text"]), lambda d: F.length(d).between(12, 19) & luhn(F.substring(d, 1, 19)))

    number = text.rlike("[0-9]")
    found = {
        "email": F.when(F.contains(text, F.lit("@")), find_all(text, EMAIL)).otherwise(none_found()),
        "ip": F.filter(F.when(number & text.rlike(r"[0-9]\.[0-9]"), find_all(text, IP)).otherwise(none_found()), lambda m: F.forall(F.split(m["text"], r"\."), part_fits)),
        "card": F.filter(F.when(number, find_all(text, CARD)).otherwise(none_found()), card_fits),
        "phone": F.filter(F.when(text.rlike(r"\+[0-9]"), find_all(text, PHONE)).otherwise(none_found()), lambda m: F.length(digits(m["text"])).between(9, 15)),
    }
    return F.concat(*(F.transform(v, partial(_span, k)) for k, v in found.items()))


def _added_spans(text: Column, model: Model) -> Column:
    cuts = F.array(*map(F.lit, model.thresholds))
    chosen = F.filter(_proposals(text), lambda p: model.margin(p["f"]) >= F.get(cuts, p["kind"]))
    return F.transform(chosen, lambda p: F.struct(p["m"]["start"].alias("start"), p["kind"].alias("kind"), p["m"]["end"].alias("end")))


def find_pii(docs: DataFrame, *, text_col: str = "text", base_col: str = "pii_base", spans_col: str = "pii_spans") -> DataFrame:
    """``docs`` with two arrays of (start, kind, end), kinds as numbers in KINDS, ordered by start, kind, end.

    The first holds the spans of the base rules, the second those and the
    chosen proposals that lie in none of them. Offsets are code points, ends
    exclusive. Null and empty texts have none; rows are neither dropped nor
    merged, so repeated rows and ids and empty tables are kept as they are; a
    column of the same name as an output is replaced.
    """
    model = fit(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))

    def both(b: Column) -> Column:
        extra = F.filter(_added_spans(text, model), lambda s: ~F.exists(b, lambda t: (t["start"] <= s["start"]) & (s["end"] <= t["end"])))
        return F.struct(b.alias("base"), F.array_sort(F.array_distinct(F.concat(b, extra))).alias("spans"))

    # by place, so that no name can clash
    names = [c for c in docs.columns if c not in (base_col, spans_col)]
    made = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)), let(F.array_sort(_base_spans(text)), both).alias("made"))
    return made.select(*(f"c{i}" for i in range(len(names))), "made.base", "made.spans").toDF(*names, base_col, spans_col)


def redact(text: Column, spans: Column) -> Column:
    """The text with each span as [KIND]; overlapping spans become the first one's mark."""
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        further = F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.array(gap, F.get(marks, s["kind"]))).alias("out"))
        widened = F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["pos"], further).otherwise(widened)

    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.expr("cast(array() as array<string>)").alias("out"))
    done = F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["pos"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (see find_pii for the edge cases)."""
    found = find_pii(docs.select(F.col(id_col), F.col(text_col)), text_col=text_col)
    kinds = F.transform("pii_base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select(id_col, *counts, F.sha2(written(F.col("pii_base")), 256).alias("base_sha256"), written(F.col("pii_spans")).alias("spans"))


def redact_documents(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced in ``text_col``; a null text stays null; columns and rows are kept, whatever their names."""
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = f"c{docs.columns.index(text_col)}"
    found = find_pii(own, text_col=text)
    return found.withColumn(text, redact(F.col(text), F.col("pii_spans"))).select(*own.columns).toDF(*docs.columns)
