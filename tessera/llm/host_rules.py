"""Host-level quality rules, as native expressions.

Every document is measured and put to the rules (RULES). Failures are summed by
host and rule. For each rule a beta prior is fitted to all hosts' failure rates
(empirical Bayes), every host's rate is shrunk by it, and a host fails a rule
when its shrunk rate stands out from that prior and most of its documents
fail. The verdicts are joined back to the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.native import let
from tessera.storage import materialize

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more."""

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - WINDOW + 1)
        key = lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(WINDOW)))

        def exact(_: Column) -> Column:
            pairs = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("g"), i.alias("i"))))

            def repeated(s: Column) -> Column:
                same = lambda a, b: F.coalesce(F.get(s, a)["g"] == F.get(s, b)["g"], F.lit(False))
                hits = F.filter(F.transform(s, lambda e, k: F.when(same(k, k + 1) | ((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))), e["i"])), lambda i: i.isNotNull())
                return let(F.sort_array(hits), lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1), F.lit(2**31 - 1)) - i, F.lit(WINDOW))), F.lit(0), lambda a, b: a + b))

            return let(pairs, repeated)

        # equal windows have equal hashes, so all-distinct hashes prove that nothing repeats
        return F.when(F.size(w) < WINDOW, 0).otherwise(let(F.transform(starts, key), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(exact(h))))

    return let(words, of)


def measure(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words> of a text (null: none)."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: F.length(w) > 0)
    bare = F.translate(t, BLANKS, "")
    lines = F.filter(F.split(t, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (n_repeat_words * 100 > n_words * 20)


#: What a document fails, as SQL over its measures: too few words, words repeated in windows, symbols,
#: repeated lines, and words too short or too long on average.
RULES = {
    "few": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}
#: Standard deviations at which the prior's quantile is taken (2: about 0.98), and by which a host must lie above it.
OUTLYING, SURE = 2.0, 2.0
#: Least shrunk failure rate of a host that fails: most of its documents.
LEAST = 0.5
#: Weight of a prior in documents where the hosts' spread doesn't tell it, and at most.
PRIOR_DOCS, MOST_DOCS = 20.0, 1000.0


def fit_prior(failed: int, docs: int, hosts: int, spread: float, inverse: float) -> tuple[float, float]:
    """(mean, weight) of the beta prior, by moments.

    ``spread`` is the variance of the hosts' rates, ``inverse`` the mean of one
    over their documents. What of the spread chance alone doesn't explain is
    the prior's variance; where that is undefined (one host) or nothing, the
    weight is PRIOR_DOCS or MOST_DOCS.
    """
    mean = failed / docs if docs else 0.0
    within = mean * (1 - mean)
    between = (spread or 0.0) - within * (inverse or 0.0)
    if hosts < 2 or not 0 < within:
        return mean, PRIOR_DOCS
    if between <= 0:
        return mean, MOST_DOCS
    return mean, max(1.0, min(within / between - 1, MOST_DOCS))


def prior_limit(mean: float, weight: float, outlying: float) -> float:
    """The beta prior's quantile at ``outlying`` standard deviations, by a normal distribution of the logits."""
    within = mean * (1 - mean)
    if not within:
        return mean
    return 1 / (1 + math.exp(-(math.log(mean / (1 - mean)) + outlying / (within * (weight + 1)) ** 0.5)))


def host_verdicts(failures: DataFrame, host_col: str, rules: tuple[str, ...] = ("failed",), *, least: float = LEAST, outlying: float = OUTLYING, sure: float = SURE) -> DataFrame:
    """(host, docs, rate, host_failed) from rows of (host, a boolean for each rule); rate is the highest shrunk one.

    A host fails a rule when its shrunk rate exceeds ``least`` and, by
    ``sure`` standard deviations of its own posterior, the prior's quantile
    (see prior_limit). Null hosts are a host of their own; no rows
    give no rows.
    """
    hosts = failures.groupBy(host_col).agg(F.count("*").alias("docs"), *(F.sum(F.col(r).cast("long")).alias(f"failed_{r}") for r in rules))
    stats = [F.sum("docs").alias("d"), F.count("*").alias("h"), F.avg(1 / F.col("docs")).alias("inv")]
    for r in rules:
        stats += [F.sum(f"failed_{r}").alias(f"f_{r}"), F.var_pop(F.col(f"failed_{r}") / F.col("docs")).alias(f"v_{r}")]
    p = hosts.agg(*stats).first()  # one row
    rates, verdict = [], F.lit(False)
    for r in rules:
        mean, weight = fit_prior(p[f"f_{r}"] or 0, p["d"] or 0, p["h"], p[f"v_{r}"], p["inv"])
        rate = (F.col(f"failed_{r}") + mean * weight) / (F.col("docs") + weight)
        limit = prior_limit(mean, weight, outlying)
        doubt = F.sqrt(rate * (1 - rate) / (F.col("docs") + weight + 1))
        rates.append(rate)
        verdict = verdict | ((rate > least) & (rate - sure * doubt > limit))
    return hosts.select(host_col, "docs", (F.greatest(*rates) if len(rates) > 1 else rates[0]).alias("rate"), verdict.alias("host_failed"))


def host_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """Per row: id, the five measures, base_failed, kept.

    A document is kept unless it fails the base rules or its host fails one of
    RULES. Null and empty texts have no words and fail. Rows with a null host
    are judged alone: no host verdict touches them. Repeated rows count and are
    returned each; other columns are ignored; an empty table gives an empty
    table.
    """
    measured = docs.select(docs[id_col].alias("doc_id"), docs[host_col].cast("string").alias("host"), measure(docs[text_col]).alias("m")).select("doc_id", "host", "m.*")
    judged = materialize(measured.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))), "measures")
    failures = judged.where("host IS NOT NULL").select("host", *(F.expr(rule).alias(name) for name, rule in RULES.items()))
    verdicts = host_verdicts(failures, "host", tuple(RULES), **limits).select("host", "host_failed")
    kept = ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))
    return judged.join(verdicts, "host", "left").select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
