"""Retrieval evaluation: expectations, hit flags and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize_eval, or_empty

ARTICLE = r"(?iu)\bMADDE\s+(\d+)\s*(?:[-\x{2013}])?"


def article_numbers(content: Column, article_no: Column | None = None) -> Column:
    """Distinct article numbers of a text in order; a metadata value wins."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(ARTICLE), F.lit(1)))
    if article_no is None:
        return found
    given = F.nullif(article_no.cast("string"), F.lit(""))
    return F.when(given.isNotNull(), F.array(given)).otherwise(found)


def expects_document(haystack: Column, expected: Column) -> Column:
    """Any expected substring occurs, in the evaluator's form."""
    return F.exists(expected, lambda e: F.contains(normalize_eval(haystack), normalize_eval(e)))


def expects_terms(contents: Column, terms: Column) -> Column:
    """All terms occur in the joined contents; no terms are always met."""
    joined = normalize_eval(F.array_join(contents, " "))
    return F.forall(terms, lambda t: F.contains(joined, normalize_eval(t)))


def hit_flags(ranked: DataFrame, truth: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """Per query with a truth row: hit_k for each k, whether an expected document ranks within k."""
    flags = [F.max(((F.col("rank") <= k) & F.col("expected")).cast("int")).alias(f"hit_{k}") for k in ks]
    asked = truth.select("query_id").distinct()
    marked = truth.select("query_id", "doc_id").distinct().withColumn("expected", F.lit(True))
    joined = ranked.join(marked, ["query_id", "doc_id"], "left").withColumn("expected", F.coalesce("expected", F.lit(False)))
    found = joined.groupBy("query_id").agg(*flags)
    return asked.join(found, "query_id", "left").select("query_id", *(F.coalesce(f"hit_{k}", F.lit(0)).alias(f"hit_{k}") for k in ks))


def evaluation(results: DataFrame, expectations: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """Per question of ``expectations``: document_hit_k and article_hit_k for each k, expected_terms_hit_<last k>, all 0 or 1.

    results (query_id, rank, source, title, content, article_no), cut to the
    last k; expectations (query_id, expected_documents, expected_article_no,
    expected_terms). Null texts, lists and numbers are empty; no expected
    documents or article never hit, no expected terms always do, also without
    results. A null question id matches nothing; a repeated one has a row each time.
    """
    last = max(ks)
    empty = F.expr("cast(array() as array<string>)")
    asked = expectations.select(
        F.monotonically_increasing_id().alias("_row"), "query_id", F.coalesce("expected_documents", empty).alias("_docs"),
        or_empty(F.col("expected_article_no")).alias("_no"), F.coalesce("expected_terms", empty).alias("_terms"),
    )
    kept = results.where(F.col("rank") <= last).select("query_id", "rank", "source", "title", "content", "article_no")
    joined = asked.join(kept, "query_id", "left")
    named = F.concat(or_empty(F.col("source")), F.lit(" "), or_empty(F.col("title")))
    found = F.col("rank").isNotNull()
    document = found & expects_document(named, F.col("_docs"))
    article = found & (F.col("_no") != "") & F.array_contains(article_numbers(F.col("content"), F.col("article_no")), F.col("_no"))
    marked = joined.withColumns({"_document": document, "_article": article})
    hit = lambda c, k: F.max((F.col(c) & (F.col("rank") <= k)).cast("int"))
    flags = [F.coalesce(hit(f"_{c}", k), F.lit(0)).alias(f"{c}_hit_{k}") for c in ("document", "article") for k in ks]
    texts = F.transform(F.sort_array(F.collect_list(F.when(found, F.struct("rank", or_empty(F.col("content")).alias("c"))))), lambda x: x["c"])  # ``last`` texts at most
    one = marked.groupBy("_row", "query_id").agg(*flags, F.first("_terms").alias("_terms"), texts.alias("_texts"))
    return one.withColumn(f"expected_terms_hit_{last}", expects_terms(F.col("_texts"), F.col("_terms")).cast("int")).drop("_row", "_terms", "_texts")


def mean_flags(flags: DataFrame, columns: list[str]) -> DataFrame:
    """Means of 0/1 flags; 0.0 without rows."""
    return flags.agg(F.count("*").alias("questions"), *(F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 6).alias(c) for c in columns))


def delta(current: DataFrame, baseline: DataFrame, key: str, metric: str) -> DataFrame:
    """Current metrics beside the baseline's and their difference; null where the baseline has none."""
    b = baseline.select(key, F.col(metric).alias("baseline"))
    return current.join(b, key, "left").select(key, F.col(metric).alias("current"), "baseline", F.round(F.col(metric) - F.col("baseline"), 6).alias("delta"))
