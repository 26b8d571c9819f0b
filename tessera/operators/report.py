"""Coverage, inventory, health and access reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import falsy, normalize_discovery, normalize_filter

UNKNOWN_SOURCE = "Bilinmeyen Kaynak"


def source_inventory(chunks: DataFrame) -> DataFrame:
    """(source, chunks, title, source_type) by source, largest first; first non-empty title and known type by chunk_id."""
    known = F.when(falsy(F.col("source_type"), "unknown") != "unknown", F.col("source_type"))
    named = F.nullif(F.col("title"), F.lit(""))
    return (
        chunks.groupBy(falsy(F.col("source"), UNKNOWN_SOURCE).alias("source"))
        .agg(F.count("*").alias("chunks"), F.min_by(named, F.when(named.isNotNull(), F.col("chunk_id"))).alias("title"), F.coalesce(F.min_by(known, F.when(known.isNotNull(), F.col("chunk_id"))), F.lit("unknown")).alias("source_type"))
        .orderBy(F.desc("chunks"), F.lower("source"))
    )


def coverage(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, chunks) by each column in one pass of grouping sets; empty values are skipped but for the first column, with the total."""
    sets = ", ".join(f"({c})" for c in columns)
    value = F.coalesce(*(F.col(c).cast("string") for c in columns))
    view = chunks.select(*(F.col(c).cast("string").alias(c) for c in columns))
    dimension = "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in columns) + " ELSE 'total' END"
    made = view.sparkSession.sql(f"SELECT {', '.join(columns)}, count(*) AS chunks, {dimension} AS dimension FROM {{v}} GROUP BY GROUPING SETS ({sets}, ())", v=view)
    out = made.select("dimension", value.alias("value"), "chunks")
    return out.where((F.col("dimension").isin("total", columns[0])) | (F.coalesce("value", F.lit("")) != ""))


def health(chunks: DataFrame | None, exists: bool = True) -> DataFrame:
    """One row: chunks, sources, status (missing, empty or ok)."""
    if chunks is None:
        raise ValueError("a missing store has no rows to report on; pass an empty table")
    status = F.when(~F.lit(exists), "missing").when(F.count("*") == 0, "empty").otherwise("ok")
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("sources"), status.alias("status"))


def article_stats(articles: DataFrame, *, key: str = "source") -> DataFrame:
    """Per source: chunk_count, distinct article numbers and the first ten of them in order of first appearance."""
    firsts = articles.groupBy(key, "article_no").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    numbers = F.transform(F.sort_array(F.collect_list(F.struct("pos", "article_no"))), lambda x: x["article_no"])
    return firsts.groupBy(key).agg(F.sum("n").alias("chunk_count"), F.count("*").alias("article_count"), F.array_join(F.slice(numbers, 1, 10), ",").alias("first_articles"), F.sum((F.col("n") > 1).cast("long")).alias("duplicate_numbers"))


def missing_from(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """Manifest rows whose url isn't an indexed source."""
    return manifest.join(index.select(F.col("source").alias("url")).distinct(), "url", "left_anti")


def expected_urls(urls: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, matches, urls): urls that hold min(2, number of keywords) keywords, the first ten by url; no keywords match all.

    ``expected`` is a small stated list and goes to every row.
    """
    hits = F.size(F.filter("keywords", lambda k: F.contains(normalize_discovery(F.col("url")), normalize_discovery(k))))
    met = urls.select("url").crossJoin(F.broadcast(expected.select("id", "keywords"))).where(hits >= F.least(F.lit(2), F.size("keywords")))
    counted = met.groupBy("id").agg(F.count("*").alias("matches"), F.array_join(F.slice(F.sort_array(F.collect_set("url")), 1, 10), " ").alias("urls"))
    return expected.select("id").join(counted, "id", "left").select("id", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), F.coalesce("urls", F.lit("")).alias("urls"))


def expected_coverage(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, found): whether every keyword occurs somewhere in the sources or titles; no keywords are never found.

    Each keyword is tested on its own with an aggregate, so no joined haystack is built.
    """
    words = F.broadcast(expected.select("id", F.explode("keywords").alias("k")).distinct())
    text = normalize_discovery(F.concat_ws(" ", "source", "title"))
    seen = chunks.select(text.alias("t")).distinct().crossJoin(words).where(F.contains(F.col("t"), normalize_discovery(F.col("k")))).select("id", "k").distinct()
    counts = seen.groupBy("id").agg(F.count("*").alias("n"))
    joined = expected.join(counts, "id", "left")
    return joined.select("id", ((F.size("keywords") > 0) & (F.coalesce("n", F.lit(0)) >= F.least(F.lit(2), F.size(F.array_distinct("keywords"))))).alias("found"))


def matches_filters(source: Column, titles: Column, source_contains: list[str], title_contains: list[str]) -> Column:
    """Any of a list must occur, for both lists; an empty list passes."""
    any_of = lambda x, words: reduce(lambda a, b: a | b, (F.contains(normalize_filter(x), normalize_filter(F.lit(w))) for w in words)) if words else F.lit(True)
    return any_of(source, source_contains) & any_of(titles, title_contains)


def source_class(active: Column, requires_permission: Column) -> Column:
    """active, authorized_only or inactive; a missing active flag is true."""
    return F.when(F.coalesce(active, F.lit(True)), "active").when(F.coalesce(requires_permission, F.lit(False)), "authorized_only").otherwise("inactive")


def access(rows: DataFrame) -> DataFrame:
    """Adds can_fetch and blocked_by (inactive, requires_permission, robots or none) by the first rule that blocks.

    Columns: active, requires_permission, include_inactive, authorized_mode,
    robots_override, robots_allowed. Unknown robots pass; robots block only if
    told to, and not for authorised sources with both mode and override on.
    """
    c = F.col
    lawful = F.coalesce("requires_permission", F.lit(False))
    waved = c("authorized_mode") & c("robots_override")
    blocked = (
        F.when(~F.coalesce("active", F.lit(True)) & ~c("include_inactive"), "inactive")
        .when(lawful & ~c("authorized_mode"), "requires_permission")
        .when((c("robots_allowed") == F.lit(False)) & ~waved, "robots")
        .otherwise("none")
    )
    return rows.withColumn("blocked_by", blocked).withColumn("can_fetch", F.col("blocked_by") == "none")


def access_totals(decided: DataFrame) -> DataFrame:
    return decided.agg(F.count("*").alias("sources"), F.count_if("can_fetch").alias("can_fetch"), F.count_if(~F.col("can_fetch")).alias("blocked"))
