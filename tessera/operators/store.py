"""The chunk store: tall metadata, change detection, state, deletes, deduplication and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import vocab


def typed_value() -> Column:
    """First of the string, integer, float and boolean value of a metadata row that isn't null, as text."""
    return F.coalesce("string_value", F.col("int_value").cast("string"), F.col("float_value").cast("string"), F.col("bool_value").cast("string"))


def pivot_metadata(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per id of rows (id, key, *_value), a column per key; a missing key is null."""
    return rows.groupBy("id").agg(*(F.max(F.when(F.col("key") == k, typed_value())).alias(k) for k in keys))


def metadata_map(rows: DataFrame) -> DataFrame:
    """(id, metadata): all keys of an id as a map; of a repeated key the largest value."""
    flat = rows.groupBy("id", "key").agg(F.max(typed_value()).alias("v"))
    return flat.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "v")))).alias("metadata"))


def join_sides(metadata: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of either side; a missing document is the empty text."""
    return metadata.join(documents, "id", "full").withColumn("document", F.coalesce("document", F.lit("")))


def classify_changes(current: DataFrame, state: DataFrame) -> DataFrame:
    """Adds change to (url, content_hash): new, changed or same against state (url, content_hash); a null stored hash is a change."""
    old = state.select("url", F.col("content_hash").alias("_old"), F.lit(True).alias("_known"))
    kind = F.when(F.col("_known").isNull(), "new").when(F.col("_old") == F.col("content_hash"), "same").otherwise("changed")
    return current.join(old, "url", "left").withColumn("change", kind).drop("_old", "_known")


def upsert(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """State rows replaced by incoming ones on url; an incoming null hash keeps the stored one.

    Both hold (url, status, crawled_at, content_hash, seq); of several incoming
    rows of a url the highest seq counts.
    """
    both = state.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    order = F.struct("_new", "seq")
    return both.groupBy("url").agg(
        F.max_by("status", order).alias("status"), F.max_by("crawled_at", order).alias("crawled_at"),
        F.max_by("content_hash", F.when(F.col("content_hash").isNotNull(), order)).alias("content_hash"), F.max_by("seq", order).alias("seq"),
    )


def apply_changes(store: DataFrame, changes: DataFrame, docs: DataFrame, *, strict: bool = False) -> DataFrame:
    """The store after a crawl: rows of new and changed urls are replaced by the crawled documents.

    Only rows whose source is the url go; rows that came from documents linked
    on the page stay, unless ``strict`` and their parent column names the url.
    """
    moved = changes.where("change <> 'same'").select(F.col("url").alias("source"))
    kept = store.join(moved, "source", "left_anti")
    if strict and "parent" in store.columns:
        kept = kept.join(moved.withColumnRenamed("source", "parent"), "parent", "left_anti").select(*store.columns)
    fresh = docs.join(moved, "source", "left_semi").select(*store.columns)
    return kept.select(*store.columns).unionByName(fresh)


def purge_failed(store: DataFrame, state: DataFrame, failed: DataFrame, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(store, state) without the rows of failed urls that were stored; their state is error and keeps its hash (``strict`` clears it)."""
    gone = failed.select("url").distinct().join(store.select(F.col("source").alias("url")).distinct(), "url", "left_semi").withColumn("_gone", F.lit(True))
    marked = state.join(gone, "url", "left")
    hash_ = F.when(F.col("_gone"), F.lit(None).cast("string")).otherwise(F.col("content_hash")) if strict else F.col("content_hash")
    new_state = marked.withColumn("status", F.when(F.col("_gone"), "error").otherwise(F.col("status"))).withColumn("content_hash", hash_).drop("_gone")
    return store.join(gone.select(F.col("url").alias("source")), "source", "left_anti"), new_state


def keep_first(rows: DataFrame, by: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedup_exact(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The smallest id of each text, compared by digest: minima are pre-aggregated, so a text with many copies is no hot group."""
    firsts = docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash")).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))
    return firsts.select(id_col, "content_hash", "copies")


def dedup_composite(rows: DataFrame, *, chars: int = 120) -> DataFrame:
    """The first row of each (source, page, first characters)."""
    return rows.groupBy("source", "page", F.left(F.coalesce("text", F.lit("")), F.lit(chars)).alias("head")).agg(F.min("doc_id").alias("doc_id"))


def stale(rows: DataFrame, now: str, *, days: int = 30) -> DataFrame:
    """Rows of an expiring type whose crawled_at is more than ``days`` whole days before ``now``; parts of a second count, unparseable ones aren't stale."""
    micros = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("crawled_at").try_cast("timestamp"))
    return rows.where(F.col("doc_type").isin(*vocab.EXPIRING_TYPES) & (micros >= (days + 1) * 86_400_000_000))


def maintain(rows: DataFrame, now: str, *, days: int = 30, id_col: str = "doc_id") -> DataFrame:
    """Rows that are neither later copies of a text nor stale."""
    firsts = dedup_exact(rows, id_col=id_col).select(id_col)
    return rows.join(firsts, id_col, "left_semi").join(stale(rows, now, days=days).select(id_col), id_col, "left_anti")
