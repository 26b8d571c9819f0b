"""Sinks: the chunk store, rebuilt indexes, failure logs and plain lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.html import failures


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    """A deterministic chunk_id from source, position and content, so a repeated run writes the same ids."""
    key = F.concat_ws("\x1f", F.coalesce("source", F.lit("")), F.col("pos").cast("string"), F.coalesce("content", F.lit("")))
    return chunks.withColumn("chunk_id", F.sha2(key, 256))


def write_store(chunks: DataFrame, path: str, *, clear: bool = False) -> None:
    """Append to the store or replace it; an empty batch is an error."""
    if chunks.isEmpty():
        raise ValueError("no chunks to write")
    chunks.write.mode("overwrite" if clear else "append").parquet(path)


def rebuild(chunks: DataFrame, target: str, main: str) -> None:
    """Write a derived index; never onto the main store."""
    if target.rstrip("/") == main.rstrip("/"):
        raise ValueError("the target is the main store")
    chunks.write.mode("overwrite").parquet(target)


def write_failures(errors: DataFrame, path: str) -> None:
    failures(errors).write.mode("overwrite").json(path)


def write_urls(urls: DataFrame, path: str) -> None:
    urls.select("url").distinct().write.mode("overwrite").text(path)
