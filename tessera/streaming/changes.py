"""Streams: hash change detection, batched ingestion, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class LastHash(StatefulProcessor):
    """Per url the last hash seen; emits a row for each change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("hash", "hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get()[0] if self.state.exists() else None
        out = []
        for frame in rows:
            for h in frame.sort_values("seq")["content_hash"]:
                if h != old:
                    out.append((key[0], "new" if old is None else "changed", h))
                    old = h
        if old is not None:
            self.state.update((old,))
        yield pd.DataFrame(out, columns=["url", "change", "content_hash"])

    def close(self) -> None:
        pass


def changed(stream: DataFrame) -> DataFrame:
    """(url, change, content_hash) from a stream (url, content_hash, seq); needs the RocksDB state store."""
    return stream.groupBy("url").transformWithStateInPandas(LastHash(), outputStructType="url string, change string, content_hash string", outputMode="Append", timeMode="None")


def ingest_in_batches(stream: DataFrame, target: str, checkpoint: str, transform=lambda df: df):
    """Append each micro-batch, transformed, to the store, until the input that is there is used up."""

    def write(batch: DataFrame, _: int) -> None:
        transform(batch).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, *, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in event-time windows; later events than ``late`` are dropped on a stream. Works on batches too."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, n) of runs of events without a longer pause than ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    made = timed.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return made.select("user_id", F.col("s.start").alias("session_start"), "n")
