"""Chunking: header sections, routes by length, recursive and semantic splits."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import map_arrow

SENTENCE_END = re.compile(r"(?<=[.?!])\s+", re.ASCII)
SEPARATORS = ("\n## ", "\n### ", "\n\n", "\n", ". ", " ")


def header_sections(docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, section, header_1, header_2, header_3, content): a section per Markdown header, which stays in the body.

    A header of a higher level resets the deeper ones. Text before the first
    header is a section of its own; blank sections go.
    """
    lines = docs.select(F.col(key), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ln", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,3}) +\S", 1))
    w = Window.partitionBy(key).orderBy("ln")
    marked = lines.withColumn("level", level).withColumn("title", F.trim(F.regexp_replace("line", r"^#{1,3} +", ""))).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w))
    # the last header of each level counts unless a higher one came after it
    for k in (1, 2, 3):
        marked = marked.withColumn(f"at_{k}", F.max(F.when(F.col("level") == k, F.col("ln"))).over(w)).withColumn(f"t_{k}", F.last(F.when(F.col("level") == k, F.col("title")), ignorenulls=True).over(w))
    h2 = F.when(F.col("at_2") > F.coalesce("at_1", F.lit(-1)), F.col("t_2"))
    h3 = F.when(F.col("at_3") > F.greatest(F.coalesce("at_1", F.lit(-1)), F.coalesce("at_2", F.lit(-1))), F.col("t_3"))
    named = marked.select(key, "section", "ln", "line", F.col("t_1").alias("header_1"), h2.alias("header_2"), h3.alias("header_3"))
    made = named.groupBy(key, "section").agg(F.max("header_1").alias("header_1"), F.max("header_2").alias("header_2"), F.max("header_3").alias("header_3"), F.sort_array(F.collect_list(F.struct("ln", "line"))).alias("ls"))
    body = F.regexp_replace(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    return made.select(key, "section", "header_1", "header_2", "header_3", body.alias("content")).where("content <> ''")


def section_route(length):
    """semantic above 3000 characters, recursive above 1000, keep above 50, else drop."""
    return F.when(length > 3000, "semantic").when(length > 1000, "recursive").when(length > 50, "keep").otherwise("drop")


def split_recursive(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters at the coarsest separators that do, merged greedily with an overlap.

    Separators stay at the front of the piece they open. A run without any
    separator is kept whole, however long.
    """
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    raw = re.split(f"(?={re.escape(mark)})", text) if mark in text else [text]
    out: list[str] = []
    run: list[str] = []
    for part in (p for p in raw if p):
        if len(part) < size:
            run.append(part)
            continue
        out += _merge(run, size, overlap)
        run = []
        out += split_recursive(part, size, overlap, finer) if finer else [part.strip()]
    return [p for p in out + _merge(run, size, overlap) if p]


def _merge(parts: list[str], size: int, overlap: int) -> list[str]:
    out, window, total = [], [], 0
    for p in parts:
        if window and total + len(p) > size:
            out.append("".join(window).strip())
            while window and (total > overlap or total + len(p) > size):
                total -= len(window.pop(0))
        window.append(p)
        total += len(p)
    return [*out, "".join(window).strip()] if window else out


def recursive_chunks(docs: DataFrame, *, key: str = "doc_id", size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, pos, content) of every text, by greedy merging in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, c) for k, t in zip(f[key], f["text"], strict=True) for i, c in enumerate(split_recursive(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "pos", "content"])

    return docs.select(F.col(key).cast("long").alias(key), "text").mapInPandas(run, f"{key} long, pos int, content string")


def sentence_vectors(sentences: list[str], start: int, stop: int, *, buckets: int = 64) -> np.ndarray:
    """A deterministic stand-in for an embedding model: hashed word counts of each of sentences[start:stop] and its neighbours."""
    first, last = max(start - 1, 0), min(stop + 1, len(sentences))
    words = [s.lower().encode().split() for s in sentences[first:last]]
    hashed = np.fromiter((xxhash.xxh64_intdigest(w, 42) for ws in words for w in ws), np.uint64).view(np.int64) % buckets
    place = np.repeat(np.arange(1, len(words) + 1), [len(ws) for ws in words])
    own = np.bincount(place * buckets + hashed, minlength=(len(words) + 2) * buckets).reshape(-1, buckets).astype(np.float64)
    return (own[:-2] + own[1:-1] + own[2:])[start - first : stop - first]


def _cosines(v: np.ndarray) -> np.ndarray:
    """Of each row but the first the cosine to the row before; not a number beside a row of zeros."""
    norms = np.sqrt((v * v).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return (v[:-1] * v[1:]).sum(axis=1) / (norms[:-1] * norms[1:])


def split_semantic(text: str, *, percentile: float = 0.95, vectors: Callable[[list[str], int, int], np.ndarray] = sentence_vectors, block: int = 4096) -> list[str]:
    """Runs of sentences, cut where the distance to the next exceeds the percentile (interpolated) of the text's distances.

    Vectors are made for ``block`` sentences at a time, whatever the text's length.
    """
    sentences = SENTENCE_END.split(text)
    if len(sentences) < 2:
        return sentences
    apart = 1 - np.concatenate([_cosines(np.asarray(vectors(sentences, max(a - 1, 0), min(a + block, len(sentences))), np.float64)) for a in range(0, len(sentences), block)])
    known = np.sort(apart[~np.isnan(apart)])
    if not len(known):
        return [" ".join(sentences)]
    at = (len(known) - 1) * percentile
    low, high = known[int(at)], known[int(np.ceil(at))]
    limit = low if low == high else (np.ceil(at) - at) * low + (at - int(at)) * high
    cuts = [0, *(np.flatnonzero(apart > limit) + 1).tolist(), len(sentences)]
    return [" ".join(sentences[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def semantic_chunks(docs: DataFrame, *, key: str = "doc_id", percentile: float = 0.95, vectors: Callable[[list[str], int, int], np.ndarray] = sentence_vectors) -> DataFrame:
    """(key, pos, content) of every text by ``split_semantic``, in Arrow batches; no shuffle, as a text is one row.

    ``vectors`` gives the rows start to stop of the matrix of a text's
    sentences; any model can stand there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [split_semantic(t.as_py() or "", percentile=percentile, vectors=vectors) for t in b.column(1)]
            each = np.array([len(x) for x in made], np.int64)
            keys = b.column(0).take(pa.array(np.repeat(np.arange(len(made)), each)))
            pos = np.arange(each.sum()) - np.repeat(each.cumsum() - each, each)
            yield pa.RecordBatch.from_arrays([keys, pa.array(pos, pa.int32()), pa.array([c for x in made for c in x], pa.string())], [key, "pos", "content"])

    return map_arrow(docs.select(F.col(key).cast("long").alias(key), "text"), run, f"{key} long, pos int, content string")
