"""Substring deduplication by line hashing.

The units are lines, and the sentences of lines that have several. A unit is
normalised (lower case, single blanks) and hashed to 128 bits; the digests are
grouped over all documents, the occurrence of the lowest document id stays,
and the others are removed with their original offsets on record. Units of
fewer than ``min_words`` words don't count, and neither do repeats that make a
run of fewer than ``min_run`` words: a short sentence or heading that recurs
alone is no copied passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import map_arrow, materialize

SENTENCE_END = re.compile(r"(?<=[.!?])[ \t]+")
#: Characters between two repeated units that still belong to one run: a line break, or a sentence too short to count.
GAP = 40
_HALF, _SIGN, _ALL = (1 << 64) - 1, 1 << 63, 1 << 64


def units(text: str, min_words: int) -> Iterator[tuple[int, int, int, int]]:
    """(digest, start, end, words) of a text's units in order; an end takes in the blanks or line break that follow."""
    at = 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        words = line.lower().split()
        if len(words) >= min_words:
            yield xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass")), at, end, len(words)
            cuts = [m.end() for m in SENTENCE_END.finditer(line)]
            if cuts:
                for a, b in zip([0, *cuts], [*cuts, len(line)], strict=True):
                    words = line[a:b].lower().split()
                    if len(words) >= min_words:
                        yield xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass")), at + a, at + b, len(words)
        at += len(line) + 1


def _signed(x: int) -> int:
    return x - _ALL if x >= _SIGN else x


def _occurrences(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, hi, lo, starts, ends, counts, again = [], [], [], [], [], [], [], []
            for key, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                seen = set()
                for digest, a, b, n in units(text.as_py() or "", min_words):
                    ids.append(key), rows.append(row), hi.append(_signed(digest >> 64)), lo.append(_signed(digest & _HALF)), starts.append(a), ends.append(b), counts.append(n)
                    again.append(digest in seen)
                    seen.add(digest)
            long = [pa.array(x, pa.int64()) for x in (ids, rows, hi, lo, starts, ends, counts)]
            yield pa.RecordBatch.from_arrays([*long, pa.array(again, pa.bool_())], ["id", "row", "hi", "lo", "start", "end", "words", "again"])

    return run


def _row(text: Column) -> Column:
    """With the id, what a row is told by: rows that agree in both hold the same text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def repeated_spans(docs: DataFrame, *, min_words: int = 5, min_run: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, removed): of each row that loses text its spans (start, end) in code points, ordered, not overlapping.

    ``row`` is the hash of its text, so versions of one id lose their own spans.
    """
    source = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), _row(docs[text_col]).alias("row"), docs[text_col].cast("string").alias("text"))
    found = materialize(map_arrow(source, _occurrences(min_words), "id long, row long, hi long, lo long, start long, end long, words long, again boolean"), "units")
    once = found.where("NOT again")
    owner = F.struct("id", "row")
    first = once.groupBy("hi", "lo").agg(F.min(owner).alias("first"), F.max(owner).alias("last")).where("first < last").select("hi", "lo", "first")
    later = once.join(first, ["hi", "lo"]).where(owner != F.col("first"))
    lost = later.select("id", "row", "start", "end", "words").union(found.where("again").select("id", "row", "start", "end", "words"))
    # wider units first, so that a line comes before its sentences
    ordered = F.sort_array(F.collect_set(F.struct("start", F.negate("end").alias("low"), "words")))
    spans = "array<struct<start:bigint,end:bigint>>"
    zero = F.expr(f"named_struct('out', cast(array() as {spans}), 'run', cast(array() as {spans}), 'words', 0L, 'at', 0L)")

    def close(acc: Column) -> Column:
        return F.when(acc["words"] >= min_run, F.concat(acc["out"], acc["run"])).otherwise(acc["out"])

    def step(acc: Column, s: Column) -> Column:
        span, end = F.array(F.struct(s["start"].alias("start"), F.negate(s["low"]).alias("end"))), F.negate(s["low"])
        near = s["start"] - acc["at"] <= GAP
        further = F.struct(acc["out"].alias("out"), F.concat(acc["run"], span).alias("run"), (acc["words"] + s["words"]).alias("words"), end.alias("at"))
        anew = F.struct(close(acc).alias("out"), span.alias("run"), s["words"].alias("words"), end.alias("at"))
        return F.when(end <= acc["at"], acc).when(near, further).otherwise(anew)

    return lost.groupBy("id", "row").agg(ordered.alias("s")).select("id", "row", F.aggregate("s", zero, step, close).alias("removed")).where("size(removed) > 0")


def without(text, spans):
    """The text without the characters of ordered, disjoint spans."""
    count = F.size(spans)
    kept = F.transform(
        F.sequence(F.lit(0), count),
        lambda i: F.substring(
            text,
            (F.when(i == 0, F.lit(0)).otherwise(F.get(spans, F.greatest(i - 1, F.lit(0)))["end"]) + 1).cast("int"),
            (F.when(i == count, F.length(text).cast("long")).otherwise(F.get(spans, i)["start"]) - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(spans, F.greatest(i - 1, F.lit(0)))["end"])).cast("int"),
        ),
    )
    return F.array_join(kept, "")


def drop_repeats(docs: DataFrame, *, min_words: int = 5, min_run: int = 20, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed") -> DataFrame:
    """``docs`` without repeated units in ``text_col``, and their original spans in ``removed_col``.

    The earliest occurrence is that of the smallest id, then of the smallest
    offset. Rows with equal id and text are one document and fare alike; rows
    of an id with different texts are told apart and each loses its own spans
    (among them one, whichever by its hash, counts as the earlier). A null text
    stays null; rows with a null id are returned as they are. A column named
    like ``removed_col`` is replaced, all others may have any name; an empty
    table gives an empty table.
    """
    names = [c for c in docs.columns if c != removed_col]
    spans = repeated_spans(docs, min_words=min_words, min_run=min_run, id_col=id_col, text_col=text_col)
    # by place, so that no name can clash
    own = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)), docs[id_col].cast("long").alias("id"), _row(docs[text_col]).alias("row"))
    joined = own.join(spans, ["id", "row"], "left")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    text = F.col(f"c{names.index(text_col)}")
    cleaned = F.when(F.col("removed").isNull(), text).otherwise(without(text, F.col("removed")))
    kept = [cleaned if c == text_col else F.col(f"c{i}") for i, c in enumerate(names)]
    return joined.select(*kept, F.coalesce("removed", none)).toDF(*names, removed_col)


def dedup_report(docs: DataFrame, *, min_words: int = 5, min_run: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_removed, chars_removed, removed (start:end, comma-joined), kept_sha256."""
    made = drop_repeats(docs.select(id_col, text_col), min_words=min_words, min_run=min_run, id_col=id_col, text_col=text_col)
    return made.select(
        id_col, F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("chars_removed"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("removed"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("kept_sha256"),
    )
