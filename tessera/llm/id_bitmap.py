"""Bitmaps over ids: a pass over the texts finds the rows it needs without shuffling texts or broadcasting ids.

An id of the table is always found; another one is by chance, so whoever asks
must bear such rows or join them away. A bitmap has at most MOST_BITS bits,
whatever the table's size: more ids only mean more that are found by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shingles import mix
from tessera.storage import map_arrow

#: Bits of a bitmap at most (4 MB), and for each id as long as there is room.
MOST_BITS, BITS_PER_ID = 1 << 25, 32


def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = mix(ids.astype(np.int64).view(np.uint64))
    return m & np.uint64(bits - 1), (m >> np.uint64(32)) & np.uint64(bits - 1)


def has(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """True for each id of the table, and for others by chance."""
    one, two = (bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) for p in _places(ids, 64 * len(bitmap)))
    return (one & two & np.uint64(1)).astype(bool)


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """The bitmap, as uint64 words, of a table with the one column id (long, no nulls)."""
    bits, n = 64, ids.count()
    while bits < min(BITS_PER_ID * n, MOST_BITS):
        bits *= 2

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.unique(np.concatenate(_places(batch.column(0).to_numpy(), bits)))
            if len(p):
                words, starts = np.unique(p >> np.uint64(6), return_index=True)
                mark = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), starts)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(mark.view(np.int64))], ["word", "mark"])

    found = map_arrow(ids, marks, "word long, mark long").groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("mark").to_numpy().view(np.uint64)
    return out


def found_in(bitmap: np.ndarray, ids: DataFrame) -> DataFrame:
    """The ids that ``has`` finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has(bitmap, batch.column(0).to_numpy())))

    return map_arrow(ids, run, "id long")
