"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards of bounded size by a hash of their id. The queries
meet every shard in blocks, in waves of shards, each some times as large as the
one before. A task reads its shards and blocks from the shared folder, so pairs
of them are neither shuffled nor broadcast, and the driver holds none. After
each wave the k-th score of every query over all shards so far travels with it
into the next: a node is opened only for the queries whose upper bound
q.c + |q|r reaches their current k-th score, and a leaf is multiplied with all
of these at once. Scores are exact integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import Scratch, map_arrow, materialize

LEAF = 128
#: Vectors in a shard and queries in a block, on average.
SHARD_ROWS, BLOCK_ROWS = 16384, 1024
#: Shards of the first wave, and times by which a wave grows.
FIRST, WAVE = 4, 4
#: Candidates of a block that wait until its k-th scores are raised.
PENDING = 1 << 16
#: Up to this product bound, float64 arithmetic on whole numbers is exact.
EXACT = 2.0**52


def build_tree(ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a ball tree: rows in leaf order, and of each node its rows, children, centre, radius and smallest id."""
    order = np.arange(len(ids))
    lo, hi, left, right, centre, radius, first = [], [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        rows = x[order[a:b]]
        c = rows.mean(axis=0)
        d = np.sqrt(((rows - c) ** 2).sum(axis=1))
        k = len(lo)
        lo.append(a), hi.append(b), left.append(-1), right.append(-1), centre.append(c), radius.append(d.max()), first.append(ids[order[a:b]].min())
        if b - a > LEAF and radius[k] > 0:
            far = rows[int(d.argmax())]
            other = rows[int(((rows - far) ** 2).sum(axis=1).argmax())]
            along = np.argsort(rows @ (other - far), kind="stable")
            order[a:b] = order[a:b][along]
            mid = (a + b) // 2
            left[k] = node(a, mid)
            right[k] = node(mid, b)
        elif b - a > LEAF:  # equal vectors: only the smallest ids can win
            order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
        return k

    if len(ids):
        node(0, len(ids))
    return {"ids": ids[order], "x": x[order], "lo": np.array(lo, int), "hi": np.array(hi, int), "left": np.array(left, int), "right": np.array(right, int), "c": np.array(centre), "r": np.array(radius), "first": np.array(first)}


def search_tree(tree: dict[str, np.ndarray], query_id: int, q: np.ndarray, bounds: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
    """(score, -id) of the shard's best k for one query, of those that reach ``floor``."""
    best: list[tuple[int, int]] = []
    heap = [(-bounds[0], 0)] if len(bounds) else []
    while heap:
        bound, i = heapq.heappop(heap)
        kth = best[0][0] if len(best) == k else floor
        if -bound < kth:
            break
        if len(best) == k and tree["r"][i] == 0 and -bound < kth + 0.5 and tree["first"][i] > -best[0][1]:
            continue
        if tree["left"][i] >= 0:
            for child in (tree["left"][i], tree["right"][i]):
                if bounds[child] >= kth:
                    heapq.heappush(heap, (-bounds[child], child))
            continue
        rows = _of_leaf(tree, i, k)
        ids = tree["ids"][rows]
        scores = _products(tree["x"][rows], q)
        for s, v in zip(scores, ids.tolist(), strict=True):
            item = (s, -v)
            if v == query_id or s < floor:
                continue
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
    return best


def _of_leaf(tree: dict[str, np.ndarray], i: int, k: int) -> np.ndarray:
    """The leaf's rows that can be among a query's best k: of equal vectors the smallest ids, enough of them besides the query's own."""
    rows = np.arange(tree["lo"][i], tree["hi"][i])
    if tree["r"][i] or len(rows) <= 2 * k:
        return rows
    rows = rows[np.argsort(tree["ids"][rows], kind="stable")]
    ids = tree["ids"][rows]
    return rows[np.arange(len(ids)) - np.searchsorted(ids, ids) < k][: 2 * k]


def _products(x: np.ndarray, q: np.ndarray) -> list[int]:
    if len(x) and np.abs(x).max() * max(np.abs(q).max(), 1) * len(q) < EXACT:
        return [int(s) for s in x @ q]
    whole = [int(v) for v in q]
    return [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x]


def _best(which: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties to the smaller id, in order of the queries."""
    order = np.lexsort((ids, -scores, which))
    own = which[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def search_block(tree: dict[str, np.ndarray], query_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, score, id) of the shard's best k for each query, of those that reach its floor; all products are below ``EXACT``."""
    kth = floors.copy()
    held = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]
    waiting: list[list[np.ndarray]] = []
    count, least = 0, 2 * k * len(q)
    stack = [(0, np.arange(len(q)))]
    while stack:
        i, some = stack.pop()
        some = some[bounds[some, i] >= kth[some]]
        if not len(some):
            continue
        if tree["left"][i] >= 0:  # the child that promises more goes first
            children = sorted((tree["left"][i], tree["right"][i]), key=lambda c: bounds[some, c].mean())
            stack += [(c, some) for c in children]
            continue
        rows = _of_leaf(tree, i, k)
        scores = q[some] @ tree["x"][rows].T
        at, col = np.nonzero(scores >= kth[some][:, None])
        which, ids = some[at], tree["ids"][rows[col]]
        other = ids != query_ids[which]
        waiting.append([which[other], scores[at, col][other], ids[other]])
        count += len(at)
        if count >= min(PENDING, least):
            held, waiting, count = _raised(held, waiting, kth, k), [], 0
    return tuple(_raised(held, waiting, kth, k))


def _raised(held: list[np.ndarray], waiting: list[list[np.ndarray]], kth: np.ndarray, k: int) -> list[np.ndarray]:
    """What is left of held and waiting candidates; the k-th scores rise in place."""
    which, scores, ids = (np.concatenate(x) for x in zip(held, *waiting, strict=True))
    keep = _best(which, scores, ids, k)
    which, scores, ids = which[keep], scores[keep], ids[keep]
    last = np.flatnonzero(np.bincount(which, minlength=len(kth)) == k)
    ends = np.searchsorted(which, last, "right") - 1
    kth[last] = np.maximum(kth[last], scores[ends])
    return [which, scores, ids]


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers row by row in the narrowest type that holds all."""
    most = np.abs(x).max(initial=0)
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8").tobytes()


def _unpacked(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, {2: "<i2", 4: "<i4", 8: "<f8"}[len(data) // (rows * dim)]).astype(np.float64).reshape(rows, dim)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple, dict] | None = None
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(name)[row] for name in batch.schema.names}
                dim, key = at["dim"].as_py(), (at["shard"].as_py(), at["dim"].as_py())
                if dim != at["q_dim"].as_py():
                    continue
                if held is None or held[0] != key:
                    ids = at["ids"].values.to_numpy(zero_copy_only=False)
                    held = key, build_tree(ids, _unpacked(at["xs"].as_py(), len(ids), dim))
                tree = held[1]
                query_ids, floors = (at[c].values.to_numpy(zero_copy_only=False) for c in ("query_ids", "floors"))
                q = _unpacked(at["qs"].as_py(), len(query_ids), dim)
                norms = np.sqrt((q * q).sum(axis=1))
                bounds = q @ tree["c"].T + norms[:, None] * tree["r"][None, :]
                bounds += 1e-9 * (np.abs(bounds) + norms[:, None] * (np.sqrt((tree["c"] ** 2).sum(axis=1)) + tree["r"])[None, :]) + 1e-6
                bounds = np.nan_to_num(bounds, nan=np.inf, posinf=np.inf)  # beyond double: no bound
                if np.abs(tree["x"]).max() * max(np.abs(q).max(), 1) * dim < EXACT:
                    which, scores, ids = search_block(tree, query_ids, q, bounds, k, floors)
                    out = [query_ids[which], ids, scores.astype(np.int64)]
                else:
                    found = [(int(qid), -v, s) for i, qid in enumerate(query_ids) for s, v in search_tree(tree, int(qid), q[i], bounds[i], k, float(floors[i]))]
                    if any(not -(1 << 63) <= s < 1 << 63 for _, _, s in found):
                        raise OverflowError("an inner product doesn't fit into 64 bits")
                    out = [np.array([x[c] for x in found], np.int64) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    return run


def _shard(frame: pd.DataFrame) -> pd.DataFrame:
    order = frame.sort_values("vec_id")
    return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "dim": [frame["dim"].iloc[0]], "ids": [order["vec_id"].tolist()], "xs": [_packed(_matrix(order["v"]))]})


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    order = frame.sort_values("query_id")
    return pd.DataFrame({"q_dim": [frame["dim"].iloc[0]], "query_ids": [order["query_id"].tolist()], "qs": [_packed(_matrix(order["v"]))], "floors": [order["floor"].tolist()]})


def exact_topk(vectors: DataFrame, *, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by ``every`` the k best others.

    Components become floor(scale * x); the score is their integer inner
    product, ties go to the smaller id. Fewer than k other vectors: all of
    them. Rows with a null id, a null or empty vector, or a null or non-finite
    component take no part. Vectors of another dimension are no candidates.
    Every row is a candidate, so an id that repeats can take several ranks; it
    is no candidate of its own id, and as a query its rows share one list of k.
    A score that doesn't fit into 64 bits raises an error, as does a component
    beyond the range of double once scaled. Other columns are ignored; an empty
    table gives an empty table.
    """
    x = vectors[vector_col]

    def whole(e: Column) -> Column:
        v = e.cast("double") * scale  # from 2**52 on every double is whole
        fine = F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)
        return F.when(F.abs(v) < float("inf"), fine).otherwise(F.raise_error(F.lit("a scaled component is beyond the range of double")).cast("double"))

    finite = F.forall(x, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf")))
    rows = vectors.where(vectors[id_col].isNotNull() & (F.size(x) > 0) & finite).select(vectors[id_col].cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))
    with Scratch(vectors.sparkSession) as write:
        return materialize(_ranked(write(rows.withColumn("dim", F.size("v")), "vectors"), every, k, write), "topk")


def _ranked(rows: DataFrame, every: int, k: int, write: Scratch) -> DataFrame:
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS))
    blocks = max(1, -(-total // every // BLOCK_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    trees = write(dealt.groupBy("shard", "dim").applyInPandas(_shard, "shard int, dim int, ids array<long>, xs binary"), "shards")
    asking = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    queries = write(asking, "queries")
    write.drop(rows)
    ranking = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, first, wide = None, 0, FIRST
    while first < shards:
        some = trees.where(F.col("shard").between(first, first + wide - 1))
        asked = queries.withColumn("floor", F.lit(float("-inf")))
        if best is not None:
            floors = best.where(F.col("rank") == k).select("query_id", (F.col("score") - F.abs("score") * 1e-15).alias("floor"))  # not above the score, rounded or not
            asked = queries.join(floors.hint("merge"), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        packed = asked.repartition(blocks, "block").groupBy("block", "dim").applyInPandas(_block, "q_dim int, query_ids array<long>, qs binary, floors array<double>")
        packed = write(packed, "asked")
        pairs = some.hint("shuffle_replicate_nl").crossJoin(packed)  # partitions meet as they are read
        made = map_arrow(pairs, _search(k), "query_id long, vec_id long, score long")
        if best is not None:
            made = best.select("query_id", "vec_id", "score").unionByName(made)
        earlier, best = best, write(made.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k), "best")
        write.drop(packed, *([] if earlier is None else [earlier]))
        first, wide = first + wide, wide * WAVE
    return best.select("query_id", "rank", "vec_id", "score")
