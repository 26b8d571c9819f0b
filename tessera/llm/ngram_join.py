"""N-gram Jaccard join by vertical partitioning.

The global n-gram order is the order of the 64-bit shingle hashes. It is cut
into fragments, and a document's set falls into one segment per fragment.

* Candidates. Two sets of at most S shingles with Jaccard p/100 or more differ
  in at most D = 2S(100-p)/(100+p) shingles, so of D + 1 + s fragments more than
  s segments are equal in both. Sets are banded by size; a band has its own cut,
  and a set whose larger partners may lie in the next band also joins that
  one's cut. Documents meet only where a whole segment agrees, and not on the s
  most frequent segments of either, so lines and passages that many documents
  share bring hardly any candidates.
* Passes. Texts are read three times: for the digests that fold equal sets, for
  the segment keys of representatives, which go straight into the shuffle that
  deals them, and for the sets of those that have candidates. Each pass finds
  its ids by a bounded bitmap, so texts are neither shuffled nor joined.
* Counts. Each candidate pair's overlap is counted fragment by fragment and
  summed per pair; the sum decides exactly. Before that a parity sketch (each
  bit the parity of the shingles that fall on it) drops pairs that differ in
  too much for certain: common shingles cancel, so the bits in which two
  sketches differ are never more than the shingles in which the sets differ.
* Hot groups. Equal sets are folded to one representative first. Inside a
  bucket of agreeing segments all members are compared with one pivot (a star,
  not all pairs): the member that agrees with most others over all its
  segments, which for copies of one text with edits is the text itself. Only
  members that are still not connected are then looked at again, by their
  differences from the pivot, of which two linked sets share a known part, so
  no link that changes a component is lost. A set has many segments, so even a
  bucket with a third of all sets is a small part of the segment table; that
  table is sorted by segment and counted in one pass, in which groups beyond
  memory spill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.id_bitmap import found_in, has, id_bitmap
from tessera.llm.shingles import WordHashes, mix, shingle_set
from tessera.storage import Scratch, map_arrow, materialize

#: Fragments in which overlaps are counted.
COUNT_FRAGMENTS = 4
#: 64-bit words of the sketch that travels with candidates; longer ones fold to it.
SKETCH_WORDS = 16
#: Bits of a segment key that are kept. Equal segments keep equal keys; a few more that agree by chance are candidates that the counts drop.
KEY_BITS = 40


def _edges(percent: int) -> np.ndarray:
    """Lower bounds of the size bands; each is wider than the largest ratio of linked sizes."""
    ratio, out = max(1.4, 110 / percent), [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out, np.int64)


def _cut(band: int, edges: np.ndarray, percent: int) -> tuple[int, int]:
    """(fragments, spare) of a band's cut: linked sets agree in more than ``spare`` segments; no fragments where only equal sets link."""
    differ = 2 * (int(edges[band + 1]) - 1) * (100 - percent) // (100 + percent)
    spare = 3 + differ // 5
    return (differ + 1 + spare, spare) if differ else (0, 0)


def _segment_keys(h: np.ndarray, band: int, k: int) -> np.ndarray:
    """One key per segment of the band's cut, empty ones included."""
    frag = ((h >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, frag[1:] != frag[:-1]])
    sums = np.zeros(k, np.uint64)
    sums[frag[starts].astype(np.int64)] = np.add.reduceat(mix(h), starts)
    return mix(sums + mix(np.arange(k, dtype=np.uint64) + np.uint64(band << 40))) >> np.uint64(64 - KEY_BITS)


def _bands(n: int, edges: np.ndarray, percent: int) -> list[int]:
    """The set's band, and the next if larger partners may lie there."""
    band = int(np.searchsorted(edges, n, "right")) - 1
    return [band] if 100 * n // percent < edges[band + 1] else [band, band + 1]


def _sets(k: int):
    """Of each text the size and digests of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            out = ([], [], [])
            for text in batch.column(1):
                h = shingle_set(text.as_py(), k, memo)
                for column, value in zip(out, (len(h), *_digest(h)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], ["id", "n", "d1", "d2"])

    return run


def _cuts(k: int, percent: int, copies: np.ndarray, kept: np.ndarray):
    """Segment keys by cut, with size and digests, of the sets whose id isn't found in ``copies``, or is in ``kept`` too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, edges = WordHashes(), _edges(percent)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            batch = batch.filter(pa.array(~has(copies, ids) | has(kept, ids)))
            n, d1, d2, per_text, spares, per_cut, keys = [], [], [], [0], [], [0], [np.empty(0, np.int64)]
            for text in batch.column(1):
                h = shingle_set(text.as_py(), k, memo)
                n.append(len(h))
                for out, value in zip((d1, d2), _digest(h), strict=True):
                    out.append(value)
                for band in _bands(len(h), edges, percent) if len(h) else ():
                    fragments, spare = _cut(band, edges, percent)
                    if fragments:
                        keys.append(_segment_keys(h, band, fragments).view(np.int64))
                        spares.append(spare), per_cut.append(per_cut[-1] + fragments)
                per_text.append(len(spares))
            lists = pa.ListArray.from_arrays(pa.array(per_cut, pa.int32()), pa.array(np.concatenate(keys)))
            cuts = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.StructArray.from_arrays([pa.array(spares, pa.int32()), lists], ["spare", "keys"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), cuts], ["id", "n", "d1", "d2", "cuts"])

    return run


def _digest(h: np.ndarray) -> tuple[int, int]:
    m = mix(h)
    return int(m.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(m)).view(np.int64)) if len(h) else 0


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose key occurs again; holds one batch and one row."""
    held, again = None, False  # the last row, and whether its key came before it
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.r_[h, c] for h, c in zip(held, columns, strict=True)]
        same = columns[0][1:] == columns[0][:-1]
        keep = (np.r_[again, same] | np.r_[same, False])[:-1]
        held, again = [c[-1:] for c in columns], bool(same[-1]) if len(same) else again
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]) for c in columns], batch.schema.names)
    if again:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["key", "id", "spare"])


def sketch_of(h: np.ndarray, percent: int) -> np.ndarray:
    """Parities of the shingles by their low bits, as int64 words: about four bits for each shingle that linked sets may differ in."""
    words, differ = SKETCH_WORDS, 2 * len(h) * (100 - percent) // (100 + percent)
    while 64 * words < 4 * differ:
        words *= 2
    odd = np.bincount((h & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _segments(k: int, percent: int, wanted: np.ndarray):
    """Of the sets whose id is found in ``wanted``: size, digests, sketches and shingles by fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            batch = batch.filter(pa.array(has(wanted, batch.column(0).to_numpy())))
            ids, numbers, small, sketch, parts = [], ([], [], []), [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingle_set(text.as_py(), k, memo)
                if len(h):
                    frag = ((h >> np.uint64(32)) * np.uint64(COUNT_FRAGMENTS)) >> np.uint64(32)
                    s = sketch_of(h, percent)
                    ids.append(key), sketch.append(s), small.append(np.bitwise_xor.reduce(s.reshape(-1, SKETCH_WORDS), axis=0))
                    for out, value in zip(numbers, (len(h), *_digest(h)), strict=True):
                        out.append(value)
                    parts.append([h[frag == f].view(np.int64) for f in range(COUNT_FRAGMENTS)])
            words = pa.list_(pa.int64())
            columns = [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in numbers), pa.array(small, words), pa.array(sketch, words), pa.array(parts, pa.list_(words))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "d1", "d2", "small", "sketch", "parts"])

    return run


def _may_link(x: Column, y: Column, nx: Column, ny: Column, percent: int) -> Column:
    """False only for sketches (of equal length or one twice the other) of sets that don't link."""

    def folded(s: Column, other: Column) -> Column:
        half = F.size(other)
        return F.when(F.size(s) > half, F.zip_with(F.slice(s, 1, half), F.slice(s, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(s)

    differing = F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (differing * (100 + percent) <= (nx + ny) * (100 - percent))


def _by_fragment(segments: DataFrame, **names: str) -> DataFrame:
    rows = segments.select("id", "n", F.posexplode("parts").alias("frag", "part"))
    return rows.withColumnsRenamed(names)


def count_overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose Jaccard similarity is percent/100 or more."""
    left, right = (segments.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x)) for x in "ba")
    near = pairs.join(left, "b").join(right, "a").where(_may_link(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), percent)).select("a", "b")
    partial = (
        near.join(_by_fragment(segments, id="b", n="nb", part="pb"), "b")
        .join(_by_fragment(segments, id="a", n="na", part="pa"), ["a", "frag"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).cast("long").alias("o"))
    )
    total = partial.groupBy("a", "b").agg(F.sum("o").alias("o"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return total.where(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * percent).select("a", "b")


def jaccard_components(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of ``docs``.

    Documents link when 100 * |A & B| >= percent * |A | B| over their sets of
    distinct ``shingle``-word shingles (with fewer words: the whole sequence as
    one). component_id is the smallest id reachable over links.

    Null and blank texts have no shingles and link with nothing. Repeated rows
    each give a row. If an id repeats with different texts, its largest set
    takes part and every row of the id gets that component. Rows with a null id
    get a null component and take no part. Other columns are ignored, whatever
    their names. An empty table gives an empty table. percent is 75 to 100.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent must be 75 to 100")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    digest = ["n", "d1", "d2"]
    with Scratch(docs.sparkSession) as write:
        members = materialize(map_arrow(source, _sets(shingle), "id long, n long, d1 long, d2 long"), "members")
        sets = members.where("n > 0 AND id IS NOT NULL")
        repeats = not sets.groupBy("id").count().where("count > 1").isEmpty()
        if repeats:  # an id's largest set stands for it
            sets = write(sets.groupBy("id").agg(F.max(F.struct(*digest)).alias("s")).select("id", "s.*"), "largest")
        classes = materialize(sets.groupBy(*digest).agg(F.min("id").alias("rep")), "classes")
        found = None
        if percent < 100:
            # texts are read again rather than their keys kept: these take more room than the texts
            read = source.where(F.col("id").isNotNull())
            rows_of = lambda made: made.join(sets, ["id", *digest], "left_semi").dropDuplicates(["id"]) if repeats else made
            copies = id_bitmap(write(sets.join(classes, digest).where("id <> rep").select("id"), "copies"))
            kept = id_bitmap(found_in(copies, classes.select(F.col("rep").alias("id"))))  # representatives that only chance finds; copies found here too do no harm
            made = map_arrow(read, _cuts(shingle, percent, copies, kept), "id long, n long, d1 long, d2 long, cuts array<struct<spare:int,keys:array<long>>>")
            cuts = rows_of(made).select("id", F.explode("cuts").alias("cut"))
            rows = cuts.select(F.explode("cut.keys").alias("key"), "id", F.col("cut.spare").alias("spare"))
            shared = rows.repartition("key").withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1")  # groups beyond memory spill
            buckets = write(shared, "buckets")
            write.drop()
            if not buckets.isEmpty():
                found = materialize(_components(buckets, read, rows_of, shingle, percent, write), "components")
        if repeats:
            owner = materialize(sets.join(classes, digest).select("id", "rep"), "owners")
    members = members.join(owner, "id", "left") if repeats else members.join(classes, digest, "left")
    if found is not None:
        members = members.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
    return members.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("component_id"))


def _components(buckets: DataFrame, source: DataFrame, rows_of: Callable[[DataFrame], DataFrame], shingle: int, percent: int, write: Scratch) -> DataFrame:
    """(id, component) of the representatives that have links; ``rows_of`` leaves one row of an id, that of its set."""
    # linked sets share more than `spare` keys, so a set's `spare` most frequent ones (in one order for all) needn't be looked at
    frequent = Window.partitionBy("id", "spare").orderBy(F.desc("m"), F.desc("key"))
    few = buckets.withColumn("r", F.row_number().over(frequent)).where("r > spare").select("key", "id")
    several = few.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    few = write(few.join(several, "key"), "few")
    write.drop(buckets)
    of_set = Window.partitionBy("id")  # as many rows as the set has segments, so never a hot group
    ranked = write(few.select("key", "id", F.sum("m").over(of_set).alias("score")), "ranked")
    write.drop(few)
    wanted = id_bitmap(write(ranked.select("id").distinct(), "wanted"))
    made = map_arrow(source, _segments(shingle, percent, wanted), "id long, n long, d1 long, d2 long, small array<long>, sketch array<long>, parts array<array<long>>")
    segments = write(rows_of(made).drop("d1", "d2"), "segments")  # some that nothing asks for among them
    hubs = ranked.groupBy("key").agg(F.max(F.struct("score", F.negate("id").alias("low"))).alias("h")).select("key", F.negate("h.low").alias("a"))
    hubbed = write(ranked.join(hubs, "key"), "hubbed")
    write.drop(ranked)
    tried = write(hubbed.where("id <> a").select(F.greatest("id", "a").alias("b"), F.least("id", "a").alias("a")).distinct(), "stars")
    links = write(count_overlaps(tried, segments, percent), "links")
    found = write(connected_components(links, write=write), "components")
    open_ = write(_unsettled(hubbed, found), "open")
    write.drop(hubbed)
    if open_.isEmpty():
        return found
    pairs = _by_difference(open_, segments, percent, write).distinct()
    pairs = write(pairs.join(tried, ["a", "b"], "left_anti").select("b", "a"), "pairs")
    new = write(count_overlaps(pairs, segments, percent), "links")
    return found if new.isEmpty() else connected_components(links.unionByName(new), write=write)


def _by_difference(members: DataFrame, segments: DataFrame, percent: int, write: Scratch) -> DataFrame:
    """Candidate pairs (a < b) among members of open buckets, from how they differ from the bucket's hub.

    With d(x) the shingles in which x and the hub h differ, sets x and z differ
    in |d(x)| + |d(z)| - 2|d(x) & d(z)|. If both link with h they are connected
    already. Otherwise a link needs so many common differences that a prefix of
    d(x), rarest first, must meet one of d(z): lower bounds of that number give
    the prefix lengths, apart for pairs of which neither or one links with h.
    Pairs that meet and whose sketches differ in too much are dropped at once.
    """
    stars = members.where("id <> a").select(F.col("a").alias("hub"), "id", "label").distinct()
    x, h = _by_fragment(segments, part="px"), _by_fragment(segments, id="hub", n="nh", part="ph")
    parts = stars.join(x, "id").join(h, ["hub", "frag"]).select("hub", "id", "label", "n", "nh", F.concat(F.array_except("px", "ph"), F.array_except("ph", "px")).alias("d"))
    whole = write(parts.groupBy("hub", "id", "label", "n", "nh").agg(F.flatten(F.collect_list("d")).alias("d")), "differences")  # a row for each fragment
    write.drop()
    r = (100 - percent) / (100 + percent)
    size, near = F.size("d"), F.lit(r) * (F.col("n") + F.col("nh"))
    at_least = lambda c: F.greatest(F.lit(1), F.ceil(c - 1e-9).cast("int"))
    about = whole.select(
        "hub", "id", "label", size.alias("size"), (size <= near + 1e-9).alias("linked"),
        (size - at_least((size - near + 2 * r * (1 - r) / (1 + r) * F.col("nh")) / 2) + 1).alias("short"),
        (size - at_least(F.when(size <= near + 1e-9, size * (1 - r) / 2).otherwise((size - near) / 2)) + 1).alias("long"),
    )
    items = whole.select("hub", "id", F.explode("d").alias("item"))
    shared = write(items.groupBy("hub", "item").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    rarest = Window.partitionBy("hub", "id").orderBy("c", "item")
    singles = F.col("size") - F.count("*").over(Window.partitionBy("hub", "id"))  # items of one member come first in the order
    ordered = items.join(shared, ["hub", "item"]).join(about, ["hub", "id"])
    placed = ordered.withColumn("at", F.row_number().over(rarest) + singles).where("at <= greatest(short, long)")
    placed = placed.join(segments.select("id", "n", "small"), "id")
    placed = write(placed.select("hub", "item", "id", "label", "n", "small", "linked", (F.col("at") <= F.col("short")).alias("early"), (F.col("at") <= F.col("long")).alias("within")), "prefixes")
    write.drop(whole, shared)
    left, right = placed.where("NOT linked"), placed.select("hub", "item", *(F.col(c).alias("z_" + c) for c in ("id", "label", "n", "small", "linked", "early", "within")))
    meet = F.expr("label <> z_label AND ((z_linked AND within AND z_within) OR (NOT z_linked AND early AND z_early AND id < z_id))")
    met = left.join(right, ["hub", "item"]).where(meet & _may_link(F.col("small"), F.col("z_small"), F.col("n"), F.col("z_n"), percent))
    return met.select(F.least("id", "z_id").alias("a"), F.greatest("id", "z_id").alias("b"))


def _unsettled(hubbed: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, a, label) of the buckets whose members aren't all connected; a is the bucket's hub."""
    labelled = hubbed.join(found, "id", "left").select("key", "id", "a", F.coalesce("component", "id").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return labelled.join(mixed, "key", "left_semi")
