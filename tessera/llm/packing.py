"""Best-fit packing of tokenised documents by bin completion.

Documents become pieces of at most ``capacity`` tokens; only the number of
pieces of each length matters for packing, so the driver solves the problem on
that histogram (``capacity`` numbers at most, whatever the corpus). The plan,
again bounded, says how many sequences of each pattern to fill; pieces then
find their place from their rank within their length. Ranks are dealt through
salted sub-groups of each length, so a length that a third of all pieces share
is spread over many tasks.
"""

from __future__ import annotations

import bisect
import itertools
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import map_arrow, materialize

#: Distinct chunks whose ids a worker remembers during a task, and from one task to the next (about 60 and 10 MB).
CACHE_CHUNKS, KEPT_CHUNKS = 400_000, 60_000
MARKS = ".,!?;:"
#: Sub-groups into which the pieces of one length are dealt at most.
MAX_SALTS = 8192
#: Steps that the search may take (some seconds), of them for one enumeration of fillings, and fillings kept of each.
STEPS, FILLING_STEPS, FILLINGS = 1_000_000, 2_000, 8


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class ChunkIds(dict):
    """A run without blanks to its token ids as little-endian uint32 bytes.

    The vocabulary's splitting pattern never crosses white space and its
    normaliser composes nothing with a blank, so a text's ids are those of its
    runs, joined. A run of letters is one word to the pattern and so are marks
    that follow it, so words are kept apart from them, in lower case, and go
    to the merge rules directly. Anything else takes the whole tokenizer, and
    so does a word that isn't all letters in lower case (a capital I with dot
    becomes two characters, the second of which goes with the marks).
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.merges, self.letters = tokenizer, tokenizer.model, _byte_letters()

    def encode(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, chunk: str) -> bytes:
        stem = chunk.rstrip(MARKS)
        word = False
        if stem.isalpha() and "Σ" not in stem and unicodedata.is_normalized("NFC", stem):
            low = stem.lower()
            if low.isalpha() and unicodedata.is_normalized("NFC", low):
                if len(stem) < len(chunk):
                    return self[stem] + self[chunk[len(stem) :]]
                if low != stem:
                    return self[low]
                word = True
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        if word:
            spelt = chunk if chunk.isascii() else "".join([self.letters[b] for b in chunk.encode()])
            value = b"".join([t.id.to_bytes(4, "little") for t in self.merges.tokenize(spelt)])
        else:
            value = self.encode(chunk)
        if len(chunk) <= 64:
            self[chunk] = value
        return value


_memos: dict[str, ChunkIds] = {}


def memo_of(path: str) -> ChunkIds:
    """This process's memo of a tokenizer file; Spark keeps Python workers, so it serves many tasks."""
    if path not in _memos:
        from tokenizers import Tokenizer

        _memos.clear()
        _memos[path] = ChunkIds(Tokenizer.from_file(path))
    return _memos[path]


def shrink_memo(path: str) -> None:
    """Keep only the chunks met first, the frequent ones, so that an idle worker holds little."""
    memo = _memos.get(path)
    if memo is not None and len(memo) > KEPT_CHUNKS:
        first = list(itertools.islice(memo.items(), KEPT_CHUNKS))
        memo.clear()
        memo.update(first)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end, step = memo_of(path), end_id.to_bytes(4, "little"), 4 * capacity
        try:
            for batch in batches:
                keys, piece, start, length, crc = [], [], [], [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data = b"".join(map(memo.__getitem__, (text.as_py() or "").replace("\n", " ").split(" "))) + end
                    for k, at in enumerate(range(0, len(data), step)):
                        part = data[at : at + step]
                        keys.append(key), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        finally:
            shrink_memo(path)

    return run


def _bettered(filling: tuple[int, ...], spare: int, lengths: list[int], left: dict[int, int]) -> bool:
    """Whether one longer available piece could take the place of a member, or of all, without more waste.

    Such a filling is dominated (Martello and Toth): the members that leave fit
    wherever the longer piece would have gone, together.
    """
    for s, k in {(x, 1) for x in filling} | {(sum(filling), len(filling))}:
        i = bisect.bisect_left(lengths, s if k > 1 else s + 1)
        while i < len(lengths) and lengths[i] <= s + spare:
            if left[lengths[i]] > 0:
                return True
            i += 1
    return False


def fillings(room: int, lengths: list[int], counts: dict[int, int], allowed: int, want: int = FILLINGS, steps: int = FILLING_STEPS) -> tuple[list[tuple[int, tuple[int, ...]]], int, bool]:
    """Undominated fillings of ``room`` as (waste, lengths), least waste first; the steps taken; whether these are all.

    Depth first over non-increasing lengths, the largest fitting first. A
    branch is cut when even all pieces that it may still take leave more than
    ``allowed`` waste, or when one piece as long as two of its members together
    could replace them. A filling to which a further piece could be added, or
    in which a longer one could replace some, is dominated and not kept. The
    enumeration ends early, and says so, after ``steps`` steps or at ``want``
    fillings.
    """
    if counts.get(room, 0) > 0:  # one piece that fills it dominates all others
        return [(0, (room,))], 1, True
    found: list[tuple[int, tuple[int, ...]]] = []
    below = [0, *itertools.accumulate(x * counts[x] for x in lengths)]  # all that the shorter lengths hold
    left = dict(counts)
    taken, whole = 0, True

    def visit(rest: int, i: int, chosen: tuple[int, ...]) -> None:
        nonlocal taken, whole
        i = min(i, bisect.bisect_right(lengths, rest) - 1)
        if rest - min(rest, below[i + 1]) > allowed:
            return
        if all(left[x] <= 0 for x in itertools.takewhile(rest.__ge__, lengths)) and not _bettered(chosen, rest, lengths, left):
            found.append((rest, chosen))
        while i >= 0 and rest:
            if taken >= steps or len(found) >= want:
                whole = False
                return
            taken += 1 + len(chosen)
            x = lengths[i]
            if left[x] > 0 and not any(left.get(x + y, 0) > 0 for y in set(chosen)):
                left[x] -= 1
                visit(rest - x, i, (*chosen, x))
                left[x] += 1
            i -= 1

    visit(room, len(lengths) - 1, ())
    return sorted(found, key=lambda f: (f[0], len(f[1]))), taken, whole


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on the histogram: the first incumbent."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = {}
            bisect.insort(rooms, room)
        open_[room][pattern] = open_[room].get(pattern, 0) + n

    for x in sorted(histogram, reverse=True):
        n = histogram[x]
        while n:
            i = bisect.bisect_left(rooms, x)
            if i == len(rooms):
                k = capacity // x
                if n >= k:
                    put(capacity - k * x, (x,) * k, n // k)
                if n % k:
                    put(capacity - (n % k) * x, (x,) * (n % k), 1)
                break
            room = rooms[i]
            pattern, have = open_[room].popitem()
            fit = min(room // x, n)
            use = min(have, n // fit)
            if have > use:
                open_[room][pattern] = have - use
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            put(room - fit * x, pattern + (x,) * fit, use)
            n -= use * fit
    return [(p, n) for ps in open_.values() for p, n in ps.items()]


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs (Martello and Toth's L2).

    For each k, pieces of more than half the capacity open a sequence each, and
    only those of at most capacity - k have room for the pieces from k to half.
    """
    lengths = sorted(histogram)
    counts, sums = ([0, *itertools.accumulate(f(x) for x in lengths)] for f in (histogram.get, lambda x: x * histogram[x]))
    half = bisect.bisect_right(lengths, capacity // 2)
    over, best = counts[-1] - counts[half], -(-sums[-1] // capacity)
    for i, k in enumerate([*lengths[:half], capacity // 2 + 1]):
        fits = bisect.bisect_right(lengths, capacity - k)
        room = (counts[fits] - counts[half]) * capacity - (sums[fits] - sums[half]) if fits > half else 0
        best = max(best, over + max(0, -(-(sums[half] - sums[i] - room) // capacity)))
    return best


def complete_bins(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> tuple[list[tuple[tuple[int, ...], int]], bool]:
    """(pattern, number of sequences) over all pieces, and whether no packing takes fewer sequences.

    Branch and bound on bin completions. Best-fit decreasing is the first
    incumbent. Around the largest length left, its undominated fillings are
    tried, the least waste first, each for as many sequences as its pieces
    last, then for half of them, then for one; then the search goes on with
    what is left, and comes back for the next choice. A branch is cut when its
    waste exceeds what a plan better than the incumbent may have, or when its
    sequences and the bound of what is left reach the incumbent. It ends when
    the incumbent meets the lower bound or all branches are done (then nothing
    is better), or after ``steps`` steps with the best plan found.
    """
    histogram = {x: n for x, n in histogram.items() if n > 0}
    total = sum(x * n for x, n in histogram.items())
    bound = lower_bound(histogram, capacity) if histogram else 0
    best = best_fit(histogram, capacity)
    size = sum(n for _, n in best)
    counts, lengths, path = dict(histogram), sorted(histogram), []
    used, rest, whole = 0, total, True

    def take(pattern: tuple[int, ...], times: int) -> None:
        nonlocal used, rest
        for x in set(pattern):
            before = counts[x]
            counts[x] -= times * pattern.count(x)
            if not counts[x]:
                lengths.pop(bisect.bisect_left(lengths, x))
            elif not before:
                bisect.insort(lengths, x)
        used += times
        rest -= times * sum(pattern)

    def choices() -> Iterator[tuple[tuple[int, ...], int]]:
        nonlocal steps, whole
        top = lengths[-1]
        allowed = (size - 1) * capacity - total - (used * capacity - (total - rest))
        if allowed < 0:
            return
        counts[top] -= 1
        own = lengths if counts[top] else lengths[:-1]
        found, taken, all_ = fillings(capacity - top, own, counts, allowed, steps=min(FILLING_STEPS, max(steps, 1)))
        counts[top] += 1
        steps -= taken
        whole &= all_
        often = []
        for spare, filling in found:
            pattern = (top, *filling)
            most = min(counts[x] // pattern.count(x) for x in set(pattern))
            first = most if spare == 0 else -(-most // 2)  # later lengths may complete the others better
            often.append((pattern, most, first))
            yield pattern, first
        for pattern, most, first in often:
            for times in sorted({most, -(-most // 2), 1} - {first}, reverse=True):
                yield pattern, times

    stack = [choices()] if size > bound else []
    while stack and size > bound and steps > 0:
        choice = next(stack[-1], None)
        if choice is None:
            stack.pop()
            if path:
                pattern, times = path.pop()
                take(pattern, -times)
            continue
        take(*choice)
        path.append(choice)
        steps -= 1
        if not lengths:
            if used < size:
                best, size = list(path), used
        elif used + -(-rest // capacity) < size:
            stack.append(choices())
            continue
        path.pop()
        take(choice[0], -choice[1])
    return best, size <= bound or (whole and not stack)


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """Of each length: the first ranks of its intervals, and (sequence, copies, offset) of each."""
    at: dict[int, int] = {}
    out: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    first = 0
    for pattern, times in plan:
        offset = 0
        for x in sorted(set(pattern), reverse=True):
            k = pattern.count(x)
            starts, where = out.setdefault(x, ([], []))
            starts.append(at.get(x, 0))
            where.append((first, k, offset))
            at[x] = at.get(x, 0) + times * k
            offset += k * x
        first += times
    return out


def _place(where: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, off = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                starts, intervals = where[length]
                i = bisect.bisect_right(starts, rank) - 1
                first, k, offset = intervals[i]
                j = rank - starts[i]
                seq.append(first + j // k), off.append(offset + (j % k) * length)
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*kept.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, fewest.

    A document is its token ids, then ``end_id``. Longer ones than
    ``capacity`` are cut into pieces of that many tokens, the last shorter.
    Sequences hold at most ``capacity`` tokens, gapless from offset 0.
    ``fewest`` (the same in all rows) says that no packing of these pieces
    takes fewer sequences; false means that it isn't known.

    Null and empty texts give one piece that holds ``end_id`` alone. Repeated
    rows are packed each; a null id stays null. Other columns are ignored,
    whatever their names. An empty table gives an empty table.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = materialize(map_arrow(source, _pieces(tokenizer_path, capacity, end_id), schema), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan, fewest = complete_bins(histogram, capacity)

    spark = docs.sparkSession
    salts = spark.createDataFrame([(x, max(1, min(MAX_SALTS, n // 64))) for x, n in histogram.items()], "length long, salts int")
    dealt = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("base"))
    sent = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return map_arrow(sent, _place(places(plan)), schema + ", sequence_id long, offset long").withColumn("fewest", F.lit(fewest))
