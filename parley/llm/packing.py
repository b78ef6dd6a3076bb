"""Best-fit packing of documents into sequences, improved by a swap-based local search.

Lengths are whole numbers up to the sequence length, so the bins of any corpus fall into classes: bins that hold the
same lengths. Packing works on the counts of the lengths (at most `size` numbers, whatever the corpus) and on classes
with the number of their bins, then every piece looks its place up by its length and its number among pieces of that
length. Nothing that grows with the corpus comes to the driver or to one task.

Search: between two underfull bins, one takes from the other by a move, a one-for-one exchange or a two-for-one exchange,
in either direction of the two; each raises the sum of squared fills. The least filled bins give until they are empty or
nothing more fits. What could make room in a bin, nothing or one or two of its pieces, is indexed by the room it would
leave, so the tightest place for a piece is looked up and not searched for. It ends when the bins are as few as the sum of
lengths allows, or when no exchange between any two bins helps; there is no other limit. The index holds a place for each
pair of lengths in each class of open bins, so it is only built where best fit leaves more bins than that sum.

Null text counts as empty (only the end id); null or repeated doc_ids are packed row by row; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import materialise, slices
from parley.llm.wordbpe import SLICE, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

#: A class of bins: the lengths in each, as (length, how many), longest first.
Bin = tuple[tuple[int, int], ...]


def with_item(bin_: Bin, length: int, n: int = 1) -> Bin:
    held = Counter(dict(bin_))
    held[length] += n
    return tuple(sorted(((k, v) for k, v in held.items() if v), reverse=True))


def fill(bin_: Bin) -> int:
    return sum(k * v for k, v in bin_)


def best_fit(counts: dict[int, int], size: int) -> Counter[Bin]:
    """Best-fit decreasing over counts of lengths: the longest first, each into the tightest bin that takes it."""
    bins: dict[int, Counter[Bin]] = {size: Counter()}  # by room left; those of no content are unbounded
    rooms: list[int] = [size]
    packed: Counter[Bin] = Counter()

    def put(bin_: Bin, n: int) -> None:
        room = size - fill(bin_)
        if not room:
            packed[bin_] += n
            return
        if room not in bins:
            bins[room] = Counter()
            insort(rooms, room)
        bins[room][bin_] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = rooms[bisect_left(rooms, length)]
            here = bins[room]
            each = room // length  # after one, the same bin is the tightest for the next
            if room == size and not here:
                bin_, n = (), -(-left // each)
            else:
                bin_, n = next(iter(here.items()))
            whole = min(n, left // each)
            odd = left - whole * each if whole < n else 0
            gone = whole + bool(odd)
            if bin_ != ():
                here[bin_] -= gone
                if not here[bin_]:
                    del here[bin_]
                if not here and room != size:
                    del bins[room]
                    rooms.remove(room)
            if whole:
                put(with_item(bin_, length, each), whole)
            if odd:
                put(with_item(bin_, length, odd), 1)
            left -= whole * each + odd
    for group in bins.values():
        packed.update(group)
    return +packed


def pairs(bin_: Bin) -> list[tuple[int, int]]:
    return list(combinations([k for k, _ in bin_], 2)) + [(k, k) for k, v in bin_ if v > 1]


def exchanged(bin_: Bin, gone: tuple[int, ...], come: tuple[int, ...]) -> Bin:
    """The bin without some lengths and with others."""
    held = dict(bin_)
    for k in gone:
        held[k] -= 1
    for k in come:
        held[k] = held.get(k, 0) + 1
    return tuple(sorted([(k, v) for k, v in held.items() if v], reverse=True))


class Places:
    """Where pieces fit: for each open bin, the room that it has if it gives nothing, one or two of its lengths."""

    def __init__(self, size: int):
        self.size = size
        #: By how many lengths are given and by the room: (their sum, the bin, the lengths), the smallest sum first.
        self.rows = [[[] for _ in range(size + 1)] for _ in range(3)]
        #: A bit for each room that some bin has.
        self.rooms = [0, 0, 0]

    def _of(self, bin_: Bin) -> Iterator[tuple[int, int, tuple[int, Bin, tuple[int, ...]]]]:
        if room := self.size - fill(bin_):
            yield 0, room, (0, bin_, ())
            for k, _ in bin_:
                yield 1, room + k, (k, bin_, (k,))
            for x in pairs(bin_):
                yield 2, room + x[0] + x[1], (x[0] + x[1], bin_, x)

    def add(self, bin_: Bin) -> None:
        for n, room, place in self._of(bin_):
            insort(self.rows[n][room], place)
            self.rooms[n] |= 1 << room

    def remove(self, bin_: Bin) -> None:
        for n, room, place in self._of(bin_):
            row = self.rows[n][room]
            del row[bisect_left(row, place)]
            if not row:
                self.rooms[n] ^= 1 << room

    def tightest(self, n: int, total: int, giver: Bin, alone: bool, low: int) -> tuple[int, int, Bin, tuple[int, ...]] | None:
        """The place for lengths of a giver (of fill low) that gives n smaller ones back: rise, room left, bin, lengths."""
        room, rooms = total, self.rooms[n] >> total
        while rooms:
            skip = (rooms & -rooms).bit_length()
            room, rooms = room + skip, rooms >> skip
            for less, bin_, x in self.rows[n][room - 1]:
                if less >= total:
                    break
                # The sum of squares rises by twice the rise times (taker's new fill less the giver's old one).
                if self.size - (room - 1 - total) > low and not (alone and bin_ == giver):
                    return total - less, room - 1 - total, bin_, x
        return None


def best_exchange(places: Places, giver: Bin, alone: bool) -> tuple[Bin, tuple[int, ...], tuple[int, ...]] | None:
    """The taker, what it gives and what it takes: the exchange of most rise, less four times the room it leaves."""
    low, best, most = fill(giver), None, 0
    for y in [(k,) for k, _ in giver] + pairs(giver):
        for n in range(min(2, 3 - len(y)) + 1):
            if found := places.tightest(n, sum(y), giver, alone, low):
                rise, room, bin_, x = found
                if best is None or rise - 4 * room > most:
                    best, most = (bin_, x, y), rise - 4 * room
    return best


def local_search(bins: Counter[Bin], size: int) -> Counter[Bin]:
    """Exchanges between underfull bins until none helps or no bin can be saved."""
    bins = +bins
    least = -(-sum(fill(b) * n for b, n in bins.items()) // size)
    number = sum(bins.values())
    if number <= least:
        return bins
    places = Places(size)
    for b in bins:
        places.add(b)
    changed = True
    while changed and number > least:
        changed = False
        for giver in sorted((b for b in bins if fill(b) < size), key=lambda b: (fill(b), b)):
            while giver and bins[giver] and number > least and (found := best_exchange(places, giver, bins[giver] < 2)):
                taker, x, y = found
                n = bins[giver] // 2 if taker == giver else min(bins[giver], bins[taker])
                left = exchanged(giver, y, x)
                for b, more in ((taker, -n), (giver, -n), (exchanged(taker, x, y), n), (left, n)):
                    if not b:
                        number -= n
                        continue
                    if not bins[b]:
                        places.add(b)
                    bins[b] += more
                    if not bins[b]:
                        places.remove(b)
                        del bins[b]
                giver, changed = left, True
    return +bins


def slot_table(bins: Counter[Bin]) -> np.ndarray:
    """For each length in each class: length, first number, how many, how many a bin, first sequence, offset there."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for bin_, n in sorted(bins.items(), key=lambda x: (-fill(x[0]), x[0])):
        offset = 0
        for length, each in bin_:
            rows.append((length, used[length], n * each, each, sequence, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """Encode each document, add the end id, cut those longer than size; number the pieces of a length in each task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 1, np.int64)
        words, part_id = encoder(vocabulary), TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                flat, counts = words.encode(part.column("text"))
                ends = np.cumsum(counts)
                out = []
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), ends - counts, ends):
                    ids = np.append(flat[a:b], end_id).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), size)):
                        piece = ids[at : at + size]
                        out.append((doc_id, k, at, len(piece), zlib.crc32(piece.tobytes()), part_id, int(seen[len(piece)])))
                        seen[len(piece)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()])], [c.split()[0] for c in PIECES.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """Places of all pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialise(cut_pieces(docs, vocabulary, end_id, size))
    dealt = materialise(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slot_table(local_search(best_fit(counts, size), size))
    shared = docs.sparkSession.sparkContext.broadcast(slots)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank, base = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank", "base"))
            number = rank + base
            row = table[np.searchsorted(keys, length << 48 | number, side="right") - 1]
            nth = number - row[:, 1]
            sequence, offset = row[:, 4] + nth // row[:, 3], row[:, 5] + nth % row[:, 3] * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [c.split()[0] for c in PLACED.split(", ")])

    return pieces.join(bases, ["length", "part"]).mapInArrow(place, PLACED)
