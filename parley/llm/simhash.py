"""SimHash near duplicates, linked through Golay-code fuzzy hashing.

Fingerprint: ASCII letters lower-cased, words split at ASCII white space, SHINGLE-word shingles with repeats, each hashed
by XXH64 (seed 42); a bit is set if it is set in over half the hashes. Fingerprints link at DISTANCE differing bits or
fewer.

Keys: the 64 bits are cut into three segments of 22, 21 and 21 bits, each a word of the (23, 12) Golay code with its
missing bits zero. The code is perfect: each word has one codeword within three bits, whose message is the word's index
(12 bits). Four differing bits leave two of the segments with two at most between them (else the two least would have
three, the third two, five in all). So two linked fingerprints have, in one pair of segments, a word half-way: one bit
from each of them at most. A fingerprint's keys are, for each pair of segments, the indices of all words of the pair
within one bit of its own, about 29 in all, and linked fingerprints share a key.

Candidates of a key are compared in blocks of BLOCK: keys with more fingerprints are dealt out by pairs of blocks, so no
task holds more than two blocks of a key and no fingerprint is left out. Of a block only links that connect it are
emitted, not all its pairs. Components follow over distinct fingerprints.

Null text counts as empty and has fingerprint zero, linked like any other; a text of fewer words is one shingle; null
doc_ids get a component but never name one unless it has no other; repeated rows each give a row; an empty table gives
none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import lookup_join, materialise, slices, texts
from parley.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BLOCK = 4096
#: Runs of up to so many candidates emit their links as found, larger ones only a spanning forest.
SMALL_RUN = 16


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles in turn, repeats included; none for a text without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values = [fingerprint(x.encode(), shingle) for x in texts(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(values, "<u8").view("<i8"))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


@lru_cache(1)
def golay_index() -> np.ndarray:
    """For each 23-bit word, the message of the codeword within three bits of it."""
    messages = np.arange(1 << 12, dtype=np.int64)
    shifted = messages << 11
    rest = shifted.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ GENERATOR << (bit - 11), rest)
    codewords = shifted | rest
    errors = [0] + [sum(1 << b for b in bits) for n in (1, 2, 3) for bits in combinations(range(23), n)]
    table = np.zeros(1 << 23, np.uint16)
    for e in errors:
        table[codewords ^ e] = messages
    return table


def fuzzy_keys(fps: np.ndarray) -> np.ndarray:
    """A row of keys for each fingerprint; -1 stands for a key that the row has already."""
    index = golay_index()
    words = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [index[w].astype(np.int64) for w in words]
    near = [index[w[:, None] ^ 1 << np.arange(n)].astype(np.int64) for w, (_, n) in zip(words, SEGMENTS)]
    columns = []
    for pair, (x, y) in enumerate(combinations(range(3), 2)):
        head = pair << 24
        columns += [head | (own[x] << 12 | own[y])[:, None], head | near[x] << 12 | own[y][:, None], head | own[x][:, None] << 12 | near[y]]
    keys = np.sort(np.concatenate(columns, axis=1), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        for at in range(0, len(fps), 8192):
            part = fps[at : at + 8192]
            keys = fuzzy_keys(part.view(np.uint64))
            row, column = np.nonzero(keys >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, column].astype(np.int32)), pa.array(part[row])], ["key", "fp"])


def spanning(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that connect what links among fps connect, one fewer than the members of each class."""
    left = np.arange(len(fps))
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            found = np.full(len(left), -1)
            for at in range(0, len(frontier), 64):
                some = frontier[at : at + 64]
                near = np.bitwise_count(fps[some][:, None] ^ fps[left][None, :]) <= distance
                hit = near.any(0) & (found < 0)
                found[hit] = some[near[:, hit].argmax(0)]
            yes = found >= 0
            yield from zip(found[yes].tolist(), left[yes].tolist())
            frontier, left = left[yes], left[~yes]


def _link_runs(group: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal group among rows in order of it."""
    bits = fps.view(np.uint64)
    edges = np.flatnonzero(np.diff(group)) + 1
    starts = np.concatenate([[0], edges])
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    us, vs = [], []
    room = np.repeat(np.where(sizes <= SMALL_RUN, starts + sizes, 0), sizes) - np.arange(len(group))
    at = np.flatnonzero(room > 1)
    for shift in range(1, SMALL_RUN):
        at = at[room[at] > shift]
        if not len(at):
            break
        hit = at[np.bitwise_count(bits[at] ^ bits[at + shift]) <= distance]
        us.append(fps[hit])
        vs.append(fps[hit + shift])
    for k in np.flatnonzero(sizes > SMALL_RUN):
        a = starts[k]
        found = np.array(list(spanning(bits[a : a + sizes[k]], distance)), np.int64).reshape(-1, 2)
        us.append(fps[a + found[:, 0]])
        vs.append(fps[a + found[:, 1]])
    return np.concatenate([*us, fps[:0]]), np.concatenate([*vs, fps[:0]])


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp), enough to connect all that link.

    Keys are only sure to be shared up to DISTANCE differing bits, so a larger distance is refused."""
    if distance > DISTANCE:
        raise ValueError(f"distance {distance}: the keys cover {DISTANCE} differing bits at most")
    return linked(materialise(fps.select("fp").mapInArrow(_emit_keys, "key int, fp long")), distance)


def linked(keys: DataFrame, distance: int) -> DataFrame:
    """The same among fingerprints that share a key, given as distinct rows of key (int) and fp."""
    crowded = keys.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    rows = keys.withColumn("pair", F.lit(0))
    crowded = materialise(crowded)
    if not crowded.isEmpty():
        block = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
        other = F.explode(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block")))
        dealt = keys.join(crowded, "key").withColumn("block", block).withColumn("other", other)
        pair = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
        rows = rows.join(crowded, "key", "left_anti").unionByName(dealt.select("key", "fp", pair.cast("int").alias("pair")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(g: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _link_runs(g, f, distance)], ["u", "v"])

        for batch in batches:
            g = batch.column("key").to_numpy().astype(np.int64) << 32 | batch.column("pair").to_numpy().astype(np.int64)
            group, held = np.concatenate([group, g]), np.concatenate([held, batch.column("fp").to_numpy()])
            if not len(group):
                continue
            last = int(np.searchsorted(group, group[-1], side="left"))
            if last:
                yield out(group[:last], held[:last])
                group, held = group[last:], held[last:]
        if len(group):
            yield out(group, held)

    sorted_ = rows.repartition("key", "pair").sortWithinPartitions("key", "pair")
    return sorted_.mapInArrow(compare, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id reachable) of every row."""
    marked = materialise(fingerprints(docs, shingle))
    total = marked.count()
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    rooted = components(links(distinct, distance), "u", "v")
    placed = distinct.join(rooted, distinct["fp"] == rooted["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    placed = materialise(placed)
    named = materialise(placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")))
    facts = lookup_join(placed, named, "root", "members", placed.count()).select("fp", "n", "component_id")
    found = lookup_join(marked, materialise(facts), "fp", "n", total)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
