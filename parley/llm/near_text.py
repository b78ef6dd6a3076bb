"""Near duplicates by the shingles themselves: texts whose sets of five-word shingles have a Jaccard similarity of 0.8.

Words are those of ``simhash``: ASCII letters lower-cased, split at ASCII white space. A text of fewer words is one
shingle, one without words is the empty shingle; null counts as empty.

Candidates come from two sources. One is op6's own: SimHash fingerprints of the five-word shingles, linked by their Golay
keys at four differing bits. Four bits are not enough for 0.8: by the angle of two sets of that similarity a tenth to a
sixth of 64 bits differ, nine or ten, and no radius of the code covers that with keys that still tell texts apart. So the
other source is BANDS keys of ROWS MinHash values each, and a sketch of 64 bits, one of each of the first 64 values. Texts
that share a key and differ in SKETCH bits or fewer are candidates, dealt out as in ``simhash.linked``. At a similarity of
0.8 the values of a key agree with probability 0.8^4 and no key with 5e-8, were they independent; a bit of the sketch
differs with 0.1 and over 20 of them with 6e-7. Both fall steeply above 0.8.

Every candidate is verified by its shingles: first against the first text of its candidate component, a pass over the
texts; those that this does not link meet all others of the component, dealt out by pairs of blocks of BLOCK texts. Only
links whose exact similarity is 0.8 or more count. Of each component of such links one row stays, that of the
smallest doc_id, a null one last, among equal ones the smaller hash of the text. Rows that repeat both doc_id and text
are one document and leave one row. Extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import simhash
from parley.llm.common import lookup_join, materialise, slices, texts
from parley.llm.components import components

SHINGLE = 5
#: Similarity as a fraction, so that the comparison is exact.
LEAST = (4, 5)
BANDS, ROWS = 32, 4
SKETCH = 20
BLOCK = 512

_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]
_MIX = np.uint64(0x9E3779B97F4A7C15)

ROW = "doc_id long, hash long, simhash long, fp long, keys array<int>"


def distinct_shingles(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes of shingles, in order; that of the empty shingle for none."""
    return np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)


def shingles(text: str) -> np.ndarray:
    return distinct_shingles(simhash.shingle_hashes(text.encode(), SHINGLE))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of the hashes under each of BANDS * ROWS permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        mixed = hashes[at : at + 2048] * _FACTORS
        mixed += _SHIFTS
        np.minimum(least, mixed.min(1), out=least)
    return least


def sketch_and_keys(text: str) -> tuple[int, int, np.ndarray]:
    """SimHash fingerprint, MinHash sketch and MinHash keys."""
    hashes = simhash.shingle_hashes(text.encode(), SHINGLE)
    least = signature(distinct_shingles(hashes))
    bits = (least[:64] * _MIX >> np.uint64(63)).astype(np.uint8)
    keys = np.arange(BANDS, dtype=np.uint64) * _MIX
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(29)
    return simhash.majority(hashes), int(np.packbits(bits, bitorder="little").view("<i8")[0]), (keys >> np.uint64(32)).astype(np.uint32).view(np.int32)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, fingerprint, sketch and keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints, fps, keys = zip(*map(sketch_and_keys, texts(part)))
                keys = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * BANDS, pa.array(np.concatenate(keys)))
                columns = [part.column("doc_id"), part.column("hash"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(fps, pa.int64()), keys]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "simhash", "fp", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ROW)


def spanning(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links of LEAST similarity that connect what such links among the sets connect."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(distinct), np.int32)
    above, below = LEAST
    left = np.ones(len(sets), bool)
    frontier: list[int] = []
    while left.any():
        if not frontier:
            frontier.append(int(left.argmax()))
            left[frontier[0]] = False
        k = frontier.pop()
        own = flat[starts[k] : starts[k] + sizes[k]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        for j in np.flatnonzero(left & ((above + below) * common >= above * (sizes + sizes[k]))).tolist():
            left[j] = False
            frontier.append(j)
            yield k, j


def _verify_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """first and node of rows whose text is alike the first text of their component."""
    above, below = LEAST
    head, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        for part in slices(batch, "text"):
            found = []
            for first, lead, node, text in zip(*(part.column(c).to_pylist() for c in ("first", "lead", "node", "text"))):
                if first != head:
                    head, own = first, shingles(lead)
                other = shingles(text)
                if (above + below) * len(np.intersect1d(own, other, assume_unique=True)) >= above * (len(own) + len(other)):
                    found.append((first, node))
            at = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], ["u", "v"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, nodes, sets = None, [], []

    def out() -> pa.RecordBatch:
        found = np.array(list(spanning(sets)), np.int64).reshape(-1, 2)
        at = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at[found[:, 0]]), pa.array(at[found[:, 1]])], ["u", "v"])

    for batch in batches:
        for part in slices(batch, "text"):
            for root, pair, node, text in zip(*(part.column(c).to_pylist() for c in ("root", "pair", "node", "text"))):
                if (root, pair) != group:
                    if len(nodes) > 1:
                        yield out()
                    group, nodes, sets = (root, pair), [], []
                nodes.append(node)
                sets.append(shingles(text))
    if len(nodes) > 1:
        yield out()


def _candidate_links(marked: DataFrame) -> DataFrame:
    """u, v: links between sketches, and fingerprints that stand for theirs, of texts that may be alike."""
    keys = materialise(marked.select(F.explode("keys").alias("key"), "fp").distinct())
    pairs = materialise(marked.select(F.col("simhash").alias("u"), F.col("fp").alias("v")).distinct())
    coded = materialise(simhash.links(pairs.select(F.col("u").alias("fp")).distinct()))
    # A fingerprint matters where it links or where sketches share it; one that equals a sketch only makes candidates.
    shared = pairs.groupBy("u").count().where("count > 1").select("u")
    matter = shared.unionByName(coded.select("u")).unionByName(coded.select(F.col("v").alias("u"))).distinct()
    return simhash.linked(keys, SKETCH).unionByName(coded).unionByName(pairs.join(matter, "u", "left_semi"))


def _candidates(marked: DataFrame) -> DataFrame:
    """doc_id, hash, node and root of the documents of candidate components of two or more; node numbers them."""
    counted = materialise(marked.groupBy("fp").agg(F.count("*").alias("n")))
    rooted = components(_candidate_links(marked), "u", "v")
    facts = counted.join(rooted, counted["fp"] == rooted["node"], "left").where("root is not null or n > 1").select("fp", "n", F.coalesce("root", "fp").alias("root"))
    found = lookup_join(marked.select("doc_id", "hash", "fp"), materialise(facts), "fp", "n", marked.count())
    return materialise(found.where("root is not null").select("doc_id", "hash", "root").distinct().withColumn("node", F.monotonically_increasing_id()))


def _blocks(count: Column) -> Column:
    return F.ceil(count / BLOCK).cast("int")


def _links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """u, v: nodes whose texts are alike, enough to connect all that are."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wanted = found.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), "node", "root")
    whole = whole.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")))
    whole = materialise(whole.select("node", "root", "text").dropDuplicates(["node"]))
    # The first text of a component goes to as many tasks as its others need.
    firsts = materialise(found.groupBy("root").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    rows = lookup_join(whole, firsts, "root", "n", found.count()).withColumn("block", F.pmod(F.xxhash64("node"), _blocks(F.col("n"))).cast("int"))
    leads = whole.join(firsts, F.col("node") == F.col("first"), "left_semi").select(F.col("node").alias("first"), F.col("text").alias("lead"))
    leads = leads.join(firsts.select("first", "n"), "first").select("first", "lead", F.explode(F.sequence(F.lit(0), _blocks(F.col("n")) - 1)).alias("block"))
    met = rows.where("node != first").join(leads, ["first", "block"]).repartition("first", "block").sortWithinPartitions("first", "block")
    alike = materialise(met.select("first", "lead", "node", "text").mapInArrow(_verify_first, "u long, v long"))
    # What is not alike the first of its component meets all others of it.
    left = found.select("node", "root").join(alike.select(F.col("v").alias("node")), "node", "left_anti").join(firsts, F.col("node") == F.col("first"), "left_anti")
    left = materialise(left.select("node", "root"))
    numbers = materialise(left.groupBy("root").agg(F.count("*").alias("odd")))
    if numbers.isEmpty():
        return alike
    facts = materialise(numbers.join(firsts, "root").select("root", "n", _blocks(F.col("odd")).alias("odd_blocks"), _blocks(F.col("n") - F.col("odd")).alias("even_blocks")))
    nodes = found.select("node", "root").join(left.select("node", F.lit(True).alias("is_odd")), "node", "left")
    nodes = lookup_join(nodes, facts, "root", "n", found.count()).where("odd_blocks is not null")
    own = F.when(F.col("is_odd"), F.pmod(F.xxhash64("node"), F.col("odd_blocks"))).otherwise(F.col("odd_blocks") + F.pmod(F.xxhash64("node"), F.col("even_blocks"))).cast("int")
    nodes = nodes.withColumn("block", own).withColumn("blocks", F.col("odd_blocks") + F.col("even_blocks"))
    # An odd block meets every other, the rest the odd ones only.
    last = F.when(F.col("is_odd"), F.col("blocks")).otherwise(F.col("odd_blocks")) - 1
    dealt = nodes.withColumn("other", F.explode(F.array_remove(F.sequence(F.lit(0), last), F.col("block"))))
    pair = (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("pair")
    met = dealt.select("root", "node", pair).join(whole.select("node", "text"), "node").repartition("root", "pair").sortWithinPartitions("root", "pair")
    return alike.unionByName(materialise(met.mapInArrow(_verify, "u long, v long")))


def _gone(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """doc_id and hash of the documents that go."""
    found = _candidates(marked)
    rooted = components(_links(docs, found), "u", "v").withColumnRenamed("root", "head")
    members = materialise(found.select("node", "doc_id", "hash").join(rooted, "node"))
    best = materialise(members.groupBy("head").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("best"), F.count("*").alias("n")))
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("hash") == F.col("best.hash"))
    return lookup_join(members, best, "head", "n", members.count()).where(~same).select(F.col("doc_id").alias("__gone_id"), F.col("hash").alias("__gone_hash"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component."""
    marked = materialise(sketches(docs))
    gone = materialise(_gone(docs, marked))
    keys = {"__parley_id": F.col("doc_id").cast("long"), "__parley_hash": text_hash()}
    match = F.col("__parley_id").eqNullSafe(F.col("__gone_id")) & (F.col("__parley_hash") == F.col("__gone_hash"))
    left = docs.withColumns(keys).join(gone, match, "left_anti")
    if not marked.groupBy("doc_id", "hash").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(list(keys))
    return left.select(*docs.columns)
