"""Quality rules on repetition, from a suffix array of each text's characters.

Base rules: under MIN_WORDS words, or over MAX_REPEATED percent of them in three-word windows found twice or more. Texts
that fail them are not kept, whatever the rest of their measures; the method judges all others.

The method: a batch of texts, runs of white space as one space, is one sequence of characters; a text's number leads the
sort key of its suffixes, so nothing repeats across texts. Prefix doubling ranks the suffixes, a word of packed characters
first; after a round only ties go on. The ranks of every round also give the longest common prefix of neighbours in the
suffix array. A suffix's longest repeat is the longer of its two common prefixes; where the one before it in the text is
longer by exactly one the repeat is the rest of that one and not maximal to the left. Maximal repeats that are longer than
chance count, and the union of their spans is the repeated part. A text is rejected if that part is over MAX_COVERED of
its characters or its longest repeat over MAX_LONGEST characters.

Longer than chance: the longest repeat of a random text of n characters is about 2 log2(n) / h, h being its entropy a
character in bits. No prose has under two bits, so repeats longer than log2(n) are not chance at any n, and one share
holds for texts of every length. MAX_COVERED is a fifth, the share from which published rules for training data (Rae et
al. 2021) hold a text's commonest word pair against it. MAX_LONGEST is the 50 words of five letters from which published substring
deduplication (Lee et al. 2022) holds a repeat for a copy. Ranking stops beyond MAX_LONGEST characters: longer repeats
reject a text whatever their length, and longest_repeat says no more than that they are longer.

A frame is not held against a text: lines that open it and close it alike, a letterhead or a licence line, count once if
they are at most a quarter of it and MAX_LONGEST characters. A third copy counts as a repeat.

Null text has no words and fails; so does one of white space only. Null or repeated doc_ids are judged row by row, an
empty table gives no rows, extra columns are ignored by ``judge`` and kept by ``keep_good``. covered_chars and
longest_repeat are null where a base rule failed. A text is judged whole by one task, at some 80 bytes a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import slices

MIN_WORDS = 50
MAX_REPEATED = 50
WINDOW = 3
MAX_COVERED = 0.2
MAX_LONGEST = 250
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
SLICE = 1 << 20

JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_chars long, longest_repeat long, base_failed boolean, kept boolean"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def first_keys(symbols: np.ndarray, doc: np.ndarray, left: np.ndarray, most: int) -> tuple[np.ndarray, int, int]:
    """The number of each position's text and the symbols (1 and up) from there, as many as fit into a word and most at
    most; how many, and the bits of one. Places past the end of the text are 0."""
    bits = int(symbols.max(initial=1)).bit_length()
    width = max(min((63 - int(doc[-1]).bit_length()) // bits, most), 1)
    keys = doc.astype(np.int64)
    for k in range(width):
        keys <<= bits
        keys[: len(symbols) - k] |= np.where(left[: len(symbols) - k] > k, symbols[k:], 0)
    return keys, width, bits


def suffix_ranks(keys: np.ndarray, width: int, left: np.ndarray, top: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and for k = 0, 1, ... the rank of each suffix by its first width * 2^k symbols, until they are
    top or all ranks differ. Suffixes alike that far keep the order in which they were sorted."""
    n = len(keys)
    order = np.argsort(keys)
    new = np.ones(n, bool)
    new[1:] = np.diff(keys[order]) != 0
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    levels = [rank]
    while width < top:
        # Members of a class share a rank, the place of its first member; only classes of several are sorted again.
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        ahead = np.where(left[at] > width, rank[np.minimum(at + width, n - 1)] + 1, 0)
        both = rank[at].astype(np.int64) << 32 | ahead
        again = np.argsort(both)
        order[tied] = at = at[again]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = np.diff(both[again]) != 0
        new[tied] = fresh
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
        levels.append(rank)
        width *= 2
    return order, levels


def longest_repeats(symbols: np.ndarray, doc: np.ndarray, left: np.ndarray, least: int, top: int) -> np.ndarray:
    """For each position, how far the text from it is found elsewhere in the same text too. Lengths under least may be
    told as 0, those over top too short, but over top.

    symbols: 1 and up; doc: number of each position's text, ascending; left: positions up to its end.
    """
    n = len(symbols)
    found = np.zeros(n, np.int64)
    if n < 2:
        return found
    keys, width, bits = first_keys(symbols, doc, left, least)
    order, levels = suffix_ranks(keys, width, left, top + 1)
    # Common prefixes of neighbours that share their first word; the others' are shorter than one.
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    first, second = order[near], order[near + 1]
    a, b = first.copy(), second.copy()
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[rank[a[inside]] == rank[b[inside]]]
        a[same] += width << k
        b[same] += width << k
    inside = np.flatnonzero((a < n) & (b < n))
    differ = keys[a[inside]] ^ keys[b[inside]]
    for k in range(1, width + 1):
        a[inside[differ >> bits * (width - k) == 0]] += 1
    np.maximum.at(found, first, a - first)
    np.maximum.at(found, second, a - first)
    return found


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a run of the given starts and lengths."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def chance(n: np.ndarray) -> np.ndarray:
    """The longest repeat that a text of n characters may have by chance."""
    return np.log2(np.maximum(n, 2))


def without_frame(text: str, most: int = MAX_LONGEST) -> str:
    """The text without the lines that close it as others opened it, if they are a quarter of it and most at most."""
    text = text.strip(WHITE)
    lines = text.split("\n")
    fits, size = 0, 0
    for k in range(1, len(lines) // 2 + 1):
        size += len(lines[k - 1]) + 1
        if 4 * (size - 1) > len(text) or size - 1 > most:
            break
        if lines[:k] == lines[-k:]:
            fits = k
    return "\n".join(lines[: len(lines) - fits])


def repetition(rows: list[str], max_longest: int = MAX_LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of each text, runs of white space as one, without its frame; how many lie in repeats longer than chance;
    and the longest of these, max_longest + 1 standing for any longer one."""
    # Bytes split at ASCII white space, strings at more.
    flat = [b" ".join(without_frame(t, max_longest).encode().split()).decode() for t in rows]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    n = int(sizes.sum())
    doc = np.repeat(np.arange(len(flat)), sizes)
    if not n:
        return sizes, sizes, sizes
    ends = np.cumsum(sizes)
    at = np.arange(n)
    points = np.frombuffer("".join(flat).encode("utf-32-le"), "<u4")
    symbols = np.cumsum(np.bincount(points) > 0)[points]
    limits = np.floor(chance(sizes)).astype(np.int64) + 1
    longest = longest_repeats(symbols, doc, ends[doc] - at, int(limits[sizes > 0].min()), max_longest)
    before = np.concatenate([[0], longest[:-1]])
    before[(ends - sizes)[sizes > 0]] = 0
    counts = np.flatnonzero(longest >= limits[doc])
    maximal = counts[before[counts] != longest[counts] + 1]
    inside = covered(maximal, longest[maximal], n)
    most = np.zeros(len(flat), np.int64)
    np.maximum.at(most, doc[maximal], np.minimum(longest[maximal], max_longest + 1))
    return sizes, np.bincount(doc[inside], minlength=len(flat)), most


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each key among the distinct ones, and how often each of them occurs."""
    _, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return number, counts


def repeated_windows(symbols: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Positions at which a window starts that occurs twice or more."""
    if len(symbols) < size:
        return np.zeros(0, np.int64)
    number, counts = ranked(symbols)
    window = number
    for k in range(1, size):
        window, counts = ranked(window[: len(symbols) - k] << 32 | number[k:])
    return np.flatnonzero(counts[window] > 1)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text of a column without nulls."""
    lists = pc.ascii_split_whitespace(column)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(column)), np.diff(offsets))
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[real]
    doc = doc[real]
    n_docs, n = len(column), len(doc)
    # A symbol for each word of each text: no window of one text is one of another, or crosses into it twice.
    starts = repeated_windows(doc * (int(codes.max(initial=0)) + 1) + codes)
    in_window = covered(starts, np.full(len(starts), WINDOW), n)
    rows = column.to_pylist()
    lines = [[x for x in t.split("\n") if x.strip(WHITE)] for t in rows]
    return {
        "n_words": np.bincount(doc, minlength=n_docs),
        "word_chars": np.array([len(t) - sum(map(t.count, WHITE)) for t in rows], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in rows], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": np.bincount(doc[in_window], minlength=n_docs),
    }


def verdicts(column: pa.Array, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray]:
    """The counts of each text, whether a base rule fails it, and whether it is kept."""
    column = pc.fill_null(column.cast(pa.string()), "")
    m = measure(column)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])
    left = np.flatnonzero(~failed)
    sizes, inside, most = repetition(column.take(pa.array(left)).to_pylist(), max_longest)
    kept = np.zeros(len(column), bool)
    kept[left] = (inside <= max_covered * sizes) & (most <= max_longest)
    out = {k: pa.array(v.astype(np.int64)) for k, v in m.items()}
    for name, values in (("covered_chars", inside), ("longest_repeat", most)):
        whole = np.zeros(len(column), np.int64)
        whole[left] = values
        out[name] = pa.array(whole, mask=failed)
    return out, failed, kept


def judge(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The counts and verdicts of every row; columns of JUDGED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                m, failed, kept = verdicts(part.column("text"), max_covered, max_longest)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *m.values(), pa.array(failed), pa.array(kept)], ["doc_id", *m, "base_failed", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, JUDGED)


def keep_good(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """docs without the rows that fail, all columns kept, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield part.filter(pa.array(verdicts(part.column("text"), max_covered, max_longest)[2]))

    return docs.mapInArrow(run, docs.schema)
