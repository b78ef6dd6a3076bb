"""Byte-level BPE as a reduction over a binary tree.

Encoding halves a text down to leaves, encodes the leaves, and joins neighbours. A join re-encodes a window around the
border and grows it until the tokens outside cannot change, which holds at an edge that is

* a match border: a space, tab or line end after a character that is not white space. No match of the splitter runs over
  one, and what comes before or after it is split alike with and without the other side; or
* inside one match, with the tokens on both sides a stable pair, that is, the two encoded together give the two. A row
  of tokens is the encoding of its bytes exactly if every neighbouring pair in it is stable, and each other pair
  comes from an encoding already.

So a join costs what its window costs, however long the halves are, and the tokens are those of the whole text. Decoding
joins the bytes of halves up the same kind of tree.

Null text counts as empty (no ids); null or repeated doc_ids are encoded row by row; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import slices, texts

#: Characters in a leaf.
LEAF = 1024
#: How far a match border is looked for before windows of tokens are tried.
REACH = 64
BREAKS = frozenset(" \t\n\r")
CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _kind(char: str) -> str:
    """letter, digit, mark or space; empty for characters on which no claim is made."""
    kind = unicodedata.category(char)
    if kind[0] == "L":
        return "letter"
    if kind == "Nd":
        return "digit"
    if kind[0] in "PS":
        return "mark"
    return "space" if char in BREAKS else ""


def inside_match(text: str, x: int, low: int, high: int) -> bool:
    """Whether text[low:high] alone shows that a match runs over x, and that one from x on would end where it does."""
    if x - 3 < low or x + 2 > high:
        return False
    kind = _kind(text[x])
    if not kind or _kind(text[x - 1]) != kind or text[x] == "'":
        return False
    if kind == "letter":  # three letters after a quote or more, so not the end of a contraction
        return _kind(text[x - 2]) == kind and _kind(text[x - 3]) == kind
    if kind == "space":  # the last space of several goes with the word after it
        return _kind(text[x + 1]) == kind
    return True


class TreeBpe:
    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF, reach: int = REACH):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("parley", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()}
        self.leaf, self.reach = max(leaf, 1), reach
        self.stable: dict[tuple[int, int], bool] = {}

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self.leaf:
            return self.coder.encode_ordinary(text[low:high])
        middle = (low + high) // 2
        return self.join(text, low, middle, high, self._encode(text, low, middle), self._encode(text, middle, high))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])

    def join(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[low:high] from those of its two parts."""
        a = next((k for k in range(middle, max(low, middle - self.reach), -1) if text[k] in BREAKS and not text[k - 1].isspace()), None)
        b = a if a == middle else next((k for k in range(middle + 1, min(high, middle + self.reach)) if text[k] in BREAKS and not text[k - 1].isspace()), None)
        if a is None and middle - low <= self.reach:
            a = low
        if b is None and high - middle <= self.reach:
            b = high
        if a is None or b is None:
            return self._grow(text, low, middle, high, left, right)
        i = self._back(left, len(text[a:middle].encode()))
        j = self._ahead(right, len(text[middle:b].encode()))
        return left[:i] + self.coder.encode_ordinary(text[a:b]) + right[j:]

    def _back(self, ids: list[int], n: int) -> int:
        i = len(ids)
        while n > 0:
            i -= 1
            n -= len(self.bytes[ids[i]])
        return i

    def _ahead(self, ids: list[int], n: int) -> int:
        j = 0
        while n > 0:
            n -= len(self.bytes[ids[j]])
            j += 1
        return j

    def _pair(self, a: int, b: int) -> bool:
        if (known := self.stable.get((a, b))) is None:
            if len(self.stable) > 200_000:
                self.stable.clear()
            known = self.stable[a, b] = self.coder._encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def _grow(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
        """The same where no match border is near: windows of 8, 16, 32, ... tokens on either side."""
        i, x = self._cut_left(text, low, middle, left, 8)
        j, y = self._cut_right(text, middle, high, right, 8)
        while True:
            window = self.coder.encode_ordinary(text[x:y])
            left_ok = x == low or self._border(text, x, low, middle) or bool(window) and self._pair(left[i - 1], window[0])
            right_ok = y == high or self._border(text, y, middle, high) or bool(window) and self._pair(window[-1], right[j])
            if left_ok and right_ok:
                return left[:i] + window + right[j:]
            if not left_ok:
                i, x = self._cut_left(text, low, middle, left, 2 * (len(left) - i))
            if not right_ok:
                j, y = self._cut_right(text, middle, high, right, 2 * j)

    def _border(self, text: str, x: int, low: int, high: int) -> bool:
        return low < x < high and text[x] in BREAKS and not text[x - 1].isspace()

    def _cut_left(self, text: str, low: int, middle: int, ids: list[int], n: int) -> tuple[int, int]:
        """The last place at least n tokens back where an edge can be shown to hold: tokens before it, its position."""
        raw, i, x = b"", len(ids), middle
        part: list[bytes] = []
        while i > 0:
            i -= 1
            part.append(self.bytes[ids[i]])
            if len(ids) - i >= n and part[-1][0] & 0xC0 != 0x80:
                raw = b"".join(reversed(part))
                x = middle - sum(c & 0xC0 != 0x80 for c in raw)
                if self._border(text, x, low, middle) or inside_match(text, x, low, middle):
                    return i, x
        return 0, low

    def _cut_right(self, text: str, middle: int, high: int, ids: list[int], n: int) -> tuple[int, int]:
        """The first place at least n tokens on where an edge can be shown to hold: tokens before it, its position."""
        y = middle
        for j, token in enumerate(ids):
            if j >= n and self.bytes[token][0] & 0xC0 != 0x80 and (self._border(text, y, middle, high) or inside_match(text, y, middle, high)):
                return j, y
            y += sum(c & 0xC0 != 0x80 for c in self.bytes[token])
        return len(ids), high


_CODERS: dict[tuple, TreeBpe] = {}


def coder(ranks_path: str, pattern: str, leaf: int = LEAF) -> TreeBpe:
    """This worker's coder of a rank file."""
    key = (ranks_path, pattern, leaf)
    if key not in _CODERS:
        _CODERS[key] = TreeBpe(*key)
    return _CODERS[key]


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """Number and digest of every text's ids, and the digest of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = coder(ranks_path, pattern, leaf)
        names = {i: str(i) for i in tree.bytes}
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text in texts(part):
                    ids = tree.encode(text)
                    listed = ",".join(map(names.__getitem__, ids)).encode()
                    out.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(tree.decode(ids)).hexdigest()))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.string(), pa.string()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], [c.split()[0] for c in CODED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, CODED)


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids, an array, of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = coder(ranks_path, pattern, leaf)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids = pa.array([tree.encode(t) for t in texts(part)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")
