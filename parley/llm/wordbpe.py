"""Batch encoding by a `tokenizers` vocabulary that drops white space, with each distinct word encoded once a worker.

The vocabulary's own splitter never lets a token cross white space, so a text's ids are those of its words in turn.
Words are cut at ASCII white space only, which the splitter drops too; any other white space stays inside a word and
is left to the library. Every id comes from the library; the memory of words is bounded and only saves time: when it is
full, the half of the words that most slices of texts had stays.

Words of Latin letters and closing marks are two matches of the splitter each, the letters and the marks. Their letters
are lower-cased here and given to the library's model without its normaliser and splitter, which would leave them as
they are. All other words go through the whole tokenizer.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words remembered by a worker before it forgets half of them (some 70 MB).
MAX_WORDS = 200_000
#: Texts are encoded in slices of about so many bytes; each takes some twenty times as much while it is worked on.
SLICE = 2 << 20
#: Marks that the splitter never joins to a letter before them, at the end of a word.
MARKS = string.punctuation
#: Latin letters but U+0130, whose lower case has two code points; then closing marks.
PLAIN = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]+"
IS_PLAIN = f"^{PLAIN}[{re.escape(MARKS)}]*$"


def _byte_letters() -> np.ndarray:
    """The code point that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = np.zeros(256, "<u4")
    letters[shown] = shown
    rest = [b for b in range(256) if b not in set(shown)]
    letters[rest] = 256 + np.arange(len(rest))
    letters[0x0A] = 0x0A
    return letters


BYTE_LETTERS = _byte_letters()


def as_bytes(words: list[str]) -> list[str]:
    """Each word with its UTF-8 bytes written as a byte-level vocabulary writes them."""
    raw = np.frombuffer("\n".join(words).encode(), np.uint8)
    return BYTE_LETTERS[raw].tobytes().decode("utf-32-le").split("\n")


def gather(store: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of store one after the other, and where each begins (one more, the end)."""
    ends = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    return store[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])], ends


def strings(column: pa.Array) -> list[str]:
    """The words of a column without white space in them."""
    if not len(column):
        return []
    one = pa.LargeListArray.from_arrays(pa.array([0, len(column)], pa.int64()), column.cast(pa.large_string()))
    return pc.binary_join(one, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n")


def grown(values: np.ndarray, size: int) -> np.ndarray:
    """The array with zeros at its end, at least size long."""
    more = size - len(values)
    return values if more <= 0 else np.concatenate([values, np.zeros(max(more, len(values)), values.dtype)])


class WordEncoder:
    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        parts = json.loads(self.whole.to_str()) | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(parts))
        self.max_words = max_words
        #: Words in the order of their slots; the empty one is always the first.
        self.slot: dict[str, int] = {"": 0}
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        #: In how many slices each word was, halved whenever some are forgotten.
        self.seen = np.zeros(1 << 16, np.int32)
        self.store = np.zeros(1 << 20, np.int32)
        self.used = 0

    def forget(self) -> None:
        """Keep the half of the words that most slices had, of equal ones the newer."""
        n = len(self.slot)
        rest = np.argsort(self.seen[1:n], kind="stable")[max(n - 1 - self.max_words // 2, 0) :] + 1
        kept = np.concatenate([[0], np.sort(rest)])
        words = list(self.slot)
        self.slot = {words[k]: i for i, k in enumerate(kept.tolist())}
        self.store, ends = gather(self.store, self.start[kept], self.length[kept])
        self.start, self.length, self.seen = ends[:-1], self.length[kept], self.seen[kept] >> 1
        self.used = len(self.store)

    def _put(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        k = len(self.slot)
        self.slot.update(zip(words, range(k, k + len(words))))
        self.start, self.length, self.seen = (grown(x, k + len(words)) for x in (self.start, self.length, self.seen))
        self.store = grown(self.store, self.used + len(ids))
        self.length[k : k + len(words)] = lengths
        self.start[k : k + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.store[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn_plain(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            coded = self.model.encode(as_bytes(some), is_pretokenized=True, add_special_tokens=False)
            self._put(some, np.array(coded.ids, np.int32), np.bincount(np.array(coded.word_ids, np.int64), minlength=len(some)))

    def _learn_whole(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            coded = [e.ids for e in self.whole.encode_batch_fast(some, add_special_tokens=False)]
            flat = np.fromiter(itertools.chain.from_iterable(coded), np.int32)
            self._put(some, flat, np.fromiter(map(len, coded), np.int64, len(coded)))

    def _slots(self, column: pa.Array, learn) -> np.ndarray:
        """The slot of every word of a column; new ones are learnt."""
        coded = column.dictionary_encode()
        words = strings(coded.dictionary)
        slots = np.fromiter(map(self.slot.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            slots[missing] = len(self.slot) + np.arange(len(missing))
            learn([words[k] for k in missing.tolist()])
        self.seen[slots] += 1
        return slots[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else slots

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts in turn, and the number of each text's; null counts as empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(column), np.int64)
        if len(self.slot) > self.max_words:
            self.forget()
        plain = pc.match_substring_regex(words, IS_PLAIN)
        where = plain.to_numpy(zero_copy_only=False).astype(bool)
        slots = np.zeros((len(words), 2), np.int64)
        easy = words.filter(plain)
        slots[where, 0] = self._slots(pc.utf8_lower(pc.utf8_rtrim(easy, MARKS)), self._learn_plain)
        slots[where, 1] = self._slots(pc.replace_substring_regex(easy, f"^{PLAIN}", ""), self._learn_whole)
        slots[~where, 0] = self._slots(words.filter(pc.invert(plain)), self._learn_whole)
        slots = slots.ravel()
        store, starts = gather(self.store, self.start[slots], self.length[slots])
        starts = starts[::2]
        index = coded.indices.to_numpy(zero_copy_only=False)
        ids, ends = gather(store, starts[:-1][index], np.diff(starts)[index])
        return ids, np.diff(ends[offsets - offsets[0]])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
