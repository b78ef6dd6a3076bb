"""Token ids in seekable files: one zstandard frame a document, a trailing seek table, a checksum a frame.

File layout: a frame for each document (its ids, little-endian, `width` bytes each), a skippable frame with the document
ids, then a skippable frame with the seek table: for each frame its compressed size, its size and the low half of the
XXH64 of its content, and a footer. A reader fetches the footer, the table and the index, then only the wanted frames.

Documents are dealt to files by ranges of doc_id, in ascending order within a file; files ascend with their number.
Null text counts as empty (only the end id); a null doc_id sorts first; rows that share a doc_id all stay, in the order
of the first HEAD characters of their text, then of its hash; they too are dealt to several files, so no id is too heavy;
an empty table gives no file. Extra columns are ignored. An id that doesn't fit into `width` bytes is an error. A file
appears under its name once whole, by a rename, so a repeated or speculative task leaves the same result; what broken-off
tasks left is removed.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import file_store, materialise, shared_folder, slices
from parley.llm.wordbpe import SLICE, encoder

# Fixed values of the seekable zstandard format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
#: version, bytes of an id, documents
INDEX_HEAD = struct.Struct("<HHQ")
FOOTER = struct.Struct("<IBI")
#: Characters of a text that order rows of one doc_id.
HEAD = 32
WRITTEN = "shard int, path string, n_docs long, n_tokens long, n_bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


class FrameWriter:
    """Appends documents to an open stream and closes it with the index and the seek table."""

    def __init__(self, out, width: int = 2, level: int = 3):
        self.out, self.width = out, width
        self.kind = f"<u{width}"
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.tokens = self.bytes = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> 8 * self.width):
            raise ValueError(f"document {doc_id}: an id doesn't fit into {self.width} bytes")
        raw = ids.astype(self.kind).tobytes()
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.tokens += len(ids)
        self.bytes += len(packed)

    def finish(self) -> None:
        known = np.array([x is not None for x in self.ids], np.uint8)
        ids = np.array([x or 0 for x in self.ids], "<i8")
        index = INDEX_HEAD.pack(1, self.width, len(ids)) + ids.tobytes() + known.tobytes()
        table = np.array([*self.entries, (8 + len(index), 0, 0)], ENTRY).tobytes()
        footer = FOOTER.pack(len(self.entries) + 1, CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table) + len(footer)) + table + footer)


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, source, size: int):
        self.source = source
        frames, flag, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("not a seekable file with checksums")
        begin = size - FOOTER.size - frames * ENTRY.itemsize
        self.entries = np.frombuffer(self._at(begin, frames * ENTRY.itemsize), ENTRY)
        self.at = np.concatenate([[0], np.cumsum(self.entries["packed"].astype(np.int64))])
        index = self._at(int(self.at[frames - 1]) + 8, int(self.entries["packed"][-1]) - 8)
        _, self.width, n = INDEX_HEAD.unpack_from(index)
        ids = np.frombuffer(index, "<i8", n, INDEX_HEAD.size)
        known = np.frombuffer(index, np.uint8, n, INDEX_HEAD.size + 8 * n)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.lengths = (self.entries["size"][:n] // self.width).astype(np.int64)
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; only its frame is read and decompressed."""
        packed, size, check = (int(x) for x in self.entries[k])
        raw = self.unpacker.decompress(self._at(int(self.at[k]), packed), max_output_size=max(size, 1))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, f"<u{self.width}")


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, width: int = 2, level: int = 3) -> DataFrame:
    """Encode documents and write them to files in ascending order of doc_id; a row for each file, with its first start.

    Returns shard, path, n_docs, n_tokens, n_bytes and start (ids in all files before it). One shuffle of the texts, by
    ranges of doc_id; every task writes one file and holds one batch at a time.
    """
    folder = folder or shared_folder(docs.sparkSession)
    store, path = file_store(docs.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        name = f"tokens-{context.partitionId():06d}.zst"
        path, draft = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        out = writer = None
        words = encoder(vocabulary)
        try:
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    if writer is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(draft)
                        writer = FrameWriter(out, width, level)
                    ids, counts = words.encode(part.column("text"))
                    ends = np.cumsum(counts)
                    for doc_id, a, b in zip(part.column("doc_id").to_pylist(), ends - counts, ends):
                        writer.add(doc_id, np.append(ids[a:b], end_id))
            if writer is None:
                return
            writer.finish()
            out.close()
            store.move(draft, path)
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(draft)
            raise
        row = [context.partitionId(), f"{folder}/{name}", len(writer.ids), writer.tokens, writer.bytes]
        yield pa.RecordBatch.from_pydict({c.split()[0]: [v] for c, v in zip(WRITTEN.split(", "), row)}, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.substring("text", 1, HEAD), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files = materialise(dealt.mapInArrow(write, WRITTEN))
    for left in store.globStatus(path.suffix("/.tokens-*")) or () if store.exists(path) else ():
        store.delete(left.getPath(), False)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(files: DataFrame, wanted: Collection[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and shard of each document, or of the wanted ones, read back from the files.

    Frames of other documents are neither fetched nor decompressed. files is what write_token_files returned.
    """
    chosen = None if wanted is None else frozenset(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as source:
                    reader = FrameReader(source, source.size())
                    starts = row["start"] + np.cumsum(reader.lengths) - reader.lengths
                    out = []
                    for k, doc_id in enumerate(reader.doc_ids):
                        if chosen is None or doc_id in chosen:
                            ids = reader.document(k)
                            out.append((doc_id, int(starts[k]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["shard"]))
                        if len(out) == 10_000 or k + 1 == len(reader.doc_ids):
                            cols = list(zip(*out)) or [()] * 5
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.int32()])], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])
                            out = []

    n = max(1, files.count())
    return files.select("shard", "path", "start").repartition(n).mapInArrow(read, READ)
