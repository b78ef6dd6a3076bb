"""Token counts kept by signed deltas.

A ledger is a folder with one small table a batch: additive changes of documents and tokens by source, language and
tokenizer version. Inserts count plus, deletes minus, a revised count its difference; a document that moves to another
source, language or version is a delete there and an insert here. Totals are the sums over all batches.

A batch is committed once. Its table is written whole under a name of its own; then a marker, named by the batch alone and
naming the table, is put in place by one step that fails if the marker is there. Of senders of one batch, at once or
again, one wins and the others' tables count for nothing, as does one that broke off. Batches may be committed at once
and in any order. ``compact`` folds batches into one table, by numbered folds that are put in place likewise, so of two
that run at once one wins; readers see the state before or after. Nothing is deleted before ``vacuum``, which removes
tables that no longer count and are older than a given age.

The one step is a hard link on a file system of the machine or of its network, elsewhere a rename that refuses an
existing target, as HDFS has it; a store without either cannot hold a ledger that several senders write to at once.

Counts are summed in each task before anything is shuffled, so a source that holds most rows costs a row a task. Null
source or language are groups of their own; null text has no tokens but is a document; repeated rows count each time; an
empty batch commits and changes nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import slices
from parley.llm.wordbpe import SLICE, encoder

KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, vocabulary: str, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer (the version), n_tokens and n_words of every row."""
    schema = "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_words long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                text = part.column("text")
                _, counts = words.encode(text)
                plain = [len((x or "").encode().split()) for x in text.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "source", "lang")), pa.array([version] * part.num_rows, pa.string()), pa.array(counts, pa.int64()), pa.array(plain, pa.int64())],
                    [c.split()[0] for c in schema.split(", ")],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))
    return rows.mapInArrow(run, schema)


def _signed(rows: DataFrame, sign: int, tokens: str) -> DataFrame:
    return rows.select(*KEYS, F.lit(sign).cast("long").alias("d_docs"), (sign * F.col(tokens)).cast("long").alias("d_tokens"))


def inserts(rows: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    return _signed(rows, 1, tokens)


def deletes(rows: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    return _signed(rows, -1, tokens)


def revisions(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Documents whose counts change in place, from column old to column new."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("d_docs"), (F.col(new) - F.col(old)).cast("long").alias("d_tokens"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The deltas between two snapshots of counts, a row a doc_id each: what came, what went, what changed or moved."""
    old, new = before.select("doc_id", *KEYS, "n_tokens").alias("o"), after.select("doc_id", *KEYS, "n_tokens").alias("n")
    same = F.lit(True)
    for c in (*KEYS, "n_tokens"):
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    met = old.withColumn("here", F.lit(True)).alias("o").join(new.withColumn("here", F.lit(True)).alias("n"), F.col("o.doc_id") == F.col("n.doc_id"), "full")
    met = met.where(~(F.coalesce("o.here", F.lit(False)) & F.coalesce("n.here", F.lit(False)) & same))
    gone = deletes(met.where("o.here").select("o.*"))
    return gone.unionByName(inserts(met.where("n.here").select("n.*")))


class Ledger:
    """The batches of one folder, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.store = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(f.getPath().getName() for f in self.store.listStatus(path)) if self.store.exists(path) else []

    def _read(self, name: str) -> dict:
        stream = self.store.open(self._path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _claim(self, name: str, record: dict) -> bool:
        """Put a record in place under a name; False if the name is taken, whoever took it."""
        draft = f"drafts/{uuid.uuid4().hex}"
        out = self.store.create(self._path(draft), False)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        self.store.mkdirs(self._path(name).getParent())
        try:
            if self.store.getScheme() == "file":
                os.link(*(self.store.makeQualified(self._path(x)).toUri().getPath() for x in (draft, name)))
            else:
                kind = self.jvm.org.apache.hadoop.fs.Options.Rename
                target = self.store.makeQualified(self._path(name))
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
                context.rename(self.store.makeQualified(self._path(draft)), target, self.spark._sc._gateway.new_array(kind, 0))
            return True
        except (FileExistsError, Py4JJavaError) as e:
            if isinstance(e, Py4JJavaError) and "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        finally:
            self.store.delete(self._path(draft), False)

    def _write(self, deltas: DataFrame) -> str:
        """The sums of deltas as a table of its own; its name."""
        name = f"tables/{uuid.uuid4().hex}"
        summed = deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        summed.write.parquet(f"{self.folder}/{name}")
        return name

    def _state(self) -> tuple[int, dict, dict[str, dict]]:
        """The number of the last fold, that fold, and the markers of batches that aren't in it."""
        folds = self._names("folds")
        fold = self._read(f"folds/{folds[-1]}") if folds else {"tables": [], "batches": {}}
        open_ = [n for n in self._names("batches") if n not in fold["batches"]]
        return len(folds), fold, {n: self._read(f"batches/{n}") for n in open_}

    def _changes(self, fold: dict, markers: dict[str, dict]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
        tables = fold["tables"] + [m["table"] for m in markers.values()]
        if not tables:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{t}" for t in tables))

    def batches(self) -> list[str]:
        """Names of committed batches, those that were folded too."""
        _, fold, markers = self._state()
        return sorted([*fold["batches"].values(), *(m["batch"] for m in markers.values())])

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of deltas under any name that isn't empty; False if it was there already, or another sender won."""
        if not batch:
            raise ValueError("a batch has a name")
        marker = f"batches/{hashlib.sha256(batch.encode()).hexdigest()}"
        if self.store.exists(self._path(marker)):
            return False
        return self._claim(marker, {"batch": batch, "table": self._write(deltas)})

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, lang and tokenizer; groups without any document or token are left out."""
        _, fold, markers = self._state()
        summed = self._changes(fold, markers).groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return summed.where("n_docs != 0 or n_tokens != 0")

    def compact(self) -> bool:
        """Fold all batches into one table; False if there is nothing to fold or another fold came first."""
        number, fold, markers = self._state()
        if not markers:
            return False
        table = self._write(self._changes(fold, markers))
        return self._claim(f"folds/{number + 1:012d}", {"tables": [table], "batches": fold["batches"] | {n: m["batch"] for n, m in markers.items()}})

    def vacuum(self, hours: float = 24) -> int:
        """Delete tables that don't count and are older than hours, longer than any commit or read takes; how many went."""
        _, fold, markers = self._state()
        used = {*fold["tables"], *(m["table"] for m in markers.values())}
        path = self._path("tables")
        gone = 0
        for f in self.store.listStatus(path) if self.store.exists(path) else ():
            if f"tables/{f.getPath().getName()}" not in used and f.getModificationTime() <= 1000 * (time.time() - 3600 * hours):
                self.store.delete(f.getPath(), True)
                gone += 1
        return gone
