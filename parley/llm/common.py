"""Shared plumbing: table access, durable intermediates, bounded Arrow slices, skew-safe lookup joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python kernels work through a batch in slices of about this many bytes of text.
SLICE_BYTES = 8 << 20

#: A key counts as heavy when it holds at least one in this many rows, so there are at most that many heavy keys.
HEAVY_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_store(spark: SparkSession, folder: str) -> tuple:
    """The file system of a folder and its path there, on the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder, which goes when the session's JVM ends.

    Without that setting only a session whose executors live in this process may use a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        base = tempfile.mkdtemp(prefix="parley-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/parley-{uuid.uuid4().hex}"
    store, path = file_store(spark, folder)
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder


def materialise(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table"
    (df.select(*cols) if cols else df).write.parquet(path)
    out = spark.read.schema((df.select(*cols) if cols else df).schema).parquet(path)
    out._parley_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise wrote, once nothing reads it any more."""
    for df in tables:
        store, path = file_store(df.sparkSession, df._parley_path)
        store.delete(path, True)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose text column holds about limit bytes; a longer row stands alone."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        done = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, done + limit, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings, null as the empty one."""
    return [x or "" for x in batch.column(column).to_pylist()]


def lookup_join(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows left-joined with facts, one row a key, without gathering a heavy key's rows in one task.

    facts has a column ``weight``, the number of rows of each key. Keys with at least total / HEAVY_SHARE rows are
    HEAVY_SHARE at most and are broadcast; all others meet in a shuffled join. Null keys match each other.
    """
    least = max(2, -(-total // HEAVY_SHARE))
    names = [c for c in facts.columns if c != key]
    facts = facts.withColumnRenamed(key, "__key")
    heavy = facts.where(F.col(weight) >= least).withColumn("__hit", F.lit(True))
    light = facts.where(F.col(weight) < least)
    seen = rows.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    hit = seen.where(F.col("__hit")).drop("__hit")
    rest = rows.join(F.broadcast(heavy.select(F.col("__key").alias("__heavy"))), F.col(key).eqNullSafe(F.col("__heavy")), "left_anti")
    cold = rest.join(light, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    order = [*rows.columns, *names]
    return hit.select(*order).unionByName(cold.select(*order))
