"""Incremental ingestion of media: each file is transcribed once, whatever the number of runs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from parley.operators.models import Factory, transcribe
from parley.sources.media import GLOB

MEDIA = "path string, modificationTime timestamp, length bigint, content binary"


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, factory: Factory, clean: bool = False, by_path: bool = False) -> StreamingQuery:
    """Transcribe the files that are new since the last run, append them to out, and stop. clean deletes done files;
    by_path hands the provider paths alone and reads no content."""
    source = spark.readStream.format("binaryFile").schema(MEDIA).option("pathGlobFilter", GLOB)
    if clean:
        source = source.option("cleanSource", "delete")
    files = source.load(folder)
    rows = transcribe(files.select("path") if by_path else files, factory)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
