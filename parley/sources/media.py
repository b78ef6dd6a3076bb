"""Recorded media: the scan, the list of accepted types, and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import extension

# Accepted extensions and the MIME type of each.
MIME_TYPES = {
    ".flac": "audio/flac",
    ".m4a": "audio/mp4",
    ".mkv": "video/x-matroska",
    ".mov": "video/quicktime",
    ".mp3": "audio/mpeg",
    ".mp4": "video/mp4",
    ".ogg": "audio/ogg",
    ".wav": "audio/wav",
    ".webm": "video/webm",
}
# Further MIME types that are accepted.
OTHER_TYPES = ("audio/x-wav", "audio/webm")
GLOB = "*.{" + ",".join(e[1:] for e in MIME_TYPES) + "}"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of every accepted file; columns that aren't used aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").load(folder)


def mime_type(name: Column) -> Column:
    """The MIME type by extension, null if it isn't accepted."""
    table = F.create_map(*(F.lit(x) for pair in MIME_TYPES.items() for x in pair))
    return F.try_element_at(table, F.lower(extension(name)))


def accepted(mime: Column) -> Column:
    return F.coalesce(mime.isin(*MIME_TYPES.values(), *OTHER_TYPES), F.lit(False))


def staged_name(path: Column) -> Column:
    """A new random name for a file, its extension kept; another one each time it is computed."""
    return F.concat(F.uuid(), extension(path))


def rejects(files: DataFrame, name: str, mime: str) -> DataFrame:
    """source_path, stage, code and detail of files of other types."""
    listed = ", ".join(sorted({*MIME_TYPES.values(), *OTHER_TYPES}))
    detail = F.concat(F.lit("unsupported type "), F.coalesce(F.col(mime), F.lit("unknown")), F.lit(f"; accepted: {listed}"))
    return files.where(~accepted(F.col(mime))).select(F.col(name).alias("source_path"), F.lit("upload").alias("stage"), F.lit(415).alias("code"), detail.alias("detail"))
