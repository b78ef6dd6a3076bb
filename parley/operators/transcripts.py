"""Assembling transcripts: projections, ordered collection, full text, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("speaker", "start_ms", "end_ms", "text", "confidence")


def normal_status(status: Column) -> Column:
    """completed or error, also from the rendering of an enumeration's member."""
    return F.lower(F.substring_index(status, ".", -1))


def succeeded(status: Column) -> Column:
    return F.coalesce(normal_status(status) == "completed", F.lit(False))


def failed(status: Column) -> Column:
    return F.coalesce(normal_status(status) == "error", F.lit(False))


def collect(utterances: DataFrame) -> DataFrame:
    """transcript_id and utterances, a list in order of pos."""
    listed = F.sort_array(F.collect_list(F.struct("pos", *FIELDS)))
    projected = F.transform(listed, lambda u: F.struct(*(u[f].alias(f) for f in FIELDS)))
    return utterances.groupBy("transcript_id").agg(projected.alias("utterances"))


def explode(transcripts: DataFrame) -> DataFrame:
    """The utterances of transcripts again as rows; null lists give none."""
    return transcripts.select("transcript_id", F.posexplode("utterances").alias("pos", "u")).select("transcript_id", "pos", "u.*")


def full_text(utterances: DataFrame) -> DataFrame:
    """transcript_id and text, the utterances joined by line ends in order of pos."""
    return utterances.groupBy("transcript_id").agg(F.expr("listagg(text, '\\n') within group (order by pos)").alias("text"))


def project(transcripts: DataFrame) -> DataFrame:
    """One row a transcript: a failed one has only status, id and error; others an empty list instead of null."""
    bad = failed(F.col("status"))
    unless = lambda c: F.when(~bad, F.col(c)).alias(c)
    listed = F.when(~bad, F.coalesce("utterances", F.expr("cast(array() as array<struct<speaker:string,start_ms:bigint,end_ms:bigint,text:string,confidence:double>>)"))).alias("utterances")
    return transcripts.select("transcript_id", "source_path", normal_status(F.col("status")).alias("status"), unless("text"), unless("language_code"), listed, F.when(bad, F.col("error")).alias("error"))


def has_language(code: Column) -> Column:
    return F.nullif(code, F.lit("")).isNotNull()


def has_any(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 0
