"""Keyword search over utterances, or over lines where there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import contains_ci, highlight, minutes_seconds


def search(utterances: DataFrame, query: str) -> DataFrame:
    """Utterances that hold the query, literally and whatever its case; all of them for an empty one."""
    return utterances.where(contains_ci(F.col("text"), query)) if query else utterances


def search_lines(transcripts: DataFrame, query: str) -> DataFrame:
    """transcript_id, line, text of matching lines, for transcripts without utterances."""
    lines = transcripts.select("transcript_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return search(lines, query)


def count_matches(utterances: DataFrame, query: str) -> DataFrame:
    """transcript_id, n_matches; transcripts without a match have zero."""
    hit = contains_ci(F.col("text"), query) if query else F.lit(True)
    return utterances.groupBy("transcript_id").agg(F.count_if(hit).alias("n_matches"))


def display(utterances: DataFrame, query: str = "") -> DataFrame:
    """transcript_id, pos, speaker, time and text, with matches marked up."""
    return utterances.select(
        "transcript_id", "pos", F.coalesce("speaker", F.lit("Unknown")).alias("speaker"),
        minutes_seconds(F.coalesce("start_ms", F.lit(0))).alias("time"), highlight(F.coalesce("text", F.lit("")), query).alias("text"),
    )


def highlighted(utterances: DataFrame, query: str) -> DataFrame:
    """Matching utterances as display lines: time, a bar, and the text with its matches marked up."""
    rows = display(search(utterances, query), query)
    return rows.select("transcript_id", "pos", "speaker", F.concat(F.lit("_"), "time", F.lit("_ | "), "text").alias("line"))
