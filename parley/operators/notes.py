"""Meeting notes: merging summaries with action items, and their renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import bullets, or_default, strip

# Texts of the export.
NO_SUMMARY = "No summary available"
NO_ITEMS = "No specific action items identified."
NO_TRANSCRIPT = "No transcript available."


def merge(summaries: DataFrame, items: DataFrame) -> DataFrame:
    """Summaries (transcript_id, summary, summary_error) with their action items (action_items, items_error).

    A failed summary discards its items; if both failed the items' error stands for the summary's.
    """
    met = summaries.join(items, "transcript_id", "left")
    bad = F.col("summary_error").isNotNull()
    return met.select(
        "transcript_id", F.when(~bad, F.col("summary")).alias("summary"),
        F.when(bad, F.coalesce("items_error", "summary_error")).alias("summary_error"),
        F.when(bad, F.array().cast("array<string>")).otherwise(F.coalesce("action_items", F.array().cast("array<string>"))).alias("action_items"),
        F.when(~bad, F.col("items_error")).alias("action_items_error"),
    )


def bullet_lines(items: Column) -> Column:
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, F.array_join(bullets(items), "\n")).otherwise(NO_ITEMS)


def as_text(summary: Column, items: Column, transcript: Column) -> Column:
    """The notes as one text."""
    return strip(
        F.concat(
            F.lit("Meeting Notes\n\nSummary:\n"), F.coalesce(summary, F.lit(NO_SUMMARY)), F.lit("\n\nAction Items:\n"), bullet_lines(items),
            F.lit("\n\nTranscript:\n"), or_default(transcript, NO_TRANSCRIPT),
        )
    )


def as_csv_row(notes: DataFrame) -> DataFrame:
    """transcript_id and the three columns of the CSV export."""
    return notes.select(
        "transcript_id", F.coalesce("summary", F.lit(NO_SUMMARY)).alias("Summary"),
        F.array_join(F.coalesce("action_items", F.array().cast("array<string>")), "; ").alias("Action Items"), or_default(F.col("text"), NO_TRANSCRIPT).alias("Transcript"),
    )


def paragraphs(summary: Column, items: Column, transcript: Column) -> Column:
    """The notes as an array of (style, text) for documents."""
    line = lambda style, text: F.struct(F.lit(style).alias("style"), text.alias("text"))
    items = F.coalesce(items, F.array().cast("array<string>"))
    listed = F.when(F.size(items) > 0, F.transform(items, lambda x: line("ListBullet", x))).otherwise(F.array(line("Normal", F.lit(NO_ITEMS))))
    return F.concat(
        F.array(line("Title", F.lit("Meeting Notes")), line("Heading1", F.lit("Summary")), line("Normal", F.coalesce(summary, F.lit(NO_SUMMARY))), line("Heading1", F.lit("Action Items"))),
        listed, F.array(line("Heading1", F.lit("Transcript")), line("Normal", or_default(transcript, NO_TRANSCRIPT))),
    )
