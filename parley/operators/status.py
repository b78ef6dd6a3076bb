"""Guards, error codes and the status of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The code of each kind of failure; any other is 500.
CODES = {"ValueError": 400, "UnsupportedType": 415, "TranscriptionFailed": 422, "RuntimeError": 500, "ConnectionError": 503}


def status(loading: Column, summarizing: Column, chatting: Column, error: Column, summary_error: Column, transcript: Column) -> Column:
    """What a session is at, the most pressing first."""
    given = lambda c: F.coalesce(F.nullif(c, F.lit("")).isNotNull(), F.lit(False))
    return (
        F.when(loading, "loading").when(summarizing, "summarizing").when(chatting, "chatting").when(given(error), "error")
        .when(given(summary_error), "summary_error").when(given(transcript), "ready").otherwise("idle")
    )


def code_of(kind: Column) -> Column:
    """The code of a failure by its kind; null without one."""
    table = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    return F.when(kind.isNotNull(), F.coalesce(F.try_element_at(table, kind), F.lit(500)))


def error(detail: Column, kind: str) -> Column:
    """struct<code, detail> of a failure of a kind; null where detail is."""
    return F.when(detail.isNotNull(), F.struct(F.lit(CODES.get(kind, 500)).alias("code"), detail.alias("detail")))


def guard(rows: DataFrame, *required: str, key: str = "transcript_id") -> tuple[DataFrame, DataFrame]:
    """Rows whose required columns hold something, white space included, and rejects with code 400 for the others."""
    ok = F.lit(True)
    for c in required:
        ok = ok & (F.coalesce(F.col(c), F.lit("")) != "")
    named = F.lit(" and ".join(required) + " cannot be empty")
    return rows.where(ok), rows.where(~ok).select(F.col(key), F.lit("request").alias("stage"), F.lit(400).alias("code"), named.alias("detail"))


def can_transcribe(loading: Column, transcript: Column) -> Column:
    return ~(loading | F.coalesce(F.nullif(transcript, F.lit("")).isNotNull(), F.lit(False)))


def can_summarize(text: Column, summarizing: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).isNotNull(), F.lit(False)) & ~summarizing
