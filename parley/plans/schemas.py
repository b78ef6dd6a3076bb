"""Declared schemas of all records; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

UTTERANCE = T.StructType(
    [
        T.StructField("speaker", T.StringType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
TRANSCRIPT = T.StructType(
    [
        T.StructField("transcript_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("language_code", T.StringType()),
        T.StructField("utterances", T.ArrayType(UTTERANCE)),
        T.StructField("error", T.StringType()),
    ]
)
#: What went wrong with a row.
ERROR = "struct<code:int,detail:string>"
LLM_REQUEST = T.StructType([T.StructField("transcript", T.StringType())])
CHAT_REQUEST = T.StructType([T.StructField("transcript_context", T.StringType()), T.StructField("user_query", T.StringType())])
CHAT_TURN = T.StructType([T.StructField("seq", T.LongType()), T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
