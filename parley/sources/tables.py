"""Adapters from stored tables to transcripts, utterances and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.plans.schemas import CHAT_REQUEST, LLM_REQUEST

#: Recorded conversations carry no times; turns are spaced by this, so that the fourth is past the hour.
TURN_MS = 1_501_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(conversations: DataFrame) -> DataFrame:
    """transcript_id, pos, speaker, start_ms, end_ms, text, confidence of every turn."""
    start = F.col("turn") * TURN_MS
    return conversations.select(
        F.col("conv_id").alias("transcript_id"), F.col("turn").alias("pos"), F.col("role").alias("speaker"),
        start.alias("start_ms"), (start + TURN_MS).alias("end_ms"), "text", F.lit(None).cast("double").alias("confidence"),
    )


def questions(conversations: DataFrame) -> DataFrame:
    """transcript_id, seq, user_query of what users said."""
    return conversations.where("role = 'user'").select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("seq"), F.col("text").alias("user_query"))


def llm_requests(rows: DataFrame, body: str) -> DataFrame:
    return rows.withColumn("request", F.from_json(body, LLM_REQUEST))


def chat_requests(rows: DataFrame, body: str) -> DataFrame:
    return rows.withColumn("request", F.from_json(body, CHAT_REQUEST))
