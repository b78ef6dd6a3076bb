"""Questions about transcripts: pairing, history and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import fill

SUMMARY_PROMPT = "Task: state in a few sentences what was discussed and decided in this meeting.\n<<<\n{context}\n>>>\nSummary:"
ITEMS_PROMPT = 'Task: list what people agreed to do after this meeting, with the owner if one is named. Answer in JSON: {"action_items": ["..."]}, with an empty list if there is nothing.\n<<<\n{context}\n>>>\nJSON:'
CHAT_PROMPT = "Task: answer from this meeting only, briefly; if it does not say, answer: {missing}\n<<<\n{context}\n>>>\nQuestion: {question}\nAnswer:"
# Fixed value: what an answer says that the transcript does not hold.
NOT_AVAILABLE = "The answer is not available in the provided transcript context."


def pair(questions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Each question with the whole text of its transcript, never with earlier turns."""
    return questions.join(transcripts.select("transcript_id", F.col("text").alias("context")), "transcript_id")


def without(work: DataFrame, done: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Work that has no result yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def last_turn(turns: DataFrame) -> DataFrame:
    """transcript_id, role, content of each conversation's last turn."""
    last = turns.groupBy("transcript_id").agg(F.max_by(F.struct("role", "content"), "seq").alias("last"))
    return last.select("transcript_id", "last.role", "last.content")


def append(history: DataFrame, answers: DataFrame) -> DataFrame:
    """History with the answers, or their errors, as assistant turns after their questions."""
    added = answers.select("transcript_id", (F.col("seq") + 1).alias("seq"), F.lit("assistant").alias("role"), F.coalesce("ai_response", F.concat(F.lit("Error: "), "error.detail")).alias("content"))
    return history.select("transcript_id", "seq", "role", "content").unionByName(added)


def logged(question: Column, chars: int = 50) -> Column:
    """What a log line shows of a question."""
    return F.substring(question, 1, chars)


def summary_prompt(context: Column) -> Column:
    return fill(SUMMARY_PROMPT, context=context)


def items_prompt(context: Column) -> Column:
    return fill(ITEMS_PROMPT, context=context)


def chat_prompt(context: Column, question: Column) -> Column:
    return fill(CHAT_PROMPT, context=context, question=question, missing=F.lit(NOT_AVAILABLE))
