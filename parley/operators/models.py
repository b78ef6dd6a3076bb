"""Model operators: transcription, summary, action items and answers through a provider.

A provider is built once a worker, from the settings, by a factory that pickles. Model columns are scalar Arrow UDFs, so
Catalyst drops the calls of a column nobody reads; filters belong on the input, before the model. A worker has a bounded
number of calls open at once; each has a time limit, and is made again only if the connection failed, after a pause.
Errors come back a row each as struct<code, detail>, never as a failed job. Model output is to be written before it is
used twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as LateError
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import FENCE, not_blank, strip
from parley.operators import chat, status
from parley.plans.schemas import TRANSCRIPT
from parley.plans.settings import Settings


# How the details of errors begin.
NO_SUMMARY, NO_ITEMS, NOT_PARSED, NO_ANSWER = "Failed to generate summary: ", "Failed to extract action items: ", "Failed to parse action items from LLM response: ", "Failed to get chat response: "


class Provider(Protocol):
    """Built by its factory from the settings, which name the model, its temperature and keys."""

    def transcribe(self, path: str, content: bytes | None) -> dict: ...

    def complete(self, prompt: str) -> str: ...


Factory = Callable[[Settings], Provider]
ANSWER = "value string, error string"
DEFAULT = Settings()


def available(factory: Factory | None) -> Factory:
    """On the driver, before anything is planned."""
    if factory is None:
        raise ConnectionError("no model provider is configured")
    return factory


def _asked(provider: Provider, prompt: str, settings: Settings, seconds: float) -> tuple[str | None, str | None]:
    """The answer, or what went wrong; a failed connection is tried again."""
    wait = settings.backoff_seconds
    for left in range(settings.max_retries, -1, -1):
        try:
            return provider.complete(prompt), None
        except ConnectionError as e:
            error = str(e)
            if left:
                time.sleep(min(wait, seconds))
                wait *= 2
        except Exception as e:
            return None, str(e)
    return None, error


def complete(prompt: Column, factory: Factory, settings: Settings = DEFAULT, seconds: float = DEFAULT.summary_seconds) -> Column:
    """struct<value, error> of the provider's answer to each prompt; null prompts are not sent.

    A call that is late is given up: its row is an error and its thread ends when the provider lets go.
    """
    held: list = []

    @F.pandas_udf(ANSWER)
    def call(prompts: pd.Series) -> pd.DataFrame:
        if not held:
            held.extend((factory(settings), ThreadPoolExecutor(settings.calls_at_once)))
        out = []
        for at in range(0, len(prompts), settings.calls_at_once):
            sent = [None if p is None else held[1].submit(_asked, held[0], p, settings, seconds) for p in prompts[at : at + settings.calls_at_once]]
            until = time.monotonic() + seconds
            for future in sent:
                try:
                    out.append((None, None) if future is None else future.result(max(until - time.monotonic(), 0)))
                except LateError:
                    future.cancel()
                    out.append((None, f"no answer within {seconds:g} seconds"))
            if any(f and not f.done() for f in sent):  # late calls keep their threads
                held[1].shutdown(wait=False)
                held[1] = ThreadPoolExecutor(settings.calls_at_once)
        return pd.DataFrame(out, columns=["value", "error"])

    return call.asNondeterministic()(prompt)


def _error(column: str, begins: str) -> Column:
    return status.error(F.concat(F.lit(begins), F.col(column)), "RuntimeError")


def summarize(transcripts: DataFrame, factory: Factory, settings: Settings = DEFAULT) -> DataFrame:
    """transcript_id, summary, summary_error of transcripts with text."""
    rows = transcripts.where(F.coalesce("text", F.lit("")) != "")
    out = rows.select("transcript_id", complete(chat.summary_prompt(F.col("text")), available(factory), settings, settings.summary_seconds).alias("a"))
    return out.select("transcript_id", strip(F.col("a.value")).alias("summary"), _error("a.error", NO_SUMMARY).alias("summary_error"))


def parse_items(raw: Column) -> tuple[Column, Column]:
    """Whether a raw answer is an object whose action_items, if any, is a list of strings; and the items that aren't blank."""
    text = F.regexp_extract(raw, FENCE, 1)
    value = F.try_parse_json(text)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))
    has = F.coalesce(F.array_contains(F.json_object_keys(text), "action_items"), F.lit(False))
    listed = F.try_variant_get(value, "$.action_items", "array<variant>")
    strings = F.forall(listed, lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")) == "STRING")
    ok = F.coalesce(is_object & (~has | (listed.isNotNull() & strings)), F.lit(False))
    items = F.coalesce(F.transform(listed, lambda x: F.variant_get(x, "$", "string")), F.array().cast("array<string>"))
    return ok, not_blank(items)


def extract_items(transcripts: DataFrame, factory: Factory, settings: Settings = DEFAULT) -> DataFrame:
    """transcript_id, action_items, items_error of transcripts with text."""
    rows = transcripts.where(F.coalesce("text", F.lit("")) != "")
    out = rows.select("transcript_id", complete(chat.items_prompt(F.col("text")), available(factory), settings, settings.items_seconds).alias("a"))
    ok, items = parse_items(F.col("a.value"))
    unread = status.error(F.when(~ok, F.concat(F.lit(NOT_PARSED), F.substring(F.coalesce("a.value", F.lit("")), 1, 200))), "RuntimeError")
    out = out.withColumn("items_error", F.coalesce(_error("a.error", NO_ITEMS), unread))
    return out.select("transcript_id", F.when(F.col("items_error").isNull(), items).alias("action_items"), "items_error")


def answer(paired: DataFrame, factory: Factory, settings: Settings = DEFAULT) -> DataFrame:
    """transcript_id, seq, user_query, ai_response, error of questions paired with their context."""
    rows = paired.where((F.coalesce("context", F.lit("")) != "") & (F.coalesce("user_query", F.lit("")) != ""))
    out = rows.select("transcript_id", "seq", "user_query", complete(chat.chat_prompt(F.col("context"), F.col("user_query")), available(factory), settings, settings.chat_seconds).alias("a"))
    return out.select("transcript_id", "seq", "user_query", strip(F.col("a.value")).alias("ai_response"), _error("a.error", NO_ANSWER).alias("error"))


def transcribe(media: DataFrame, factory: Factory, settings: Settings = DEFAULT) -> DataFrame:
    """Transcripts of files (path, and content if it is there); a failed one is a row with status error.

    Without a content column nothing of a file is read here, whatever its size: the provider gets its path alone.
    """
    factory = available(factory)
    columns = [c for c in ("path", "content") if c in media.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory(settings)
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch.get("content", [None] * len(batch))):
                row = dict.fromkeys(TRANSCRIPT.names) | {"transcript_id": path, "source_path": path}
                try:
                    row |= {"status": "completed"} | provider.transcribe(path, None if content is None else bytes(content))
                except Exception as e:
                    row |= {"status": "error", "error": f"{type(e).__name__}: {e}"}
                out.append(row)
            yield pd.DataFrame(out, columns=TRANSCRIPT.names)

    return media.select(*columns).mapInPandas(run, TRANSCRIPT)


def failures(transcripts: DataFrame) -> DataFrame:
    """source_path, stage, code and detail of transcripts that failed."""
    detail = F.concat(F.lit("Transcription failed: "), F.coalesce("error", F.lit("")))
    failed = transcripts.where(F.col("status") == "error").select("source_path", status.error(detail, "TranscriptionFailed").alias("e"))
    return failed.select("source_path", F.lit("transcribe").alias("stage"), "e.code", "e.detail")


class Replay:
    """A test double, not a model: files hold the transcript they stand for, answers are cut out of the prompt."""

    def __init__(self, settings: Settings = DEFAULT):
        self.settings = settings

    def transcribe(self, path: str, content: bytes | None) -> dict:
        return json.loads(content)

    def complete(self, prompt: str) -> str:
        context = prompt.split("<<<\n", 1)[1].rsplit("\n>>>", 1)[0]
        lines = context.split("\n")
        if prompt.endswith("JSON:"):
            return "```json\n" + json.dumps({"action_items": [*lines[:2], " "]}) + "\n```"
        if prompt.endswith("Answer:"):
            first = prompt.rsplit("\nQuestion: ", 1)[1].split(" ", 1)[0]
            return next((x for x in lines if first in x), chat.NOT_AVAILABLE)
        return " " + lines[0] + "\n"
