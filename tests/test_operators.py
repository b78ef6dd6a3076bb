import json
import os
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.operators import chat, models, notes, search, status, transcripts
from parley.plans.schemas import ERROR
from parley.plans.settings import Settings
from parley.sources import media, sinks
from parley.streaming.ingest import ingest


def test_search_defaults(spark):
    rows = spark.createDataFrame([(1, 0, None, None, "Hello"), (1, 1, "A", 61000, None), (2, 0, "B", 1, "x")], "transcript_id long, pos long, speaker string, start_ms long, text string")
    assert search.search(rows, "").count() == 3
    assert {(r.transcript_id, r.n_matches) for r in search.count_matches(rows, "hell").collect()} == {(1, 1), (2, 0)}
    assert [tuple(r) for r in search.display(rows).orderBy("transcript_id", "pos").collect()][:2] == [(1, 0, "Unknown", "00:00", "Hello"), (1, 1, "A", "01:01", "")]


def test_merge_has_four_outcomes(spark):
    summaries = spark.createDataFrame([(1, "s", None), (2, "s", None), (3, None, (500, "se")), (4, None, (500, "se")), (5, "s", None)], f"transcript_id long, summary string, summary_error {ERROR}")
    items = spark.createDataFrame([(1, ["i"], None), (2, None, (503, "ie")), (3, ["i"], None), (4, None, (503, "ie"))], f"transcript_id long, action_items array<string>, items_error {ERROR}")
    out = {r.transcript_id: (r.summary, r.summary_error, r.action_items, r.action_items_error) for r in notes.merge(summaries, items).collect()}
    assert out == {1: ("s", None, ["i"], None), 2: ("s", None, [], (503, "ie")), 3: (None, (500, "se"), [], None), 4: (None, (503, "ie"), [], None), 5: ("s", None, [], None)}


def test_status_order(spark):
    def at(*x):
        return spark.range(1).select(status.status(*(F.lit(v) if v is not None else F.lit(None).cast("string") for v in x))).first()[0]

    assert at(True, True, True, "e", "s", "t") == "loading"
    assert at(False, True, True, "e", "s", "t") == "summarizing"
    assert at(False, False, True, "e", "s", "t") == "chatting"
    assert at(False, False, False, "e", "s", "t") == "error"
    assert at(False, False, False, "", "s", "t") == "summary_error"
    assert at(False, False, False, None, None, "t") == "ready"
    assert at(False, False, False, None, None, "") == "idle"


def test_guard_and_statuses(spark):
    rows = spark.createDataFrame([(1, ""), (2, None), (3, " ")], "transcript_id long, transcript string")
    good, bad = status.guard(rows, "transcript")
    assert [r.transcript_id for r in good.collect()] == [3] and {r.transcript_id for r in bad.collect()} == {1, 2}
    rows = spark.createDataFrame([("completed",), ("TranscriptStatus.error",), (None,)], "s string").select(transcripts.succeeded(F.col("s")), transcripts.failed(F.col("s")))
    assert [tuple(r) for r in rows.collect()] == [(True, False), (False, True), (False, False)]


ANSWERS = [
    ('{"action_items": ["a", " ", "b "]}', True, ["a", "b "]), ('```json\n{"action_items": ["a"]}\n```', True, ["a"]), ("```\n{}\n```", True, []), ('{"action_items": []}', True, []),
    ('{"action_items": null}', False, None), ('{"action_items": [1, "b"]}', False, None), ('{"action_items": [null]}', False, None), ('{"action_items": "a"}', False, None), ("sorry", False, None),
    ('["a"]', False, None), ("", False, None), (None, False, None),
]


def test_strict_parse(spark):
    rows = spark.createDataFrame([(k, a) for k, (a, _, _) in enumerate(ANSWERS)], "k int, raw string")
    ok, items = models.parse_items(F.col("raw"))
    got = {r.k: (r.ok, r["items"] if r.ok else None) for r in rows.select("k", ok.alias("ok"), items.alias("items")).collect()}
    assert got == {k: (o, i) for k, (_, o, i) in enumerate(ANSWERS)}


class Flaky:
    """Connects at each third call; fails on texts that hold `bad` and is late on those that hold `slow`."""

    def __init__(self, settings):
        self.settings, self.calls = settings, 0

    def complete(self, prompt):
        self.calls += 1
        if "slow" in prompt:
            time.sleep(3)
        if "bad" in prompt:
            raise RuntimeError("no")
        if self.calls % 3:
            raise ConnectionError("down")
        return f" fine at {self.settings.temperature} "

    def transcribe(self, path, content):
        return {"text": json.loads(content)["text"]}


def test_failures_are_rows(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, ""), (4, "slow")], "transcript_id long, text string").coalesce(1)
    rules = Settings(temperature=0.7, calls_at_once=1, summary_seconds=1, backoff_seconds=0.01)
    out = {r.transcript_id: (r.summary, r.summary_error and tuple(r.summary_error)) for r in models.summarize(rows, Flaky, rules).collect()}
    assert out == {1: ("fine at 0.7", None), 2: (None, (500, "Failed to generate summary: no")), 4: (None, (500, "Failed to generate summary: no answer within 1 seconds"))}
    once = models.summarize(rows.where("transcript_id = 1"), Flaky, Settings(max_retries=1, backoff_seconds=0.01)).first()
    assert tuple(once.summary_error) == (500, "Failed to generate summary: down")
    asked = models.answer(rows.selectExpr("transcript_id", "1L as seq", "text as user_query", "'bad' as context").where("transcript_id = 1"), Flaky).first()
    assert tuple(asked.error) == (500, "Failed to get chat response: no")
    parsed = models.extract_items(rows.where("transcript_id = 1"), Flaky, Settings(backoff_seconds=0.01)).first()
    assert tuple(parsed.items_error) == (500, "Failed to parse action items from LLM response:  fine at 0.1 ")
    files = spark.createDataFrame([("a", bytearray(b'{"text": "t"}')), ("b", bytearray(b"?"))], "path string, content binary")
    got = {r.transcript_id: (r.status, r.text) for r in models.transcribe(files, Flaky).collect()}
    assert got == {"a": ("completed", "t"), "b": ("error", None)}
    assert [tuple(r)[:3] for r in models.failures(models.transcribe(files, Flaky)).collect()] == [("b", "transcribe", 422)]
    assert models.transcribe(files.select("path"), Flaky).where("status = 'error'").count() == 2  # paths alone, no content read
    with pytest.raises(ConnectionError):
        models.summarize(rows, None)


def test_unused_model_columns_are_not_called(spark):
    rows = spark.createDataFrame([(1, "good")], "transcript_id long, text string")
    out = models.summarize(rows, Flaky)
    plan = out.select("transcript_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan
    kept = models.summarize(rows.where("transcript_id = 1"), Flaky)._jdf.queryExecution().optimizedPlan().toString()
    assert kept.index("ArrowEvalPython") < kept.index("transcript_id#")  or "Filter" in kept


def test_exports(spark, tmp_path):
    nasty = 'q"uo,te\nline\r\ttab\\ é  '
    rows = spark.createDataFrame([(1, nasty, ["a", "b;"], " t "), (2, None, None, None)], "transcript_id long, summary string, action_items array<string>, text string").coalesce(1)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    part = next(p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part"))
    want = pd.DataFrame({"Summary": [nasty, notes.NO_SUMMARY], "Action Items": ["a; b;", ""], "Transcript": [" t ", notes.NO_TRANSCRIPT]}).to_csv(index=False)
    assert part.read_bytes().decode() == want
    sinks.write_text(rows, str(tmp_path / "rows"))
    assert {(r.transcript_id, r.name) for r in spark.read.parquet(str(tmp_path / "rows")).collect()} == {(1, "1.txt"), (2, "2.txt")}
    sinks.write_text(rows, str(tmp_path / "txt"), one_each=True)
    assert "No specific action items" in "".join(p.read_text() for p in (tmp_path / "txt" / "transcript_id=2").iterdir() if p.name.startswith("part"))
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_history(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 2, "user", "r")], "transcript_id long, seq long, role string, content string")
    answers = spark.createDataFrame([(1, 0, "a", None), (1, 2, None, (503, "down"))], f"transcript_id long, seq long, ai_response string, error {ERROR}")
    assert [tuple(r) for r in chat.last_turn(chat.append(turns, answers)).collect()] == [(1, "assistant", "Error: down")]


def test_stored_turns(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "q" * 60)], "transcript_id long, seq long, role string, content string")
    path = str(tmp_path / "turns")
    sinks.append_turns(turns, path)
    sinks.append_turns(turns, path)
    assert spark.read.parquet(path).count() == 2
    assert turns.select(chat.logged(F.col("content"))).first()[0] == "q" * 50
    sinks.reset(turns.limit(0), path)
    assert spark.read.parquet(path).count() == 0


def test_ingest_takes_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.mp3").write_text('{"text": "one"}')
    (src / "a.txt").write_text("no")
    where = [str(src), str(tmp_path / "out"), str(tmp_path / "marks")]
    ingest(spark, *where, models.Replay).awaitTermination()
    ingest(spark, *where, models.Replay).awaitTermination()
    assert spark.read.parquet(where[1]).count() == 1
    (src / "b.wav").write_text('{"text": "two"}')
    ingest(spark, *where, models.Replay).awaitTermination()
    assert {r.text for r in spark.read.parquet(where[1]).collect()} == {"one", "two"}
    assert os.path.isdir(where[2])


def test_staged_names_are_new(spark):
    names = [r[0] for r in spark.createDataFrame([("a.b.mp3",), ("a.b.mp3",)], "path string").select(media.staged_name(F.col("path"))).collect()]
    assert len(set(names)) == 2 and all(re.fullmatch(r"[0-9a-f-]{36}\.mp3", n) for n in names)


def test_the_missing_answer_is_the_fixed_sentence():
    assert chat.NOT_AVAILABLE == "The answer is not available in the provided transcript context."
