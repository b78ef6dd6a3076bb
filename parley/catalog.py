"""All queries of the library over the stored tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import language, text
from parley.operators import chat, models, notes, search, status, transcripts
from parley.plans import schemas
from parley.sources import media, sinks
from parley.sources.tables import TURN_MS, chat_requests, llm_requests, questions, table, utterances

WORD = "the"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(table(spark, sf_dir, "conversations"))


def _first_line(c: str):
    return F.substring_index(c, "\n", 1)


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes to render: first lines of the first three turns, those of users as items, the whole text."""
    u = _u(spark, sf_dir).withColumn("line", _first_line("text"))
    listed = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.struct("pos", "line"))))
    rows = u.groupBy("transcript_id").agg(
        listed(F.col("pos") < 3).alias("s"), listed(F.col("speaker") == "user").alias("i"), F.expr("listagg(text, '\\n') within group (order by pos)").alias("text")
    )
    return rows.select("transcript_id", F.array_join("s.line", " ").alias("summary"), F.col("i.line").alias("action_items"), "text")


LINE = "split_part(text, chr(10), 1)"
NOTES = f"""notes as (
  select conv_id as transcript_id, string_agg({LINE}, ' ' order by turn) filter (where turn < 3) as summary,
    string_agg('- ' || {LINE}, chr(10) order by turn) filter (where role = 'user') as bullets,
    string_agg({LINE}, '; ' order by turn) filter (where role = 'user') as joined,
    string_agg({LINE}, chr(10) order by turn) filter (where role = 'user') as lines,
    count(*) filter (where role = 'user') as n_items, string_agg(text, chr(10) order by turn) as text
  from conversations group by conv_id)"""


# Sources


@query("select doc_id, case doc_id % 5 when 0 then 'a.mp3' when 1 then 'b.c.FLAC' when 2 then 'd.txt' when 3 then 'noext' else 'e.webm' end as name, case doc_id % 5 when 0 then 'audio/mpeg' when 1 then 'audio/flac' when 4 then 'video/webm' end as mime, doc_id % 5 in (0, 1, 4) as accepted, case when doc_id % 5 in (2, 3) then 415 end as code from documents")
def s2_mime_allowlist(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ("a.mp3", "b.c.FLAC", "d.txt", "noext", "e.webm"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", names.alias("name")).withColumn("mime", media.mime_type(F.col("name")))
    ok = media.accepted(F.col("mime"))
    return rows.select("doc_id", "name", "mime", ok.alias("accepted"), F.when(~ok, 415).alias("code"))


@query("select conv_id as transcript_id, turn as seq, text as transcript from conversations")
def s5_request_rows(spark, sf_dir):
    body = F.to_json(F.struct(F.col("text").alias("transcript"))).alias("body")
    rows = _u(spark, sf_dir).select("transcript_id", F.col("pos").alias("seq"), body)
    return rows.select("transcript_id", "seq", F.from_json("body", schemas.LLM_REQUEST)["transcript"].alias("transcript"))


@query("select conv_id as transcript_id, turn as seq, role, text as content from conversations")
def s6_json_response(spark, sf_dir):
    body = F.to_json(F.struct(F.col("pos").alias("seq"), F.col("speaker").alias("role"), F.col("text").alias("content"))).alias("body")
    rows = _u(spark, sf_dir).select("transcript_id", body).withColumn("r", F.from_json("body", schemas.CHAT_TURN))
    return rows.select("transcript_id", "r.seq", "r.role", "r.content")


# Sinks


@query(f"with {NOTES} select transcript_id, 'Meeting Notes' || repeat(chr(10), 2) || 'Summary:' || chr(10) || coalesce(summary, '{notes.NO_SUMMARY}') || repeat(chr(10), 2) || 'Action Items:' || chr(10) || coalesce(bullets, '{notes.NO_ITEMS}') || repeat(chr(10), 2) || 'Transcript:' || chr(10) || text as document from notes")
def k1_txt_render(spark, sf_dir):
    rows = _notes(spark, sf_dir)
    return rows.select("transcript_id", notes.as_text(F.col("summary"), F.col("action_items"), F.col("text")).alias("document"))


@query(f"""with {NOTES} select transcript_id, summary as "Summary", coalesce(joined, '') as "Action Items", text as "Transcript" from notes""")
def k2_csv_row(spark, sf_dir):
    return notes.as_csv_row(_notes(spark, sf_dir))


@query(f"with {NOTES} select transcript_id, 'Meeting Notes' || chr(10) || 'Summary' || chr(10) || summary || chr(10) || 'Action Items' || chr(10) || coalesce(lines, '{notes.NO_ITEMS}') || chr(10) || 'Transcript' || chr(10) || text as read_back from notes")
def k3_docx(spark, sf_dir):
    @F.pandas_udf("string")
    def read_back(files: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str:
            xml = zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml").decode()
            paragraphs = re.findall(r"<w:p>(.*?)</w:p>", xml, re.DOTALL)
            lines = ["".join(t or "\n" for t in re.findall(r"<w:t [^>]*>(.*?)</w:t>|<w:br/>", p, re.DOTALL)) for p in paragraphs]
            return "\n".join(lines).replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")

        return files.map(one)

    return sinks.as_docx(_notes(spark, sf_dir)).select("transcript_id", read_back("content").alias("read_back"))


@query(f"with {NOTES} select transcript_id, summary, n_items from notes")
def k4_json_response(spark, sf_dir):
    record = "struct<transcript_id:bigint,summary:string,action_items:array<string>>"
    rows = _notes(spark, sf_dir).select(F.from_json(F.to_json(F.struct("transcript_id", "summary", "action_items")), record).alias("r"))
    return rows.select("r.transcript_id", "r.summary", F.size("r.action_items").cast("long").alias("n_items"))


@query("select doc_id, split_part(lang || '.' || source || '.mp3', '.', 1) || '.txt' as name from documents")
def k5_output_name(spark, sf_dir):
    name = F.concat_ws(".", "lang", "source", F.lit("mp3"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(text.stem(name), F.lit(".txt")).alias("name"))


@query("select conv_id as transcript_id, turn as seq, substr(text, 1, 50) as line from conversations where role = 'user'")
def k7_log_line(spark, sf_dir):
    return questions(table(spark, sf_dir, "conversations")).select("transcript_id", "seq", chat.logged(F.col("user_query")).alias("line"))


@query("select conv_id as transcript_id, turn as seq, role, text as content from conversations union all select conv_id, turn + 1, 'assistant', 'Error: none' from conversations where role = 'user'")
def k8_history_append(spark, sf_dir):
    history = _u(spark, sf_dir).select("transcript_id", F.col("pos").alias("seq"), F.col("speaker").alias("role"), F.col("text").alias("content"))
    answers = questions(table(spark, sf_dir, "conversations")).select("transcript_id", "seq", F.lit(None).cast("string").alias("ai_response"), status.error(F.lit("none"), "RuntimeError").alias("error"))
    return chat.append(history, answers)


# Projections


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as transcripts; those in French stand for failed ones."""
    bad = F.col("lang") == "fr"
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("transcript_id"), F.col("source").alias("source_path"), F.when(bad, "TranscriptStatus.error").otherwise("TranscriptStatus.completed").alias("status"), "text",
        F.col("lang").alias("language_code"), F.lit(None).cast(schemas.TRANSCRIPT["utterances"].dataType).alias("utterances"), F.when(bad, F.lit("no speech")).alias("error"),
    )


@query(f"select conv_id as transcript_id, turn as pos, role as speaker, turn * {TURN_MS} as start_ms, (turn + 1) * {TURN_MS} as end_ms, text, cast(null as double) as confidence from conversations")
def p1_utterance_projection(spark, sf_dir):
    return transcripts.explode(transcripts.collect(_u(spark, sf_dir))).withColumn("pos", F.col("start_ms") / TURN_MS).withColumn("pos", F.col("pos").cast("long"))


@query("select doc_id as transcript_id, source as source_path, case when lang = 'fr' then 'error' else 'completed' end as status, case when lang <> 'fr' then text end as text, case when lang <> 'fr' then lang end as language_code, case when lang <> 'fr' then cast(0 as bigint) end as n_utterances, case when lang = 'fr' then 'no speech' end as error from documents")
def p2_transcript_projection(spark, sf_dir):
    rows = transcripts.project(_transcripts(spark, sf_dir))
    return rows.select("transcript_id", "source_path", "status", "text", "language_code", F.when(F.col("utterances").isNotNull(), F.size("utterances")).cast("long").alias("n_utterances"), "error")


@query("select doc_id as transcript_id, 'no speech' as error from documents where lang = 'fr'")
def p3_error_projection(spark, sf_dir):
    rows = transcripts.project(_transcripts(spark, sf_dir))
    return rows.where(transcripts.failed(F.col("status")) & F.col("text").isNull() & F.col("utterances").isNull()).select("transcript_id", "error")


@query(f"select conv_id as transcript_id, turn as pos, case when role = 'system' then 'Unknown' else role end as speaker, printf('%02d:%02d', ((turn * {TURN_MS}) // 60000) % 60, ((turn * {TURN_MS}) // 1000) % 60) as time, text from conversations")
def p5_display_row(spark, sf_dir):
    return search.display(_u(spark, sf_dir).withColumn("speaker", F.nullif("speaker", F.lit("system"))))


@query(f"select conv_id as transcript_id, turn as pos, role as speaker, '_' || printf('%02d:%02d', ((turn * {TURN_MS}) // 60000) % 60, ((turn * {TURN_MS}) // 1000) % 60) || '_ | ' || regexp_replace(text, '{WORD}', '<b>\\0</b>', 'gi') as line from conversations where contains(lower(text), '{WORD}')")
def p6_highlight(spark, sf_dir):
    return search.highlighted(_u(spark, sf_dir), WORD)


@query(f"with {NOTES} select transcript_id, coalesce(bullets, '{notes.NO_ITEMS}') as bullets from notes")
def p8_bullets(spark, sf_dir):
    return _notes(spark, sf_dir).select("transcript_id", notes.bullet_lines(F.col("action_items")).alias("bullets"))


@query("with t as (select conv_id, string_agg(text, chr(10) order by turn) as context from conversations group by 1) select c.conv_id as transcript_id, turn as seq, context as transcript_context, text as user_query from conversations c join t using (conv_id) where role = 'user'")
def p9_chat_payload(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    paired = chat.pair(questions(rows), transcripts.full_text(utterances(rows)))
    sent = paired.select("transcript_id", "seq", F.to_json(F.struct(F.col("context").alias("transcript_context"), "user_query")).alias("body"))
    return chat_requests(sent, "body").select("transcript_id", "seq", "request.transcript_context", "request.user_query")


@query("select conv_id as transcript_id, turn as seq, text as transcript from conversations")
def p9_llm_payload(spark, sf_dir):
    sent = _u(spark, sf_dir).select("transcript_id", F.col("pos").alias("seq"), F.to_json(F.struct(F.col("text").alias("transcript"))).alias("body"))
    return llm_requests(sent, "body").select("transcript_id", "seq", "request.transcript")


# Filters


@query(f"select conv_id as transcript_id, turn as pos, text from conversations where contains(lower(text), '{WORD}')")
def f1_keyword_search(spark, sf_dir):
    return search.search(_u(spark, sf_dir), WORD).select("transcript_id", "pos", "text")


@query(f"select transcript_id, seq, line, text from (select conv_id as transcript_id, turn as seq, unnest(range(len(string_split(text, chr(10)))))::int as line, unnest(string_split(text, chr(10))) as text from conversations) where contains(lower(text), '{WORD}')")
def f2_line_search(spark, sf_dir):
    rows = _u(spark, sf_dir).select(F.struct("transcript_id", F.col("pos").alias("seq")).alias("transcript_id"), "text")
    return search.search_lines(rows, WORD).select("transcript_id.transcript_id", "transcript_id.seq", "line", "text")


@query("select conv_id as transcript_id, cast(count(*) filter (where role <> 'system') as bigint) as n_kept from conversations group by 1")
def f3_drop_blank_items(spark, sf_dir):
    item = F.when(F.col("speaker") == "system", F.lit("  \t")).otherwise(F.col("text"))
    rows = _u(spark, sf_dir).groupBy("transcript_id").agg(F.collect_list(item).alias("items"))
    return rows.select("transcript_id", F.size(text.not_blank(F.col("items"))).cast("long").alias("n_kept"))


@query("select conv_id as transcript_id, turn as seq, 400 as code from conversations where role = 'assistant'")
def f4_guard_rejects(spark, sf_dir):
    rows = _u(spark, sf_dir).select(F.struct("transcript_id", F.col("pos").alias("seq")).alias("transcript_id"), F.when(F.col("speaker") != "assistant", F.col("text")).otherwise("").alias("transcript"))
    return status.guard(rows, "transcript")[1].select("transcript_id.transcript_id", "transcript_id.seq", "code")


@query("select doc_id as transcript_id, lang <> 'fr' as ok, lang = 'fr' as failed from documents")
def f6_status_predicates(spark, sf_dir):
    return _transcripts(spark, sf_dir).select("transcript_id", transcripts.succeeded(F.col("status")).alias("ok"), transcripts.failed(F.col("status")).alias("failed"))


@query("select doc_id as transcript_id, lang as language_code from documents where lang <> 'es'")
def f8_language_present(spark, sf_dir):
    rows = _transcripts(spark, sf_dir).withColumn("language_code", F.when(F.col("language_code") == "es", "").otherwise(F.col("language_code")))
    return rows.where(transcripts.has_language(F.col("language_code"))).select("transcript_id", "language_code")


@query(f"with {NOTES} select transcript_id, n_items > 0 as has_items from notes")
def f9_collection_non_empty(spark, sf_dir):
    return _notes(spark, sf_dir).select("transcript_id", transcripts.has_any(F.col("action_items")).alias("has_items"))


@query("select conv_id as transcript_id, turn as pos, not (turn = 0 or role <> 'user') as can_transcribe, role = 'user' and turn <> 1 as can_summarize from conversations")
def f11_button_states(spark, sf_dir):
    said = F.when(F.col("speaker") == "user", F.col("text"))
    return _u(spark, sf_dir).select(
        "transcript_id", "pos", status.can_transcribe(F.col("pos") == 0, F.when(F.col("speaker") != "user", F.col("text"))).alias("can_transcribe"),
        status.can_summarize(said, F.col("pos") == 1).alias("can_summarize"),
    )


# Joins


@query(f"with {NOTES}, s as (select transcript_id, summary, case when transcript_id % 3 = 0 then 'down' end as se, case when transcript_id % 2 = 0 then 'busy' end as ie, n_items from notes) select transcript_id, case when se is null then summary end as summary, case when se is not null then coalesce(ie, se) end as summary_error, case when se is null and ie is null then n_items else 0 end as n_items, case when se is null then ie end as action_items_error from s")
def j1_notes_merge(spark, sf_dir):
    rows = _notes(spark, sf_dir)
    error = lambda bad, detail: status.error(F.when(bad, detail), "RuntimeError")
    summaries = rows.select("transcript_id", "summary", error(F.col("transcript_id") % 3 == 0, "down").alias("summary_error"))
    busy = F.col("transcript_id") % 2 == 0
    items = rows.select("transcript_id", F.when(~busy, F.col("action_items")).alias("action_items"), error(busy, "busy").alias("items_error"))
    out = notes.merge(summaries, items)
    return out.select("transcript_id", "summary", F.col("summary_error.detail").alias("summary_error"), F.size("action_items").cast("long").alias("n_items"), F.col("action_items_error.detail").alias("action_items_error"))


@query("with t as (select conv_id, string_agg(text, chr(10) order by turn) as context from conversations group by 1) select c.conv_id as transcript_id, turn as seq, text as user_query, context from conversations c join t using (conv_id) where role = 'user'")
def j2_question_context(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return chat.pair(questions(rows), transcripts.full_text(utterances(rows))).select("transcript_id", "seq", "user_query", "context")


@query("select doc_id as transcript_id from documents where doc_id not in (select doc_id from labels)")
def j3_skip_done(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("transcript_id"))
    return chat.without(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("transcript_id")), done)


# Aggregations, order


@query(f"select conv_id as transcript_id, count(*) filter (where contains(lower(text), '{WORD}')) as n_matches from conversations group by 1")
def a1_match_count(spark, sf_dir):
    return search.count_matches(_u(spark, sf_dir), WORD)


@query(f"with {NOTES} select transcript_id, coalesce(lines, '') as lines, coalesce(joined, '') as joined from notes")
def a2_a3_item_joins(spark, sf_dir):
    return _notes(spark, sf_dir).select("transcript_id", F.array_join("action_items", "\n").alias("lines"), F.array_join("action_items", "; ").alias("joined"))


@query("select conv_id as transcript_id, count(*) as n, arg_min(text, turn) as first_text, arg_max(text, turn) as last_text from conversations group by 1")
def a4_collect_utterances(spark, sf_dir):
    rows = transcripts.collect(_u(spark, sf_dir))
    return rows.select("transcript_id", F.size("utterances").cast("long").alias("n"), F.col("utterances")[0]["text"].alias("first_text"), F.element_at("utterances", -1)["text"].alias("last_text"))


@query("select conv_id as transcript_id, string_agg(text, chr(10) order by turn) as text from conversations group by 1")
def a5_full_text(spark, sf_dir):
    return transcripts.full_text(_u(spark, sf_dir))


@query("select conv_id as transcript_id, turn as pos, length(text) as n_chars from conversations")
def a6_text_length(spark, sf_dir):
    return _u(spark, sf_dir).select("transcript_id", "pos", F.length("text").cast("long").alias("n_chars"))


@query("select conv_id as transcript_id, arg_max(role, turn) as role, arg_max(text, turn) as content from conversations group by 1")
def w1_last_turn(spark, sf_dir):
    return chat.last_turn(_u(spark, sf_dir).select("transcript_id", F.col("pos").alias("seq"), F.col("speaker").alias("role"), F.col("text").alias("content")))


@query("select conv_id as transcript_id, turn as pos, row_number() over (partition by conv_id order by turn) as nth, substr(text, 1, 50) as head from conversations")
def o1_o2_order_and_prefix(spark, sf_dir):
    rows = transcripts.explode(transcripts.collect(_u(spark, sf_dir)))
    return rows.select("transcript_id", (F.col("start_ms") / TURN_MS).cast("long").alias("pos"), (F.col("pos") + 1).cast("long").alias("nth"), F.substring("text", 1, 50).alias("head"))


# Scalars


@query("select doc_id, lower(text) as lowered, contains(text, 'the') as has_word, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as stripped, len(string_split(text, chr(10))) as n_lines, strlen(text) as n_bytes from documents")
def x1_x12_strings(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.lower(t).alias("lowered"), F.contains(t, F.lit("the")).alias("has_word"), F.length(text.strip(t)).cast("long").alias("stripped"),
        F.size(F.split(t, "\n")).cast("long").alias("n_lines"), F.octet_length(F.encode(t, "UTF-8")).cast("long").alias("n_bytes"),
    )


@query("select doc_id, regexp_replace(text, 'é', '<b>\\0</b>', 'gi') as marked from documents")
def x5_highlight_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.highlight(F.col("text"), "É").alias("marked"))


@query(f"select conv_id as transcript_id, turn as pos, printf('%02d:%02d', ((turn * {TURN_MS}) // 60000) % 60, ((turn * {TURN_MS}) // 1000) % 60) as time from conversations")
def x7_timestamp(spark, sf_dir):
    return _u(spark, sf_dir).select("transcript_id", "pos", text.minutes_seconds(F.col("start_ms")).alias("time"))


@query("select doc_id, '.' || lang as extension from documents")
def x10_extension(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.extension(F.concat_ws(".", "source", F.lit("x"), "lang")).alias("extension"))


# Models: a test double shows the plumbing, not the quality of answers.


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts.collect(_u(spark, sf_dir)).join(transcripts.full_text(_u(spark, sf_dir)), "transcript_id")
    content = F.to_json(F.struct(F.col("transcript_id").cast("string").alias("transcript_id"), "text", F.lit("en").alias("language_code"), "utterances"))
    return rows.select(F.concat(F.lit("call-"), "transcript_id", F.lit(".mp3")).alias("path"), F.encode(content, "UTF-8").alias("content"))


@query("select cast(conv_id as varchar) as transcript_id, 'call-' || conv_id || '.mp3' as source_path, 'completed' as status, string_agg(text, chr(10) order by turn) as text, 'en' as language_code, count(*) as n_utterances, arg_max(role, turn) as last_speaker from conversations group by conv_id")
def m1_transcribe(spark, sf_dir):
    rows = models.transcribe(_media(spark, sf_dir), models.Replay)
    return rows.select("transcript_id", "source_path", "status", "text", "language_code", F.size("utterances").cast("long").alias("n_utterances"), F.element_at("utterances", -1)["speaker"].alias("last_speaker"))


def _small_words(code: str) -> str:
    words = ", ".join(f"'{w}'" for w in language.SMALL_WORDS[code].split())
    return f"len(list_intersect(list_distinct(string_split(translate(lower(text), '.,;:!?|' || chr(10) || chr(9), '         '), ' ')), [{words}])) as {code}"


@query(f"with n as (select doc_id, {', '.join(map(_small_words, language.SMALL_WORDS))} from documents) select doc_id, case greatest(de, en, es, fr) when 0 then null when de then 'de' when en then 'en' when es then 'es' else 'fr' end as language_code from n")
def m3_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", language.detect(F.col("text")).alias("language_code"))


@query("with t as (select conv_id, string_agg(text, chr(10) order by turn) as text from conversations group by 1) select conv_id as transcript_id, split_part(text, chr(10), 1) as summary, cast(null as varchar) as summary_error from t")
def m4_summarize(spark, sf_dir):
    out = models.summarize(transcripts.full_text(_u(spark, sf_dir)), models.Replay)
    return out.withColumn("summary_error", F.col("summary_error.detail"))


@query("with t as (select conv_id, string_split(string_agg(text, chr(10) order by turn), chr(10))[1:2] as l from conversations group by 1) select conv_id as transcript_id, array_to_string(list_filter(l, lambda x: trim(x) <> ''), chr(10)) as items, cast(null as varchar) as items_error from t")
def m5_action_items(spark, sf_dir):
    out = models.extract_items(transcripts.full_text(_u(spark, sf_dir)), models.Replay)
    return out.select("transcript_id", F.array_join("action_items", "\n").alias("items"), F.col("items_error.detail").alias("items_error"))


@query(f"with t as (select conv_id, string_split(string_agg(text, chr(10) order by turn), chr(10)) as l from conversations group by 1) select c.conv_id as transcript_id, turn as seq, text as user_query, coalesce(list_filter(l, lambda x: contains(x, split_part(text, ' ', 1)))[1], '{chat.NOT_AVAILABLE}') as ai_response, cast(null as varchar) as error from conversations c join t using (conv_id) where role = 'user'")
def m6_answer(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    out = models.answer(chat.pair(questions(rows), transcripts.full_text(utterances(rows))), models.Replay)
    return out.withColumn("error", F.col("error.detail"))


@query("select conv_id as transcript_id, turn as pos, replace($q$" + chat.SUMMARY_PROMPT + "$q$, '{context}', text) as prompt from conversations")
def m7_prompt(spark, sf_dir):
    return _u(spark, sf_dir).select("transcript_id", "pos", chat.summary_prompt(F.col("text")).alias("prompt"))


def _filled(prompt: str, **parts: str) -> str:
    """The SQL of a prompt with its parts, each placeholder replaced once."""
    pieces = re.split(r"\{(\w+)\}", prompt)
    out = [f"$q${x}$q$" if k % 2 == 0 else parts.get(x, f"$q${{{x}}}$q$") for k, x in enumerate(pieces)]
    return " || ".join(out)


@query(f"select conv_id as transcript_id, turn as pos, {_filled(chat.ITEMS_PROMPT, context='text')} as prompt from conversations")
def m7_items_prompt(spark, sf_dir):
    return _u(spark, sf_dir).select("transcript_id", "pos", chat.items_prompt(F.col("text")).alias("prompt"))


@query(f"with t as (select conv_id, string_agg(text, chr(10) order by turn) as context from conversations group by 1) select c.conv_id as transcript_id, turn as seq, {_filled(chat.CHAT_PROMPT, context='context', question='text', missing=f'$q${chat.NOT_AVAILABLE}$q$')} as prompt from conversations c join t using (conv_id) where role = 'user'")
def m7_chat_prompt(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    paired = chat.pair(questions(rows), transcripts.full_text(utterances(rows)))
    return paired.select("transcript_id", "seq", chat.chat_prompt(F.col("context"), F.col("user_query")).alias("prompt"))


# Control


@query(f"select lang as source_path, 'upload' as stage, 415 as code, 'unsupported type ' || lang || '; accepted: {', '.join(sorted({*media.MIME_TYPES.values(), *media.OTHER_TYPES}))}' as detail from documents")
def x13_reject_detail(spark, sf_dir):
    return media.rejects(table(spark, sf_dir, "documents"), "lang", "lang")


@query("select source as source_path, 'transcribe' as stage, 422 as code, 'Transcription failed: no speech' as detail from documents where lang = 'fr'")
def c3_transcription_failures(spark, sf_dir):
    return models.failures(transcripts.project(_transcripts(spark, sf_dir)))


@query("select conv_id as transcript_id, turn as pos, case when turn = 0 then 'loading' when turn = 1 then 'summarizing' when turn = 2 then 'chatting' when role = 'system' then 'error' when turn = 3 then 'summary_error' when role = 'user' then 'ready' else 'idle' end as status from conversations")
def c1_status(spark, sf_dir):
    u = _u(spark, sf_dir)
    at, who = F.col("pos"), F.col("speaker")
    said = status.status(at == 0, at == 1, at == 2, F.when(who == "system", "failed"), F.when(at == 3, "failed"), F.when(who == "user", F.col("text")))
    return u.select("transcript_id", "pos", said.alias("status"))


@query("select conv_id as transcript_id, turn as pos, case turn when 0 then 400 when 1 then 503 when 2 then 500 when 3 then 422 when 4 then 500 end as code from conversations")
def c2_c3_error_codes(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("ValueError", "ConnectionError", "RuntimeError", "TranscriptionFailed", "OSError")))
    return _u(spark, sf_dir).select("transcript_id", "pos", status.code_of(F.get(kinds, F.col("pos").cast("int"))).alias("code"))


@query("select 'ok' as status")
def c4_health(spark, sf_dir):
    return spark.range(1).select(F.lit("ok").alias("status"))


