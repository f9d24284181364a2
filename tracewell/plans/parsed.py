"""Queries of the parsers and live polls: session documents and chat rows written as each writer's lines, and parsed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.base import DOCS, OBS, documents, observations
from tracewell.plans.data import clean_sql
from tracewell.sources import tables, transcripts
from tracewell.streaming import polls
from tracewell.tables import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "session_id", "title", "content", "created_at").filter("file_path is not null")


def _at(i: Column) -> Column:
    return F.struct(F.lit(0).cast("bigint").alias("block"), i.cast("bigint").alias("row")).alias("at")


def _lines(rows: DataFrame, *records: Column) -> DataFrame:
    """Each row's records as lines of its file; null ones are no line."""
    lines = rows.select(F.col("file_path").alias("path"), F.posexplode(F.array(*[F.to_json(r) for r in records])).alias("i", "line"))
    return lines.select("path", _at(F.col("i")), "line", F.lit(1_700_000_000).cast("bigint").alias("mtime"), F.lit(1).cast("bigint").alias("size")).filter("line is not null")


def _files(rows: DataFrame, text: Column) -> DataFrame:
    return rows.select(F.col("file_path").alias("path"), text.alias("text"), F.lit(1_700_000_000).cast("bigint").alias("mtime"), F.lit(1).cast("bigint").alias("size"))


def _out(docs: DataFrame) -> DataFrame:
    return docs.select("file_path", "session_id", "title", F.md5("content").alias("content_md5"))


def _record(**fields: Column | str) -> Column:
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])


def _block(kind: str, text: str) -> Column:
    return F.array(_record(type=kind, text=F.col(text)), _record(type="image", text=F.lit("no text")))


def parsed_codex(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = _record(type="session_meta", payload=_record(id=F.col("session_id"), cwd=F.lit("/work"), timestamp=F.col("created_at")))
    user = _record(type="event_msg", payload=_record(type="user_message", message=F.col("title")))
    said = _record(type="response_item", payload=_record(type="message", role="assistant", content=_block("output_text", "content")))
    return _out(transcripts.codex(_lines(_records(spark, sf_dir), meta, user, said)))


def parsed_claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = _record(type="user", sessionId=F.col("session_id"), cwd="/work", message=_record(content=F.col("title")))
    said = _record(type="assistant", cwd="/later", message=_record(content=_block("text", "content")))
    return _out(transcripts.claude(_lines(_records(spark, sf_dir), user, said)))


def parsed_copilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = _record(type="session.start", data=_record(sessionId=F.col("session_id"), context=_record(cwd=F.lit("/work"))))
    user = _record(type="user.message", data=_record(content=F.col("title")))
    said = _record(type="assistant.message", data=_record(content=F.col("content")))
    return _out(transcripts.copilot(_lines(_records(spark, sf_dir), start, user, said)))


def parsed_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _record(id=F.col("session_id"), message=F.col("title"))
    rest = _record(content=F.array(_record(type="text", text=F.col("content"))))
    return _out(transcripts.generic(_lines(_records(spark, sf_dir), first, rest), "openclaw_session"))


def parsed_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title from the first lines, the session from the file's name."""
    first = _record(type="session_start", id=F.lit("other"), sessionTitle=F.col("title"))
    rest = _record(content=F.array(_record(type="text", text=F.col("content"))))
    return _out(transcripts.parse(_lines(_records(spark, sf_dir), first, rest), "factory_session"))


def parsed_hermes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session and title from a file beside the transcript."""
    rows = _records(spark, sf_dir)
    lines = _lines(rows, _record(role="user", content=F.col("content")))
    beside = F.regexp_replace("file_path", r"([^/]*)\.[^./]*$", "session_$1.json")
    sidecars = rows.select(beside.alias("path"), F.to_json(_record(session_id=F.col("session_id"), title=F.col("title"))).alias("text"))
    return _out(transcripts.generic(lines, "hermes_session", transcripts.sidecar_titles(lines, sidecars)))


def parsed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    return _out(transcripts.history(_lines(rows, _record(display=F.lit(" "), text=F.col("title")), _record(prompt=F.col("content"))), "codex_history"))


def parsed_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    title = F.regexp_replace(F.coalesce("title", F.lit("")), r"^: ", "")
    texts = rows.select(F.col("file_path").alias("path"), F.posexplode(F.array(F.concat(F.lit(": 1700000000:0;"), title), title)).alias("i", "line"))
    lines = texts.select("path", _at(F.col("i")), "line", F.lit(1_700_000_000).cast("bigint").alias("mtime"), F.lit(1).cast("bigint").alias("size"))
    return _out(transcripts.shell(lines, "shell_zsh"))


def parsed_continue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages under history, each within an item's message."""
    session = _record(sessionId=F.col("session_id"), title=F.col("title"), history=F.array(_record(message=_record(role="user", content=F.col("content")))))
    return _out(transcripts.json_files(_files(_records(spark, sf_dir), F.to_json(session)), "continue_session"))


def parsed_zed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages under message_metadata."""
    session = _record(id=F.col("session_id"), summary=F.col("title"), message_metadata=F.array(_record(text=F.col("content"))))
    return _out(transcripts.json_files(_files(_records(spark, sf_dir), F.to_json(session)), "zed_session"))


def parsed_cline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of messages, the session from the folder, the title from the task's metadata."""
    rows = _records(spark, sf_dir).withColumn("folder", F.regexp_replace("file_path", r"\.[^./]*$", ""))
    files = _files(rows.withColumn("file_path", F.concat("folder", F.lit("/api_conversation_history.json"))), F.to_json(F.array(_record(role="user", content=F.col("content")))))
    metadata = rows.select(F.concat("folder", F.lit("/task_metadata.json")).alias("path"), F.to_json(_record(task=F.col("title"))).alias("text"))
    return _out(transcripts.json_files(files, "cline_session", transcripts.task_titles(files, metadata)))


def parsed_aider(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    text = F.concat(F.lit("#### "), F.regexp_replace(F.coalesce("title", F.lit("")), r"(^|\n)[#-]+", "$1"), F.lit("\n#### short\n--- "), F.regexp_replace(F.coalesce("content", F.lit("")), r"(^|\n)[#-]+", "$1"))
    return _out(transcripts.aider(_files(rows, text)))


def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of an editor's key-value store."""
    rows = _records(spark, sf_dir)
    value = F.to_json(_record(title=F.col("title"), data=_record(textDescription=F.col("content"))))
    store = _files(rows, value).select("path", F.concat(F.lit("aiService.prompts."), F.coalesce(F.md5("path"), F.lit(""))).alias("key"), F.col("text").alias("value"), "mtime", "size")
    return _out(transcripts.key_values(store, "cursor_session"))


def parsed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory notes in Markdown."""
    rows = observations(spark, sf_dir, "title", "content").filter("title is not null and content is not null")
    text = F.concat(F.lit("# "), F.regexp_replace("title", r"\s+", " "), F.lit("\nTags: a, b\nDate: 2024-01-02T03:04:05Z\n\n## Content\n"), F.col("content"))
    files = rows.select(F.concat(F.lit("/m/history/x_"), F.col("id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"), F.lit(1_700_000_000).cast("bigint").alias("mtime"))
    docs = transcripts.markdown(files)
    return docs.select("file_path", "session_id", "title", F.md5("content").alias("content_md5"), "created_at_epoch", F.array_join("tags", ",").alias("tags"))


def chat_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents of chat sessions out of the parts that are plain texts; sessions without one take their other rows."""
    parts = table(spark, sf_dir, "oc_part").distinct()
    typed = F.coalesce(F.contains("data", F.lit('"type": "text"')), F.lit(False))
    docs = tables.session_documents(table(spark, sf_dir, "oc_session").limit(0), parts.filter(typed), "opencode_session", True, parts.filter(~typed), None)
    return docs.select("session_id", F.length("content").alias("content_length"))


def _out_polls(rows: DataFrame) -> DataFrame:
    return rows.select("path", "session_id", F.md5("text").alias("text_md5"))


def poll_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    lines = _lines(rows, _record(sid=F.col("session_id"), text=F.col("content")), _record(input=F.col("title"), parts=_block("text", "content")))
    return _out_polls(polls.jsonl(lines, "codex_history", ["sid"], ["text"], None))


def poll_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).filter("title is not null").select(F.col("file_path").alias("path"), F.concat(F.lit(": 1700000000:0;"), F.regexp_replace("title", r"\s+", " ")).alias("line"))
    return _out_polls(polls.shell(rows, "shell_zsh", cap=None))


def poll_codex(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _record(type="response_item", payload=_record(type="message", content=_block("output_text", "content")))
    thought = _record(type="response_item", payload=_record(type="reasoning", text=F.col("title")))
    other = _record(type="event_msg", payload=_record(type="user_message", message=F.col("title")))
    return _out_polls(polls.codex(_lines(_records(spark, sf_dir), said, thought, other), None))


def poll_claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(_records(spark, sf_dir), _record(type="human", content=F.col("title")), _record(type="assistant", content=_block("text", "content")), _record(type="tool", content=F.col("title")))
    return _out_polls(polls.claude(lines, "/home", None))


QUERIES = {
    "parsed_codex": parsed_codex, "parsed_claude": parsed_claude, "parsed_copilot": parsed_copilot, "parsed_generic": parsed_generic, "parsed_factory": parsed_factory, "parsed_hermes": parsed_hermes,
    "parsed_history": parsed_history, "parsed_shell": parsed_shell, "parsed_continue": parsed_continue, "parsed_zed": parsed_zed, "parsed_cline": parsed_cline, "parsed_aider": parsed_aider,
    "parsed_values": parsed_values, "parsed_notes": parsed_notes, "chat_fallback": chat_fallback, "poll_jsonl": poll_jsonl, "poll_shell": poll_shell, "poll_codex": poll_codex, "poll_claude": poll_claude,
}

_SPACE = r"[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+"


def _compact(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'), ' ')"


def _noise(x: str) -> str:
    return (
        f"({x} = '' or contains({x}, '### Available skills') or contains({x}, 'You are Codex') or contains({x}, 'You are Claude') or contains({x}, '<environment_context>')"
        f" or (length({x}) - length(replace({x}, 'SKILL.md', ''))) / 8 >= 3)"
    )


_NAME = "regexp_extract(file_path, '[^/]*$')"
_STEM = rf"regexp_replace({_NAME}, '(.)\.[^.]*$', '\1')"
_SID = f"coalesce(nullif(trim(session_id, ' '), ''), {_STEM})"
_TITLED = f"coalesce(nullif(trim(title, ' '), ''), {_SID})"


def _parsed_sql(pieces: list[str], session: str, title: str, whole: bool, noise: bool = False, path: str = "file_path", cap: int = 24_000) -> str:
    """Documents of pieces in order: compacted, without blank ones, cut off at the cap. Without a piece the title stands in (whole) or there is none."""
    parts = " union all ".join(f"select k, {i} as i, {_compact(p)} as x from r" for i, p in enumerate(pieces))
    kept = f" and not {_noise('x')}" if noise else ""
    return rf"""with {DOCS}, r as (select *, file_path as k from docs where file_path is not null), p as (select * from ({parts}) where x is not null and x <> ''{kept}),
q as (select *, {cap} - coalesce(sum(length(x) + 1) over (partition by k order by i rows between unbounded preceding and 1 preceding), 0) as room from p),
j as (select k, string_agg(substr(x, 1, room::bigint), chr(10) order by i) as content from q where room > 0 group by 1),
m as (select k, {path} as file_path, {session} as session_id, {title} as t from r)
select m.file_path, m.session_id, substr(t, 1, 300) as title, md5(coalesce(content, substr(t, 1, 300))) as content_md5 from m {'left ' if whole else ''}join j using (k)"""


def _once(a: str, b: str) -> str:
    """A second text of one record, which counts only if it differs from the first."""
    return f"case when trim({b}, ' ') is distinct from trim({a}, ' ') then {b} end"


_AIDER = [f"case when length(trim({x}, chr(10) || ' ')) > 10 then {x} end" for x in ("regexp_replace(coalesce(title, ''), '(^|\n)[#-]+', '\\1', 'g')", "regexp_replace(coalesce(content, ''), '(^|\n)[#-]+', '\\1', 'g')")]
_PLAIN = "regexp_replace(coalesce(title, ''), '^: ', '')"
_FOLDER = r"regexp_replace(file_path, '\.[^./]*$', '')"


def _polled(parts: list[tuple[str, str]]) -> str:
    rows = " union all ".join(f"select file_path as path, {session} as session_id, {clean_sql(text)} as text from docs where file_path is not null and ({text}) is not null" for session, text in parts)
    return f"with {DOCS} select path, session_id, md5(text) as text_md5 from ({rows}) where trim(text, ' ') <> ''"


_CLAUDE_SID = rf"{_STEM} || '_' || substr(sha256(regexp_replace(replace(file_path, '/home', ''), '^/', '')), 1, 10)"
SQL = {
    "parsed_codex": _parsed_sql(["title", "content"], f"coalesce(session_id, {_STEM})", "'/work'", True, True),
    "parsed_claude": _parsed_sql(["title", "content"], f"coalesce(nullif(session_id, ''), {_STEM})", "'/work'", True, True),
    "parsed_copilot": _parsed_sql(["title", "content"], f"coalesce(session_id, {_STEM})", "'/work'", True, True),
    "parsed_generic": _parsed_sql(["title", "content"], _SID, _NAME, False),
    "parsed_hermes": _parsed_sql(["content"], f"coalesce(nullif(session_id, ''), {_STEM})", f"coalesce(nullif(coalesce(title, session_id), ''), {_NAME})", False),
    "parsed_history": _parsed_sql(["case when trim(title, ' ') <> '' then title end", "case when trim(content, ' ') <> '' then content end"], _STEM, _NAME, False),
    "parsed_shell": _parsed_sql([_PLAIN, _PLAIN], _STEM, _NAME, False),
    "parsed_continue": _parsed_sql([_TITLED.replace(_SID, "nullif(trim(session_id, ' '), '')"), _once(_TITLED.replace(_SID, "nullif(trim(session_id, ' '), '')"), "content")], _SID, f"coalesce(nullif(trim(title, ' '), ''), nullif(trim(session_id, ' '), ''), {_NAME})", False),
    "parsed_zed": _parsed_sql([_TITLED.replace(_SID, "nullif(trim(session_id, ' '), '')"), _once(_TITLED.replace(_SID, "nullif(trim(session_id, ' '), '')"), "content")], _SID, f"coalesce(nullif(trim(title, ' '), ''), nullif(trim(session_id, ' '), ''), {_NAME})", False),
    "parsed_cline": _parsed_sql(["content"], _STEM, f"coalesce(nullif(substr(trim(title, ' '), 1, 200), ''), {_STEM})", False, path=f"{_FOLDER} || '/api_conversation_history.json'"),
    "parsed_factory": _parsed_sql(["content"], _STEM, f"coalesce(nullif(title, ''), {_STEM})", False),
    "parsed_aider": _parsed_sql(_AIDER, "substr(sha256(file_path), 1, 16)", _NAME, False),
    "parsed_values": _parsed_sql(["title", _once("title", "content")], "'aiService.prompts.' || md5(file_path)", f"coalesce(nullif(trim(title, ' '), ''), {_NAME} || '#aiService.prompts.' || md5(file_path))", False, path="file_path || '#aiService.prompts.' || md5(file_path)"),
    "parsed_notes": rf"""with {OBS}, n as (select id, regexp_replace(title, '\s+', ' ', 'g') as t0, content from obs where title is not null and content is not null),
c as (select id, trim(regexp_replace(regexp_replace(t0, '(?is)<private>.*?</private>', '', 'g'), '(?i)</?private>', '', 'g'), ' ') as t, trim(regexp_replace(regexp_replace(content, '(?is)<private>.*?</private>', '', 'g'), '(?i)</?private>', '', 'g'), ' ') as c from n)
select '/m/history/x_' || id || '.md' as file_path, id::varchar as session_id, substr(coalesce(nullif(t, ''), 'x_' || id), 1, 240) as title, md5(c) as content_md5, 1704164645::bigint as created_at_epoch, 'a,b' as tags from c where c <> ''""",
    "chat_fallback": rf"""with p as (select distinct session_id, id, data, time_created from oc_part where session_id is not null),
x as (select session_id, id, time_created, coalesce(contains(data, '"type": "text"'), false) as typed, case when json_valid(data) and json_type(data) = 'OBJECT' then coalesce(case when json_type(data, '$.text') = 'VARCHAR' then data ->> '$.text' end,
  case when json_type(data, '$.message') = 'VARCHAR' then data ->> '$.message' end, case when json_type(data, '$.message.content') = 'VARCHAR' then data ->> '$.message.content' end) end as raw from p),
t as (select *, {_compact('raw')} as text from x where raw is not null),
s as (select * from t where typed union all select * from t where not typed and session_id not in (select session_id from t where typed))
select session_id, length(coalesce(nullif(string_agg(text, chr(10) order by time_created nulls first, id), ''), session_id))::int as content_length from s where text <> '' group by 1""",
    "poll_jsonl": _polled([("coalesce(nullif(trim(session_id, ' '), ''), 'codex_history_default')", "nullif(trim(content, ' '), '')"), ("'codex_history_default'", "case when trim(content, ' ') <> '' then coalesce(nullif(trim(title, ' '), '') || chr(10), '') || trim(content, ' ') end")]),
    "poll_shell": _polled([("'shell_zsh_20231114'", r"case when not regexp_matches(lower(trim(regexp_replace(title, '\s+', ' ', 'g'), ' ')), '^(history|fc )') then trim(regexp_replace(title, '\s+', ' ', 'g'), ' ') end")]),
    "poll_codex": _polled([(_NAME, "nullif(trim(content, ' '), '')"), (_NAME, "title")]),
    "poll_claude": _polled([(_CLAUDE_SID, "trim(title, ' ')"), (_CLAUDE_SID, "nullif(trim(content, ' '), '')")]),
}
