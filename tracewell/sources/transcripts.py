"""Parsers of session transcripts: JSON lines of several writers, histories, shells, Markdown and exports as documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import fingerprint, is_noise, strip_private
from tracewell.functions.variant import string_at as _s
from tracewell.operators.topk import top_k
from tracewell.sources.lines import CONTENT_CAP, file_name, finish, join_pieces, parent, stem
from tracewell.sources.tables import chat_values

BLOCKS = ("input_text", "output_text", "text")


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects; blank and unreadable ones are skipped."""
    return lines.withColumn("v", F.try_parse_json("line")).filter(F.schema_of_variant("v").startswith("OBJECT"))


def _blocks(v: Column, path: str) -> Column:
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    kept = F.filter(items, lambda b: F.coalesce(_s(b, "$.type").isin(*BLOCKS), F.lit(False)))
    return F.filter(F.transform(kept, lambda b: F.trim(F.coalesce(_s(b, "$.text"), F.lit("")))), lambda t: t != "")


def _documents(rows: DataFrame, session: Column, title: Column, created: Column, pieces: Column, source_type: str, first: bool) -> DataFrame:
    """Documents of parsed rows: the last session id, the first or last title and time of a file, and its pieces in order."""
    pick = F.min_by if first else F.max_by
    cols = {"_session": session, "_title": title, "_created": created, "_pieces": pieces}
    rows = rows.withColumns(cols)
    meta = rows.groupBy("path").agg(
        F.coalesce(F.max_by("_session", F.when(F.col("_session").isNotNull(), F.col("at"))), F.any_value(stem(F.col("path")))).alias("session_id"),
        pick("_title", F.when(F.col("_title").isNotNull(), F.col("at"))).alias("title"),
        pick("_created", F.when(F.col("_created").isNotNull(), F.col("at"))).alias("created_at"),
        F.max("mtime").alias("mtime"), F.max("size").alias("size"),
    )
    texts = rows.select("path", "at", F.posexplode("_pieces").alias("i", "text")).filter(~is_noise(F.col("text")))
    return finish(meta, join_pieces(texts.withColumn("at", F.struct("at", "i"))), source_type, needs_content=False)


def codex(lines: DataFrame) -> DataFrame:
    """Sessions with session_meta, user_message events and assistant messages; the last meta wins."""
    rows = _parsed(lines)
    v = F.col("v")
    kind, inner = _s(v, "$.type"), _s(v, "$.payload.type")
    meta = kind == "session_meta"
    user = F.when((kind == "event_msg") & (inner == "user_message"), F.array(F.trim(F.coalesce(_s(v, "$.payload.message"), F.lit("")))))
    assistant = F.when((kind == "response_item") & (inner == "message") & (_s(v, "$.payload.role") == "assistant"), _blocks(v, "$.payload.content"))
    created = F.coalesce(_s(v, "$.payload.timestamp"), _s(v, "$.timestamp"))
    return _documents(rows, F.when(meta, _s(v, "$.payload.id")), F.when(meta, _s(v, "$.payload.cwd")), F.when(meta, created), F.coalesce(user, assistant, F.array().cast("array<string>")), "codex_session", first=False)


def claude(lines: DataFrame) -> DataFrame:
    """Sessions of user texts and assistant blocks; the first directory and time, the last session id."""
    rows = _parsed(lines)
    v = F.col("v")
    kind = _s(v, "$.type")
    said = _s(v, "$.message.content")
    user = F.when((kind == "user") & said.isNotNull(), F.array(said))
    assistant = F.when(kind == "assistant", _blocks(v, "$.message.content"))
    empty = F.lit("")
    return _documents(rows, F.nullif(_s(v, "$.sessionId"), empty), F.nullif(_s(v, "$.cwd"), empty), F.nullif(_s(v, "$.timestamp"), empty), F.coalesce(user, assistant, F.array().cast("array<string>")), "claude_session", first=True)


def _flat(lines: DataFrame, texts: DataFrame, source_type: str) -> DataFrame:
    meta = lines.groupBy("path").agg(F.max("mtime").alias("mtime"), F.max("size").alias("size"))
    meta = meta.select("path", stem(F.col("path")).alias("session_id"), file_name(F.col("path")).alias("title"), F.lit("").alias("created_at"), "mtime", "size")
    return finish(meta, join_pieces(texts), source_type, needs_content=True)


def history(lines: DataFrame, source_type: str) -> DataFrame:
    """Prompt histories: the first text of display, text, input, prompt and message of each line."""
    v = F.col("v")
    text = F.coalesce(*[F.when(F.trim(_s(v, f"$.{k}")) != "", _s(v, f"$.{k}")) for k in ("display", "text", "input", "prompt", "message")])
    return _flat(lines, _parsed(lines).select("path", "at", text.alias("text")), source_type)


def shell(lines: DataFrame, source_type: str) -> DataFrame:
    """Shell histories: plain commands, and those behind `: time:elapsed;`."""
    line = F.trim("line")
    command = F.when(line.startswith(": "), F.regexp_extract(line, r"^[^;]*;(.*)$", 1)).otherwise(line)
    return _flat(lines, lines.select("path", "at", command.alias("text")), source_type)


# Keys whose texts count in any record, and keys under which further values are.
TEXT_KEYS = ("text", "input", "prompt", "display", "message", "body", "summary", "title", "textDescription", "description")
NESTED_KEYS = ("content", "parts", "messages", "items", "payload", "data", "state", "response")


def plain_text(value: str) -> str:
    """A text without white space around it; one that is a JSON string once more is unwrapped."""
    text = value.strip()
    if len(text) >= 2 and text[0] == text[-1] == '"':
        try:
            inner = json.loads(text)
        except ValueError:
            inner = None
        if isinstance(inner, str) and inner.strip():
            return inner.strip()
    return text


def fragments(node: object, depth: int = 0, most: int = 20) -> Iterator[str]:
    """All texts of a JSON value under known keys, in order, to a depth."""
    if depth > most or node is None:
        return
    if isinstance(node, str):
        yield plain_text(node)
    elif isinstance(node, list):
        for x in node:
            yield from fragments(x, depth + 1, most)
    elif isinstance(node, dict):
        for key in TEXT_KEYS:
            if isinstance(node.get(key), str):
                yield plain_text(node[key])
        for key in NESTED_KEYS:
            yield from fragments(node.get(key), depth + 1, most)


def _named(v: dict, *keys: str) -> str | None:
    """The first text under the keys that is not blank."""
    return next((v[k].strip() for k in keys if isinstance(v.get(k), str) and v[k].strip()), None)


Read = tuple[str | None, str | None, list[str]]


def read_record(v: object) -> Read:
    """Session id, title and texts of a record of any writer."""
    v = v if isinstance(v, dict) else {}
    return _named(v, "session_id", "sessionId", "id"), _named(v, "title"), list(fragments(v))


def _headed(title: str | None, directory: str | None, said: object) -> list[str]:
    head = [x for x in (title, directory) if x]
    return head + list(fragments([x for x in said if isinstance(x, dict)] if isinstance(said, list) else said if isinstance(said, dict) else None))


def read_continue(v: object) -> Read:
    """A session object with its messages under history or messages."""
    v = v if isinstance(v, dict) else {}
    session = _named(v, "sessionId", "id")
    title = _named(v, "title") or session
    return session, title, _headed(title, _named(v, "workspaceDirectory"), [m.get("message", m) if isinstance(m, dict) and isinstance(m.get("message"), dict) else m for m in v.get("history") or v.get("messages") or []])


def read_zed(v: object) -> Read:
    """A conversation object with its messages under messages or message_metadata, as a list or an object."""
    v = v if isinstance(v, dict) else {}
    session = _named(v, "id")
    title = _named(v, "title", "summary") or session
    said = v.get("messages") or v.get("message_metadata")
    if isinstance(said, dict) and not list(fragments(said)):
        said = list(said.values())  # by message id
    return session, title, _headed(title, None, said)


def read_messages(v: object) -> Read:
    """A list of messages with a content each."""
    said = [m.get("content") for m in v if isinstance(m, dict)] if isinstance(v, list) else []
    return None, None, list(fragments(said))


#: Reader of the records of each source type; others go through read_record().
READERS: dict[str, Callable[[object], Read]] = {"continue_session": read_continue, "zed_session": read_zed, "cline_session": read_messages, "roo_session": read_messages}


def generic(lines: DataFrame, source_type: str, titles: DataFrame | None = None, cap: int | None = CONTENT_CAP) -> DataFrame:
    """Transcripts of any writer: all texts under known keys, each once in its record; the last session id and title.

    titles (path, session_id, title) from elsewhere, as of sidecar files or first lines, stand before a file's own.
    """
    schema = "path string, at struct<block:bigint,row:bigint>, session string, title string, texts array<string>, mtime bigint, size bigint"
    reader = READERS.get(source_type, read_record)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = []
            for line in batch.column("line").to_pylist():
                try:
                    records.append(reader(json.loads(line)))
                except (TypeError, ValueError, RecursionError):
                    records.append((None, None, []))
            sessions, names, texts = zip(*records, strict=True) if records else ((), (), ())
            texts = [[t for t in dict.fromkeys(x) if t] for x in texts]
            columns = [batch.column("path"), batch.column("at"), pa.array(sessions, pa.string()), pa.array(names, pa.string()), pa.array(texts, pa.list_(pa.string())), batch.column("mtime"), batch.column("size")]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "at", "session", "title", "texts", "mtime", "size"])

    rows = lines.select("path", "at", "line", F.col("mtime").cast("bigint"), F.col("size").cast("bigint")).mapInArrow(run, schema)
    last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))) for c in ("session", "title")}
    meta = rows.groupBy("path").agg(last["session"].alias("s"), last["title"].alias("t"), F.max("mtime").alias("mtime"), F.max("size").alias("size"))
    path = F.col("path")
    if titles is not None:
        side = titles.select("path", F.col("session_id").alias("_s"), F.col("title").alias("_t"))
        meta = meta.join(side, "path", "left").withColumns({"s": F.coalesce(F.nullif("_s", F.lit("")), "s"), "t": F.coalesce(F.nullif("_t", F.lit("")), "t")}).drop("_s", "_t")
    meta = meta.select("path", F.coalesce("s", stem(path)).alias("session_id"), F.coalesce("t", file_name(path)).alias("title"), F.lit("").alias("created_at"), "mtime", "size")
    texts = rows.select("path", "at", F.posexplode("texts").alias("i", "text")).select("path", F.struct("at", "i").alias("at"), "text")
    return finish(meta, join_pieces(texts, cap=cap), source_type, needs_content=True)


def copilot(lines: DataFrame) -> DataFrame:
    """Event logs: session start, model changes, messages of both sides, tool results up to 500 characters."""
    rows = _parsed(lines)
    v = F.col("v")
    kind = _s(v, "$.type")
    content = F.coalesce(_s(v, "$.data.content"), _s(v, "$.content"), F.lit(""))
    result = F.coalesce(_s(v, "$.data.result.content"), _s(v, "$.data.result"), _s(v, "$.data.output"), F.lit(""))
    model = F.coalesce(_s(v, "$.data.newModel"), _s(v, "$.data.model"), F.lit(""))
    piece = F.when(kind.isin("user.message", "assistant.message"), content).when(kind == "tool.execution_complete", F.substring(result, 1, 500)).when(kind == "session.model_change", model)
    start = kind == "session.start"
    cwd = F.coalesce(_s(v, "$.data.context.cwd"), _s(v, "$.data.cwd"))
    return _documents(rows, F.when(start, _s(v, "$.data.sessionId")), F.when(start, cwd), F.when(start, _s(v, "$.timestamp")), F.array(F.coalesce(piece, F.lit(""))), "copilot_session", first=True)


def with_sidecar(docs: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Documents with session id and title from a side file (session_id, title), where one names their session."""
    side = sidecars.select(F.col("session_id"), F.col("title").alias("_title")).dropDuplicates(["session_id"])
    joined = docs.join(side, "session_id", "left")
    return joined.withColumn("title", F.coalesce(F.nullif("_title", F.lit("")), "title")).select(*docs.columns)


def sidecar_titles(lines: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(path, session_id, title) of transcripts from files beside them (path, text): `session_<name>.json` before `<name>.json`, of the same folder."""
    v = F.try_parse_json("text")
    folder, name = parent(F.col("path")), stem(F.col("path"))
    session = F.coalesce(_s(v, "$.session_id"), _s(v, "$.id"))
    side = sidecars.select(folder.alias("_in"), F.regexp_replace(name, "^session_", "").alias("_of"), (~name.startswith("session_")).alias("_second"), session.alias("session_id"), F.coalesce(_s(v, "$.title"), _s(v, "$.session_title"), session).alias("title"))
    one = side.groupBy("_in", "_of").agg(F.min_by(F.struct("session_id", "title"), "_second").alias("x"))
    files = lines.select("path").distinct().select("path", folder.alias("_in"), name.alias("_of"))
    return files.join(one, ["_in", "_of"]).select("path", "x.session_id", "x.title")


def first_titles(lines: DataFrame, most: int = 6) -> DataFrame:
    """(path, session_id, title) from the first lines of each file: the first that has a title of some name, else a directory; the session is the file's name."""
    v = F.col("v")
    head = top_k(lines.select("path", "at", "line"), ["path"], [F.col("at")], most)
    rows = _parsed(head).withColumn("t", F.coalesce(*[F.nullif(_s(v, k), F.lit("")) for k in ("$.sessionTitle", "$.title", "$.session_title", "$.name", "$.cwd", "$.directory")]))
    rows = rows.groupBy("path").agg(F.min_by("t", F.when(F.col("t").isNotNull(), F.col("rank"))).alias("title"))
    return rows.select("path", stem(F.col("path")).alias("session_id"), F.coalesce("title", stem(F.col("path"))).alias("title"))


def task_titles(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """(path, session_id, title) of task folders: the folder's name and the task of its metadata file (path, text), up to 200 characters."""
    v = F.try_parse_json("text")
    folder = parent(F.col("path"))
    named = F.coalesce(F.nullif(F.trim(_s(v, "$.task")), F.lit("")), F.nullif(F.trim(_s(v, "$.title")), F.lit("")))
    meta = metadata.select(folder.alias("_in"), F.substring(named, 1, 200).alias("title"))
    tasks = files.select("path", folder.alias("_in")).join(meta, "_in", "left")
    sid = file_name(F.col("_in"))
    return tasks.select("path", sid.alias("session_id"), F.coalesce("title", sid).alias("title"))


def markdown(files: DataFrame) -> DataFrame:
    """Memory notes: `# title`, `Tags:`, `Date:`, and the body behind `## Content` (else the whole file), without private blocks. Empty ones give none."""
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    head = F.transform(lines, lambda x: F.trim(x))

    def first(test: Callable[[Column], Column]) -> Column:
        return F.get(F.filter(head, test), F.lit(0))

    place = F.array_position(F.transform(head, F.lower), "## content")
    body = F.when(place > 0, F.filter(lines, lambda x, i: i >= place))
    content = strip_private(F.array_join(F.when(F.size(body) > 0, body).otherwise(lines), "\n"))
    tags = F.substring(first(lambda x: F.lower(x).startswith("tags:")), 6, 100_000)
    date = F.trim(F.substring(first(lambda x: F.lower(x).startswith("date:")), 6, 1000))
    title = strip_private(F.substring(first(lambda x: x.startswith("# ")), 3, 100_000))
    rows = files.select("path", "mtime", content.alias("content"), F.coalesce(F.nullif(title, F.lit("")), stem(F.col("path"))).alias("title"), F.coalesce(tags, F.lit("")).alias("tags"), F.coalesce(date, F.lit("")).alias("date"))
    rows = rows.filter("content <> ''")
    epoch = F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.regexp_replace("date", "Z$", "+00:00"))), F.col("mtime"))
    rows = rows.withColumns({"created_at_epoch": epoch, "source_type": F.when(F.contains("path", F.lit("/conversations/")), "conversation").otherwise("history")})
    return rows.select(
        fingerprint(F.col("source_type"), F.col("title"), F.col("content"), F.col("created_at_epoch")).alias("fingerprint"), "source_type",
        F.element_at(F.split(stem(F.col("path")), "_"), -1).alias("session_id"), F.substring("title", 1, 240).alias("title"), "content",
        F.filter(F.transform(F.split("tags", ","), lambda x: F.trim(x)), lambda t: t != "").alias("tags"), F.col("path").alias("file_path"),
        F.coalesce(F.nullif("date", F.lit("")), F.date_format(F.timestamp_seconds("created_at_epoch"), "yyyy-MM-dd'T'HH:mm:ss")).alias("created_at"), "created_at_epoch",
    )


def aider(files: DataFrame) -> DataFrame:
    """Chat histories in Markdown: chunks between `####` and `---`, those of more than 10 characters."""
    chunks = F.filter(F.transform(F.split("text", r"(?m)^(?:####|---)"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda c: F.length(c) > 10)
    pieces = files.select("path", F.posexplode(chunks).alias("at", "text"))
    meta = files.select("path", F.substring(F.sha2("path", 256), 1, 16).alias("session_id"), file_name(F.col("path")).alias("title"), F.lit("").alias("created_at"), "mtime", "size")
    return finish(meta, join_pieces(pieces), "aider_session", needs_content=True)


def json_files(files: DataFrame, source_type: str, titles: DataFrame | None = None, cap: int | None = CONTENT_CAP) -> DataFrame:
    """One JSON value a file (message lists, threads, history objects), comments before lines removed; see generic()."""
    bare = F.regexp_replace(F.regexp_replace("text", r"(?m)^\s*//.*$", ""), r"^\s+", "")
    at = F.struct(F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("row"))
    wrapped = bare if source_type in READERS else F.when(bare.startswith("["), F.concat(F.lit('{"items": '), bare, F.lit("}"))).otherwise(bare)
    return generic(files.select("path", at.alias("at"), wrapped.alias("line"), "mtime", "size"), source_type, titles, cap)


def key_values(store: DataFrame, source_type: str, cap: int | None = CONTENT_CAP) -> DataFrame:
    """Documents of a key-value store's chat values (path, key, value, mtime, size): one for each value, its key the session."""
    at = F.struct(F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("row"))
    rows = chat_values(store).withColumn("path", F.concat("path", F.lit("#"), "key"))
    wrapped = F.when(F.ltrim("value").startswith("["), F.concat(F.lit('{"items": '), "value", F.lit("}"))).otherwise(F.col("value"))
    titles = rows.select("path", F.col("key").alias("session_id"), F.lit(None).cast("string").alias("title"))
    return generic(rows.select("path", at.alias("at"), wrapped.alias("line"), "mtime", "size"), source_type, titles, cap)


#: Parser of each source type's lines; other types go through the generic one.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "codex_session": codex, "claude_session": claude, "copilot_session": copilot,
    **{s: (lambda lines, s=s: history(lines, s)) for s in ("codex_history", "claude_history", "opencode_history", "kilo_history")},
    **{s: (lambda lines, s=s: shell(lines, s)) for s in ("shell_zsh", "shell_bash")},
}


def parse(lines: DataFrame, source_type: str) -> DataFrame:
    if source_type == "factory_session":
        return generic(lines, source_type, first_titles(lines))
    return PARSERS.get(source_type, lambda rows: generic(rows, source_type))(lines)
