"""Messages out of new lines of live files: (path, session_id, source, text), the same over a stream of lines and a table of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.variant import string_at as _s
from tracewell.sources.lines import file_name, stem
from tracewell.streaming.live import sanitise

# Commands that are no content, record types with messages.
IGNORED_COMMANDS = ("history", "fc ")
SPOKEN = ("user", "assistant", "human")


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("v", F.try_parse_json("line")).filter(F.schema_of_variant("v").startswith("OBJECT"))


def _messages(rows: DataFrame, session: Column, source: str, text: Column, cap: int | None) -> DataFrame:
    return sanitise(rows.select("path", session.alias("session_id"), F.lit(source).alias("source"), text.alias("text")), cap=cap)


def _blocks(path: str, kind: str) -> Column:
    """The texts of a list's blocks of one kind, trimmed, without blank ones."""
    items = F.coalesce(F.try_variant_get(F.col("v"), path, "array<variant>"), F.array().cast("array<variant>"))
    kept = F.filter(items, lambda b: F.coalesce(_s(b, "$.type") == kind, F.lit(False)))
    return F.filter(F.transform(kept, lambda b: F.trim(F.coalesce(_s(b, "$.text"), F.lit("")))), lambda t: t != "")


def jsonl(lines: DataFrame, source: str, session_keys: Sequence[str], text_keys: Sequence[str], cap: int | None = 4000) -> DataFrame:
    """Prompt histories: the first session and the first text of the keys, else the text parts behind the input. Without a session the source's default."""
    v = F.col("v")
    session = F.coalesce(*[F.nullif(F.trim(F.try_variant_get(v, f"$.{k}", "string")), F.lit("")) for k in session_keys], F.lit(f"{source}_default"))
    said = [F.nullif(F.trim(_s(v, f"$.{k}")), F.lit("")) for k in text_keys]
    parts = _blocks("$.parts", "text")
    pieces = F.concat(F.filter(F.array(F.trim(_s(v, "$.input"))), lambda x: x.isNotNull() & (x != "")), parts)
    return _messages(_parsed(lines), session, source, F.coalesce(*said, F.when(F.size(parts) > 0, F.array_join(pieces, "\n"))), cap)


def shell(lines: DataFrame, source: str, now: Column | None = None, cap: int | None = 4000) -> DataFrame:
    """Commands, plain or behind `: time:elapsed;`: a session for each source and day. now stands in for a time that is not written."""
    line = F.trim("line")
    stamped = line.rlike(r"^:\s*\d+:\d+;")
    command = F.trim(F.when(stamped, F.regexp_extract(line, r"^:\s*\d+:\d+;(.*)$", 1)).otherwise(line))
    time = F.when(stamped, F.timestamp_seconds(F.regexp_extract(line, r"^:\s*(\d+):", 1).cast("bigint"))).otherwise(F.current_timestamp() if now is None else now)
    ignored = F.lit(False)
    for prefix in IGNORED_COMMANDS:
        ignored = ignored | F.lower(command).startswith(prefix)
    return _messages(lines.filter(~ignored), F.concat(F.lit(f"{source}_"), F.date_format(time, "yyyyMMdd")), source, command, cap)


def codex(lines: DataFrame, cap: int | None = 4000) -> DataFrame:
    """What an assistant said or reasoned; the file is the session."""
    v = F.col("v")
    inner = _s(v, "$.payload.type")
    text = F.when(inner == "message", F.array_join(_blocks("$.payload.content", "output_text"), "\n")).when(inner == "reasoning", _s(v, "$.payload.text"))
    rows = _parsed(lines).filter(_s(v, "$.type") == "response_item")
    return _messages(rows, file_name(F.col("path")), "codex_session", text, cap)


def claude(lines: DataFrame, root: str = "", cap: int | None = 4000) -> DataFrame:
    """What users and assistants said, as text, blocks or object; the session is the file's name with a hash of its path below root."""
    v = F.col("v")
    blocks = _blocks("$.content", "text")
    text = F.coalesce(_s(v, "$.content"), F.when(F.size(blocks) > 0, F.array_join(blocks, " ")), _s(v, "$.content.text"))
    below = F.regexp_replace(F.replace("path", F.lit(root), F.lit("")), "^/", "") if root else F.col("path")
    session = F.concat(stem(F.col("path")), F.lit("_"), F.substring(F.sha2(below, 256), 1, 10))
    return _messages(_parsed(lines).filter(_s(v, "$.type").isin(*SPOKEN)), session, "claude_transcripts", F.trim(text), cap)
