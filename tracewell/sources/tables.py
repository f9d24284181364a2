"""Documents out of chat databases: sessions with their part rows, and key-value stores read from SQLite files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tracewell.functions.variant import string_at
from tracewell.sources.lines import CONTENT_CAP, join_pieces

#: Keys of chats in the key-value stores of editors (fixed values).
CHAT_KEYS = ["chat", "conversation", "composer", "aichat", "copilot", "prompts", "generations", "messages"]


def part_texts(parts: DataFrame) -> DataFrame:
    """(session_id, at, text) of part rows whose data holds a text, in order of time and id."""
    v = F.try_parse_json("data")
    text = F.coalesce(string_at(v, "$.text"), string_at(v, "$.message"), string_at(v, "$.message.content"))
    rows = parts.select("session_id", F.struct("time_created", "id").alias("at"), text.alias("text"))
    return rows.filter("session_id is not null and text is not null")


def session_documents(
    sessions: DataFrame, parts: DataFrame, source_type: str, full: bool = False, messages: DataFrame | None = None, cap: int | None = CONTENT_CAP
) -> DataFrame:
    """One document for each session, with its parts' texts in order; with `full` also for sessions that only parts know (their id is the title).

    messages (rows as parts) stand in for the parts of sessions that have no part with a text. Times are milliseconds;
    the epoch is at least 1. Contents end at cap characters (None: whole texts).
    """
    one = sessions.filter("id is not null").groupBy("id").agg(F.max(F.struct("time_updated", "time_created", "title", "directory")).alias("s"))
    one = one.select(F.col("id").alias("session_id"), "s.*")
    texts = part_texts(parts)
    if messages is not None:
        texts = texts.unionByName(part_texts(messages).join(texts.select("session_id").distinct(), "session_id", "left_anti"))
    contents = join_pieces(texts, "session_id", cap=cap)
    docs = one.join(contents, "session_id", "full" if full else "left")
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("directory", F.lit("")), "session_id")
    epoch = F.greatest(F.lit(1), F.floor(F.coalesce("time_updated", "time_created", F.lit(0)) / 1000)).cast("bigint")
    return docs.select("session_id", F.lit(source_type).alias("source_type"), title.alias("title"), F.coalesce(F.nullif("content", F.lit("")), title).alias("content"), epoch.alias("created_at_epoch"))


class SqliteTable(DataSource):
    """Rows of a query over SQLite files, one partition a file: options path (comma-separated files), query, schema by the reader."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return self.options.get("columns", "key string, value string")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.options, self.names = dict(options), schema.names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.options["path"].split(",") if p]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import sqlite3

        query = self.options.get("query", "select key, value from ItemTable")
        with sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True) as db:
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            yield from db.execute(query)


def chat_values(store: DataFrame, least: int = 10, most: int = 10_000_000, keys: list[str] = CHAT_KEYS) -> DataFrame:
    """Values of a key-value store whose key names chats, of plausible length."""
    named: Column = F.lit(False)
    for k in keys:
        named = named | F.contains(F.lower("key"), F.lit(k))
    return store.filter(named & F.length("value").between(least, most))
