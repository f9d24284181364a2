"""What goes out: sessions as Markdown texts, memories as notes, rows as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import safe_name
from tracewell.operators.topk import top_k

#: Messages of a session that are exported, the last ones, and characters of each.
MESSAGES, CHARACTERS = 60, 2000


def session_notes(messages: DataFrame, key: str, order: list[str], text: str, source: str, messages_most: int = MESSAGES, least: int = 2) -> DataFrame:
    """(key, file_name, note): a bullet list of each session's last messages, for sessions with enough of them."""
    last = top_k(messages.select(key, *order, text), [key], [F.desc(c) for c in order], messages_most, "_back")
    gathered = last.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("at"), F.substring(text, 1, CHARACTERS).alias("text")))).alias("all"))
    note = F.concat(F.lit("# "), F.col(key), F.lit("\n\n- "), F.array_join(F.col("all.text"), "\n- "))
    return gathered.filter(F.col("n") >= least).select(key, F.concat(F.lit(f"{source}_"), safe_name(F.col(key), 64), F.lit(".md")).alias("file_name"), note.alias("note"))


def memory_note(title: Column, tags: Column, date: Column, content: Column) -> Column:
    """A memory as a Markdown note, as the note parser reads it; null where title or content is blank."""
    note = F.concat(F.lit("# "), F.trim(title), F.lit("\n\nTags: "), F.array_join(tags, ", "), F.lit("\nDate: "), date, F.lit("\n\n## Content\n\n"), F.trim(content), F.lit("\n"))
    return F.when((F.trim(F.coalesce(title, F.lit(""))) != "") & (F.trim(F.coalesce(content, F.lit(""))) != ""), note)


def write_notes(notes: DataFrame, path: str, name: str = "file_name", note: str = "note") -> None:
    """One folder of text for each file name; runs in a batch or as a stream's sink."""
    notes.select(name, note).write.mode("append").partitionBy(name).option("lineSep", "\n").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
