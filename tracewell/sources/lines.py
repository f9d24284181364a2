"""Text files as rows of lines with their place, and assembly of documents from text pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.text import compact
from tracewell.operators.topk import positions, top_k

#: Characters that a document's content keeps, separators counted.
CONTENT_CAP, TITLE_CAP = 24_000, 300


def read_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """(path, at, line, mtime, size) of all lines of the files; `at` orders the lines of a file, also over splits of it."""
    rows = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).text(path)
    meta = F.col("_metadata")
    return rows.select(
        meta["file_path"].alias("path"),
        F.struct(meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
        F.col("value").alias("line"),
        F.unix_timestamp(meta["file_modification_time"]).alias("mtime"),
        meta["file_size"].alias("size"),
    )


def read_whole(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, text, mtime, size) of whole files."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    meta = F.col("_metadata")
    return rows.select(meta["file_path"].alias("path"), F.col("value").alias("text"), F.unix_timestamp(meta["file_modification_time"]).alias("mtime"), meta["file_size"].alias("size"))


def stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^file:/*(?=/)", ""), r"/[^/]*$", "")


def join_pieces(pieces: DataFrame, key: str = "path", at: str = "at", text: str = "text", cap: int | None = CONTENT_CAP) -> DataFrame:
    """(key, content): the pieces of each key in order, white space compacted, joined by line ends, up to the cap (None: whole texts).

    Pieces beyond the cap are dropped before a key's pieces meet: as each adds two characters at least, the first cap / 2
    of a key, found by parts of it, are enough. Without a cap a key's row grows with its pieces; see ordered_pieces().
    """
    clean = pieces.select(key, F.col(at).alias("_at"), compact(F.col(text)).alias("_text")).filter("_text is not null and _text <> ''")
    if cap is None:
        gathered = clean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_all"))
        return gathered.select(key, F.array_join(F.col("_all._text"), "\n").alias("content"))
    clean = top_k(clean, [key], [F.col("_at"), F.col("_text")], cap // 2 + 1).drop("rank")
    before = F.sum(F.length("_text") + 1).over(Window.partitionBy(key).orderBy("_at", "_text").rowsBetween(Window.unboundedPreceding, -1))
    kept = clean.withColumn("_left", cap - F.coalesce(before, F.lit(0))).filter("_left > 0").withColumn("_text", F.expr("substring(_text, 1, cast(_left as int))"))
    gathered = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_all"))
    return gathered.select(key, F.array_join(F.col("_all._text"), "\n").alias("content"))


def ordered_pieces(pieces: DataFrame, key: str = "path", at: str = "at", text: str = "text") -> DataFrame:
    """(key, place, text): all pieces of each key, white space compacted, with their place from 1. In this order, joined by line ends, they are the key's whole text.

    Places come from range partitions, so that a key of any size is never gathered in one task.
    """
    clean = pieces.select(key, F.col(at).alias("_at"), compact(F.col(text)).alias("_text")).filter("_text is not null and _text <> ''")
    placed = positions(clean, [key, "_at", "_text"], "_position")
    first = placed.groupBy(key).agg(F.min("_position").alias("_first"))
    return placed.join(first, key).select(key, (F.col("_position") - F.col("_first") + 1).alias("place"), F.col("_text").alias(text))


def finish(meta: DataFrame, contents: DataFrame, source_type: str, needs_content: bool) -> DataFrame:
    """Documents from (path, session_id, title, created_at, mtime, size) and their contents. Without content the title stands in, or no document is made."""
    docs = meta.join(contents, "path", "inner" if needs_content else "left")
    title = F.coalesce(F.nullif("title", F.lit("")), parent(F.col("path")))
    created = F.coalesce(F.nullif("created_at", F.lit("")), F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd'T'HH:mm:ss"))
    epoch = F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.regexp_replace("created_at", "Z$", "+00:00"))), F.col("mtime"))
    return docs.select(
        F.col("path").alias("file_path"), F.lit(source_type).alias("source_type"), "session_id", F.substring(title, 1, TITLE_CAP).alias("title"),
        F.coalesce(F.nullif("content", F.lit("")), title).alias("content"), created.alias("created_at"), epoch.alias("created_at_epoch"),
        F.col("mtime").alias("file_mtime"), F.col("size").alias("file_size"),
    )
