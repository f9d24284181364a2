"""Streams of live messages: sanitised, without repeats, closed into sessions after a quiet time, and exported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import redact_secrets, strip_private
from tracewell.session import new_path

TEXT_CAP, EXPORTED = 4000, 60


def sanitise(messages: DataFrame, text: str = "text", cap: int | None = TEXT_CAP) -> DataFrame:
    """Texts without private blocks and secrets, up to cap characters (None: whole); blank ones are dropped."""
    clean = redact_secrets(strip_private(F.coalesce(F.col(text), F.lit(""))))
    clean = clean if cap is None else F.substring(clean, 1, cap)
    return messages.withColumn(text, clean).filter(F.trim(text) != "")


def close_sessions(messages: DataFrame, key: str, time: str, gap: str, delay: str, least: int = 2) -> DataFrame:
    """Sessions of each key, closed when nothing came for `gap` of event time and the watermark has passed: key, started, ended, n.

    The same plan runs over a stream and a table. Messages after a close open a new session, so none is lost; shorter
    sessions than `least` are dropped.
    """
    rows = messages.withWatermark(time, delay) if messages.isStreaming else messages
    found = rows.groupBy(key, F.session_window(time, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("started"), F.max(time).alias("ended"))
    return found.filter(F.col("n") >= least).select(key, "started", "ended", "n")


def stable_documents(versions: DataFrame, key: str, time: str, content: str, quiet: str = "180 seconds", delay: str = "10 minutes", least: int = 400) -> DataFrame:
    """The last version of each document after it did not change for `quiet`: key, changed, content. Short ones are left out."""
    rows = versions.withWatermark(time, delay) if versions.isStreaming else versions
    last = rows.groupBy(key, F.session_window(time, quiet).alias("_w")).agg(F.max(F.struct(time, content)).alias("_v"))
    return last.select(key, F.col("_v")[time].alias("changed"), F.col("_v")[content].alias(content)).filter(F.length(content) >= least)


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, with checkpoints in the shared folder, and gives the rows it put out; a sink gets each batch as well."""
    spark = stream.sparkSession
    out = new_path(spark, "stream-out")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is repeated replaces itself
        if sink:
            sink(batch, number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")
