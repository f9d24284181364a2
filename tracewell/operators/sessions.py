"""Sessions out of event rows: gaps, repeated messages, last messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.topk import carried, top_k


def drop_repeats(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before in their session."""
    found = carried(rows, key, order, F.struct(F.col(value).alias("v")), "_before")
    return found.filter(F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(value))).drop("_before")


def sessions(rows: DataFrame, key: str, time: str, gap: str, least: int = 1) -> DataFrame:
    """Sessions of each key: start, last event and count; a gap closes one, and those with too few events are dropped.

    session_window merges map-side and by key, so a session that closes is one row; a hot key's events are combined
    before they meet.
    """
    found = rows.groupBy(key, F.session_window(time, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("started"), F.max(time).alias("ended"))
    return found.filter(F.col("n") >= least).select(key, "started", "ended", "n")


def last_messages(rows: DataFrame, key: str, order: list[str], n: int = 60) -> DataFrame:
    """The last n rows of each session with their rank from the end."""
    return top_k(rows, [key], [F.desc(c) for c in order], n, "from_end")
