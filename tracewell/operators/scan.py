"""Scan of raw JSON lines: labelled texts, the best match of each file, and totals by source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import clip_snippet, contains_any, occurrences
from tracewell.functions.variant import string_at as _string
from tracewell.functions.vocabulary import FIELD_WEIGHTS, SCAN_NOISE, SCAN_NOISE_PREFIXES

# Keys of texts in a record and in its payload.
ROOT = ["display", "text", "prompt", "content", "user_instructions", "last_agent_message", "output"]
PAYLOAD = ["message", "display", "text", "prompt", "user_instructions", "last_agent_message", "output"]


def skipped(v: Column) -> Column:
    """Records of tools, reasoning and turns, which hold nothing to find."""
    kind, inner = _string(v, "$.type"), _string(v, "$.payload.type")
    return (
        F.coalesce(kind.isin("turn_context", "custom_tool_call"), F.lit(False))
        | F.coalesce((kind == "response_item") & inner.isin("function_call_output", "function_call", "reasoning"), F.lit(False))
        | F.coalesce((kind == "event_msg") & inner.isin("token_count", "task_started"), F.lit(False))
    )


def texts(v: Column) -> Column:
    """Array of (field, text) of all labelled texts of a record."""

    def one(field: str, path: str) -> Column:
        return F.array(F.struct(F.lit(field).alias("field"), _string(v, path).alias("text")))

    def blocks(field: str, path: str) -> Column:
        items = F.try_variant_get(v, path, "array<variant>")
        return F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda b: F.struct(F.lit(field).alias("field"), _string(b, "$.text").alias("text")))

    parts = [one("message", "$.message")]
    parts += [one(f"root.{k}", f"$.{k}") for k in ROOT]
    parts += [one(f"payload.{k}", f"$.payload.{k}") for k in PAYLOAD] + [blocks("payload.content.text", "$.payload.content")]
    parts += [one("message.content", "$.message.content"), blocks("message.content.text", "$.message.content")]
    return F.filter(F.concat(*parts), lambda p: F.trim(F.coalesce(p["text"], F.lit(""))) != "")


def noise_line(text: Column, marks: Sequence[str] = SCAN_NOISE, prefixes: Sequence[str] = SCAN_NOISE_PREFIXES) -> Column:
    """Whether a text is no content: blank, with a mark, a list of short tokens (5 at least), or a listing of files."""
    low = F.lower(F.trim(text))
    lines = F.transform(F.split(low, "\n"), lambda x: F.trim(x))
    tokens = F.filter(lines, lambda x: (x != "") & (F.octet_length(x) <= 40) & ~F.contains(x, F.lit(" ")) & (occurrences(x, "/") < 2) & (occurrences(x, "-") <= 3))
    begins = F.lit(False)
    for p in prefixes:
        begins = begins | low.startswith(p.strip())
    return (low == "") | begins | contains_any(low, [*marks, "drwx", "rwxr-xr-x", "\ntotal "]) | (F.size(tokens) >= 5)


def scan(lines: DataFrame, query: str, active_dir: str | None = None, limit: int = 0) -> DataFrame:
    """One row for each file with a match of the query: path, source, session_id, lines, first_timestamp, last_timestamp, match_field, snippet, match_score.

    lines: (path, source, line_no, line). Of a file's matches the one of highest score counts, the earliest of equal
    ones; files of the active directory are left out. Lines that are no JSON count as lines only. Everything about a file
    is combined map-side, so a file of any size is no single task's.
    """
    v = F.try_parse_json("line")
    rows = lines.withColumn("v", v).withColumn("cwd", F.coalesce(_string(F.col("v"), "$.payload.cwd"), _string(F.col("v"), "$.cwd")))
    at = F.struct(F.col("line_no"))
    found = F.when(
        F.col("v").isNotNull() & ~skipped(F.col("v")),
        F.filter(texts(F.col("v")), lambda p: F.contains(F.lower(p["text"]), F.lit(query.lower())) & ~noise_line(p["text"])),
    )
    weights = F.create_map(*[F.lit(x) for pair in FIELD_WEIGHTS.items() for x in pair])

    def scored(p: Column, i: Column) -> Column:
        snippet = clip_snippet(p["text"], query)
        value = F.coalesce(weights[p["field"]], F.lit(40)) + (occurrences(F.lower(snippet), query.lower()) * 25).cast("int")
        return F.struct(value.alias("score"), (-F.col("line_no")).alias("line"), (-i).alias("i"), p["field"].alias("field"), snippet.alias("snippet"))

    rows = rows.withColumn("best", F.array_max(F.transform(found, scored)))
    session = F.coalesce(*[_string(F.col("v"), p) for p in ("$.payload.id", "$.sessionId", "$.session_id")])
    stamp = F.coalesce(*[_string(F.col("v"), p) for p in ("$.payload.timestamp", "$.timestamp", "$.createdAt", "$.created_at", "$.time")])
    files = rows.groupBy("path", "source").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.octet_length("line") + 1).alias("size_bytes"),
        F.max_by(session, F.when(session.isNotNull(), at)).alias("session_id"),
        F.min_by(stamp, F.when(stamp.isNotNull(), at)).alias("first_timestamp"),
        F.max_by(stamp, F.when(stamp.isNotNull(), at)).alias("last_timestamp"),
        F.max("best").alias("best"),
        F.max(F.coalesce(F.col("cwd") == F.lit(active_dir), F.lit(False))).alias("_active"),
    )
    files = files.filter("best is not null and not _active")
    out = files.select("path", "source", "session_id", "lines", "size_bytes", "first_timestamp", "last_timestamp", F.col("best.field").alias("match_field"), F.col("best.snippet").alias("snippet"), F.col("best.score").alias("match_score"))
    out = out.orderBy(F.desc("match_score"), F.desc_nulls_last("last_timestamp"), F.desc_nulls_last("first_timestamp"), "path")
    return out.limit(limit) if limit > 0 else out


def source_totals(summaries: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Sessions, lines and bytes of each source, with its best session as a sample; labels without a session get zeros and no sample.

    The best is the first by score, last and first timestamp (high ones first, absent ones last), and path.
    """
    # bytes of the path turned round, and a digit above all others at its end: the highest is the path that comes first
    path = F.concat(F.translate(F.hex("path"), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    sample = ["path", "session_id", "snippet", "match_field"]
    best = F.struct(F.coalesce("match_score", F.lit(0)).alias("score"), "last_timestamp", "first_timestamp", F.coalesce(path, F.lit("H")).alias("turned"), *sample)
    totals = summaries.groupBy("source").agg(
        F.count(F.lit(1)).alias("session_count"), F.sum("lines").alias("total_lines"), F.sum("size_bytes").alias("total_bytes"), F.max(best).alias("_best")
    )
    totals = totals.select(
        "source", "session_count", "total_lines", "total_bytes", F.col("_best.path").alias("first_path"), "_best.session_id", "_best.first_timestamp", "_best.last_timestamp", "_best.snippet", "_best.match_field"
    )
    if labels is None:
        return totals
    zeros = {c: 0 for c in ("session_count", "total_lines", "total_bytes")}
    return labels.select("source").distinct().join(totals, "source", "left").fillna(zeros)
