"""Queries on time texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.operators.timestamps import estimate_zones, normalise_columns, order_evidence
from tracewell.tables import table


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, summary = table(spark, sf_dir, "session_documents"), table(spark, sf_dir, "session_summary")
    ordered = [order_evidence(summary, "first_timestamp", "last_timestamp", "machine_id")]
    return estimate_zones(docs, "created_at", "machine_id", "file_mtime", table(spark, sf_dir, "machines"), ordered=ordered)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time text of session documents and summaries that denotes an instant, in microseconds of UTC."""
    docs, summary = table(spark, sf_dir, "session_documents"), table(spark, sf_dir, "session_summary")
    columns = [
        ("session_documents", docs, "file_path", "created_at"),
        ("session_summary", summary, "path", "first_timestamp"),
        ("session_summary", summary, "path", "last_timestamp"),
    ]
    return normalise_columns(columns, _zones(spark, sf_dir))


def p1_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone of each machine, with the evidence for it."""
    return _zones(spark, sf_dir)


QUERIES = {"p1_found": p1_found, "p1_zones": p1_zones}
SQL: dict[str, str] = {}
