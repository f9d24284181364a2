"""Common inputs of the queries: documents and observations as they stand after synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from tracewell.operators.topk import newest
from tracewell.tables import table

#: Time as of which recency counts in the registered queries.
AS_OF = 1_767_225_600


def documents(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """The newest row of each session document: all columns, or its path and the given ones. Expressions are computed where the rows are read, so that only their results are shuffled."""
    return newest(table(spark, sf_dir, "session_documents"), "file_path", ["updated_at_epoch"], columns)


def observations(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    return newest(table(spark, sf_dir, "observations"), "id", ["updated_at_epoch"], columns)


DOCS = "docs as (select * from session_documents qualify row_number() over (partition by file_path order by updated_at_epoch desc) = 1)"
OBS = "obs as (select * from observations qualify row_number() over (partition by id order by updated_at_epoch desc) = 1)"
