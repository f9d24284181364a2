"""Access to parsed JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_at(v: Column, path: str) -> Column:
    """The string at a path of a variant; null if there is none, or anything else."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
