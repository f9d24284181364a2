"""Best rows of each group, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import pin


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", parts: int = 16) -> DataFrame:
    """The first k rows of each group by `order`, with their rank from 1. Each of `parts` random parts of a group is cut to k rows before they meet."""
    salted = df.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")]), F.lit(parts)))
    first = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).filter(F.col("_rank") <= k)
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k).drop("_part", "_rank")


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first by `order`; equal rows are one. A key's versions are few, copies are dropped before they meet."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.distinct().withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def newest(df: DataFrame, key: str, versions: Sequence[str], columns: Sequence[str | Column] = ()) -> DataFrame:
    """One row for each key, that of the highest versions (equal ones: the highest row). One shuffle, combined map-side first, so a key with many rows is no burden; a null key is a key.

    With columns, the result is the key and these; nothing else is read or shuffled. An expression among them is computed
    for each row before the newest is found.
    """
    if columns:
        wanted = [c for c in columns if not (isinstance(c, str) and c == key)]
        names = df.select(*wanted).columns
        rows = df.select(key, F.struct(*versions).alias("_version"), *wanted)
        best = rows.groupBy(key).agg(F.max(F.struct("_version", *names)).alias("_best"))
        return best.select(key, *[F.col("_best")[c].alias(c) for c in names])
    rest = [c for c in df.columns if c != key and c not in versions]
    best = df.groupBy(key).agg(F.max(F.struct(*versions, *rest)).alias("_best"))
    return best.select(*[F.col(key) if c == key else F.col("_best")[c].alias(c) for c in df.columns])


def positions(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Adds each row's place (from 1) in the order of whole columns, without one task seeing all rows.

    Rows are sorted into ranges; a range's rows are counted, and the counts of the ranges before it are added. The sorted
    rows are written once, as counts and places must be of the same ranges.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = pin(sorted_rows.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "positions")
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    row = F.col("_row") - F.shiftleft(F.col("_range").cast("bigint"), 33)  # the lower 33 bits count within the range
    return placed.join(F.broadcast(offsets.select("_range", "_before")), "_range").withColumn(name, F.col("_before") + row + 1).drop("_range", "_row", "_before")


def carried(df: DataFrame, key: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the last value that is not null among the rows before a row in its key's order, without one task seeing all rows of a key.

    Rows are sorted into ranges; within a range a window looks back, and what a key's earlier ranges end with, one row for
    each range and key, is carried over. The sorted rows are written once, as both must see the same ranges.
    """
    sorted_rows = df.withColumn("_value", value).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = pin(sorted_rows.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "carried")
    before = Window.partitionBy("_range", key).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy("_range", key).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_row"))).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_range"), F.col(key).alias("_key"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried")).filter("_carried is not null")
    found = placed.withColumn(name, F.last("_value", ignorenulls=True).over(before)).withColumnRenamed("_range", "_at")
    found = found.join(ends, (F.col("_at") == F.col("_range")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return found.withColumn(name, F.coalesce(name, "_carried")).drop("_value", "_at", "_range", "_row", "_key", "_carried")
