"""Time texts against instants worked out by hand or by zoneinfo."""

from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tracewell.operators.timestamps import candidate_zones, estimate_zones, normalise_columns, order_evidence, parse, to_utc, zone_classes
from tracewell.plans.timestamps import p1_found
from tracewell.tables import table


def us(*parts, zone="UTC", micro=0):
    return int(datetime(*parts, tzinfo=ZoneInfo(zone)).timestamp()) * 1_000_000 + micro


CASES = [
    ("2023-01-09T06:17:37Z", "m1", us(2023, 1, 9, 6, 17, 37)),
    ("2023-04-06T18:58:41.889541606Z", "m1", us(2023, 4, 6, 18, 58, 41, micro=889541)),
    ("\t2024-02-25t10:06:24,50z ", "m1", us(2024, 2, 25, 10, 6, 24, micro=500000)),
    ("20230304T153700Z", None, us(2023, 3, 4, 15, 37)),
    ("20230311 002615", "m1", us(2023, 3, 11, 0, 26, 15, zone="Europe/Berlin")),
    ("2023-05-08 17:04:44 CEST", "m1", us(2023, 5, 8, 15, 4, 44)),
    ("2024-07-30 07:06:09 IST", "m3", us(2024, 7, 30, 1, 36, 9)),
    ("1676057775.856", None, us(2023, 2, 10, 19, 36, 15, micro=856000)),
    ("1677103279598137", None, 1677103279598137),
    ("1680272830507", "m1", 1680272830507000),
    ("1680272830507123456", "m1", 1680272830507123),
    ("29.04.2023 09:59:40", "m2", us(2023, 4, 29, 9, 59, 40, zone="America/New_York")),
    ("25/Apr/2023:13:26:39 +0545", "m1", us(2023, 4, 25, 7, 41, 39)),
    ("Wed, 15 Feb 2023 06:24:35 +1100", None, us(2023, 2, 14, 19, 24, 35)),
    ("Mon Jul  3 08:39:35 2023", "m2", us(2023, 7, 3, 12, 39, 35)),
    ("17-Jan-2023 09:10:25", "m1", us(2023, 1, 17, 8, 10, 25)),
    ("Jul 28, 2023 1:03 AM", "m1", us(2023, 7, 27, 23, 3)),
    ("Aug 19, 2024 12:26:09 AM UTC-02:30", "m1", us(2024, 8, 19, 2, 56, 9)),
    ("2023-02-04 06:20:39 PM", "m1", us(2023, 2, 4, 17, 20, 39)),
    ("2025年3月30日 01:15:55", "m1", us(2025, 3, 30, 0, 15, 55)),
    ("2023-06-16", "m1", us(2023, 6, 15, 22)),
    ("2023-12-02T12:23:27-05:00[America/New_York]", "m1", us(2023, 12, 2, 17, 23, 27)),
    ("2023-02-20 10:00:00 America/Sao_Paulo", None, us(2023, 2, 20, 13)),
    ("2023-06-23 19:17:51 [Europe/London]", "m1", us(2023, 6, 23, 18, 17, 51)),
    ("2024-09-12T20:04:08+00", "m1", us(2024, 9, 12, 20, 4, 8)),
    ("2023-10-29 02:30:00", "m1", us(2023, 10, 29, 0, 30)),  # twice: the first
    ("2023-03-26 02:30:00", "m1", us(2023, 3, 26, 1, 30)),  # skipped: moves on by an hour
    ("2023-02-20 10:00:00", None, None),
    ("2023-02-20 10:00:00", "unknown", None),
    ("2025-06-31 08:15:00", "m1", None),
    ("2024-02-30T10:00:00Z", "m1", None),
    ("2024-02-20 13:00:00 PM", "m1", None),
    ("2024-02-20 25:00:00", "m1", None),
    ("2024-02-20 10:00:00 Nowhere/Land", "m1", None),
    ("yesterday 14:02", "m1", None),
    ("%Y-%m-%dT%H:%M:%S", "m1", None),
    ("", "m1", None),
    (None, "m1", None),
    ("x" * 100_000, "m1", None),
]


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame([("m1", "Europe/Berlin"), ("m2", "America/New_York"), ("m3", "Asia/Kolkata"), (None, "UTC")], "machine string, zone string")


def test_instants(spark, zones):
    rows = spark.createDataFrame([(i, t, m) for i, (t, m, _) in enumerate(CASES)], "i int, text string, machine string")
    got = {r.i: r.utc_us for r in to_utc(rows, "text", "machine", zones).collect()}
    assert {i: (CASES[i][0], v) for i, v in got.items()} == {i: (t, v) for i, (t, _, v) in enumerate(CASES)}


def test_columns_with_clashing_names_and_empty_tables(spark, zones):
    rows = spark.createDataFrame([("2023-01-09T06:17:37Z", "m1", 7, "x")] * 2, "text string, machine string, utc_us int, zone string")
    assert [r.utc_us for r in to_utc(rows, "text", "machine", zones).collect()] == [CASES[0][2]] * 2
    empty = rows.limit(0)
    assert to_utc(empty, "text", "machine", zones).count() == 0
    assert parse(empty, "text").count() == 0


def test_zones_are_estimated_without_the_registry(spark):
    sf = "/root/testdata/sf0.1"
    known = table(spark, sf, "machines")
    blind = known.selectExpr("machine_id", "cast(null as string) tz_name")
    found = estimate_zones(table(spark, sf, "session_documents"), "created_at", "machine_id", "file_mtime", blind, zones=candidate_zones(known)).collect()
    declared = {r.machine_id: r.tz_name for r in known.collect()}
    right = [r.zone == declared[r.machine_id] for r in found]
    assert len(found) == len(declared) and sum(right) >= 0.9 * len(right)
    with_registry = estimate_zones(table(spark, sf, "session_documents"), "created_at", "machine_id", "file_mtime", known).collect()
    assert all(r.zone == declared[r.machine_id] for r in with_registry)


def same_history(a, b):
    days = [datetime(y, m, 15, tzinfo=UTC) for y in (2023, 2024, 2025) for m in range(1, 13)]
    return all(d.astimezone(ZoneInfo(a)).utcoffset() == d.astimezone(ZoneInfo(b)).utcoffset() for d in days)


def test_a_wrong_registry_is_corrected(spark):
    """Eight machines are registered in a zone they are not in: all evidence together finds theirs, out of all zones there are, and leaves the others."""
    sf = "/root/testdata/sf0.1"
    known, docs = table(spark, sf, "machines"), table(spark, sf, "session_documents")
    declared = {r.machine_id: r.tz_name for r in known.collect()}
    moved = sorted(declared)[:8]
    wrong = F.when(F.col("machine_id").isin(moved), F.when(F.col("tz_name") == "Asia/Tokyo", "Europe/Berlin").otherwise("Asia/Tokyo")).otherwise(F.col("tz_name"))
    ordered = [order_evidence(table(spark, sf, "session_summary"), "first_timestamp", "last_timestamp", "machine_id")]
    found = estimate_zones(docs, "created_at", "machine_id", "file_mtime", known.withColumn("tz_name", wrong), ordered=ordered).collect()
    assert all(same_history(r.zone, declared[r.machine_id]) for r in found) and len(found) == len(declared)
    blind = known.selectExpr("machine_id", "cast(null as string) tz_name")
    found = estimate_zones(docs, "created_at", "machine_id", "file_mtime", blind, ordered=ordered).collect()
    assert sum(same_history(r.zone, declared[r.machine_id]) for r in found) >= 0.9 * len(found)


def test_order_of_two_times_is_evidence(spark):
    rows = [("m", "2023-01-01 10:00:00", "2023-01-01T08:00:00Z"), ("m", "2023-01-01T08:00:00Z", "2023-01-01 10:00:00"), ("m", "2023-01-01 10:00:00", "2023-01-01 11:00:00"), ("m", None, "2023-01-01T08:00:00Z"), (None, "2023-01-01 10:00:00", "2023-01-01T08:00:00Z")]
    got = order_evidence(spark.createDataFrame(rows, "m string, a string, b string"), "a", "b", "m")
    assert sorted((r._us - us(2023, 1, 1), r._in - us(2023, 1, 1), r._bound) for r in got.collect()) == [(36_000_000_000, 28_800_000_000, -1), (36_000_000_000, 28_800_000_000, 1)]
    assert order_evidence(spark.createDataFrame([], "m string, a string, b string"), "a", "b", "m").count() == 0


def test_zones_of_one_history_are_one(spark):
    found = zone_classes(2023, 2024, ["Europe/Berlin", "Europe/Paris"])
    assert {"Europe/Berlin", "Europe/Paris"} <= set(found) and "Europe/Vienna" not in found and 40 < len(found) < 150


def test_repeated_rows_and_null_keys_give_one_row_each(spark, zones):
    rows = spark.createDataFrame([("a", "2023-01-09T06:17:37Z", "m1")] * 3 + [(None, "2023-01-09T06:17:37Z", "m1"), ("b", None, None)], "k string, t string, machine_id string")
    got = normalise_columns([("x", rows, "k", "t")], zones.withColumnRenamed("machine", "machine_id")).collect()
    assert [tuple(r) for r in got] == [("x", "a", "t", CASES[0][2])]


def test_query_covers_all_fields(spark, sf):
    rows = p1_found(spark, sf)
    assert {r.field for r in rows.select("field").distinct().collect()} == {"created_at", "first_timestamp", "last_timestamp"}
    assert rows.count() == rows.distinct().count()
