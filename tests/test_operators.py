"""Operators on small tables with nulls, ties, repetitions and nothing at all; streams."""

import json
import os
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.operators import memory, prewarm, ranking, scan, search, sessions, topk
from tracewell.streaming.live import close_sessions, run_to_end, sanitise


def test_top_k_and_positions(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 10).alias("v"))
    got = topk.top_k(rows, ["g"], [F.desc("v"), F.col("id")], 2)
    assert sorted((r.g, r.id, r["rank"]) for r in got.collect()) == [(0, 9, 1), (0, 39, 2), (1, 19, 1), (1, 49, 2), (2, 29, 1), (2, 59, 2)]
    placed = topk.positions(rows.repartition(7), ["v", "id"])
    expected = {(r.v, r.id): i + 1 for i, r in enumerate(rows.orderBy("v", "id").collect())}
    assert {(r.v, r.id): r.position for r in placed.collect()} == expected
    assert topk.positions(rows.limit(0), ["v"]).count() == 0


def test_timeline_ties_count_as_before(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([10, 20, 20, 20, 30, 40])] + [(99, None)], "id bigint, created_at_epoch bigint")
    got = {(r.side, r.id) for r in memory.timeline(rows, spark.createDataFrame([(1,), (7,)], "id bigint"), 1, 1).collect()}
    assert got == {("before", 3), ("before", 2), ("after", 4)}


def test_changes_and_reconcile(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("w", 1), ("z", None)], "k string, v int")
    assert {r.k: r.change for r in memory.changes(a, b, "k", ["v"]).collect()} == {"x": "unchanged", "y": "updated", "w": "removed", "z": "unchanged"}
    stored = spark.createDataFrame([(1, "p1", "f1", "history", 1), (2, "p1", "f0", "history", 0), (3, "old", "f3", "history", 1), (4, "gone", "f4", "conversation", 1), (5, "gone2", "f5", "import", 1)],
                                   "id bigint, file_path string, fingerprint string, source_type string, updated_at_epoch bigint")
    files = spark.createDataFrame([("p1", "f1"), ("new", "f3"), ("n2", "f9")], "file_path string, fingerprint string")
    got = {(r.action, r.file_path, r.id) for r in memory.reconcile(stored, files).collect()}
    assert got == {("touched", "p1", 1), ("duplicate", "p1", 2), ("renamed", "new", 3), ("added", "n2", None), ("removed", "gone", 4)}


def test_import(spark):
    payload = spark.createDataFrame([
        ("import", "s", "t", "body token=abcdefgh12", '["a","a"]', "/home/u/x.md", 1, None), ("import", "s", "t", "body token=abcdefgh12", None, "", 1, None), (None, "s", "t2", "b", None, None, 2, "known"),
        ("x", "s", " ", "b", None, None, 2, "blank"), ("x", "s", "t", "<private>b</private>", None, None, 2, "private")],
        "source_type string, session_id string, title string, content string, tags_json string, file_path string, created_at_epoch bigint, fingerprint string")
    got = memory.importable(payload, spark.createDataFrame([("known",)], "fingerprint string")).collect()
    assert len(got) == 1 and got[0].content == "body token=***"
    assert got[0].file_path in ("", "import://local-path-redacted")
    assert memory.importable(payload.limit(0), payload.select("fingerprint")).count() == 0


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (6, [1.0]), (7, None), (8, [2.0, 0.0])], "i int, v array<float>")
    got = ranking.nearest(rows, rows.filter("i = 1"), "i", "v", 3).collect()
    assert [(r.key, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (8, 2), (2, 3)]
    assert ranking.nearest(rows.limit(0), rows, "i", "v", 3).count() == 0
    assert ranking.nearest(rows, rows.limit(0), "i", "v", 3).count() == 0
    docs = ranking.embed(spark.createDataFrame([("abc",), ("abd",), ("xyz",), ("",), (None,)], "t string"), "t", dim=64)
    sizes = {r.t: round(sum(x * x for x in r.embedding), 3) for r in docs.collect()}
    assert sizes == {"abc": 1.0, "abd": 1.0, "xyz": 1.0, "": 0.0, None: 0.0}


def test_bm25_scores_all_terms_of_a_query(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(20, 60))) for _ in range(60)] + ["", None, "!", "w1 w2"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string").repartition(3)
    counts = {i: Counter(t.split()) for i, t in enumerate(texts) if t and t != "!"}
    df, mean = Counter(w for c in counts.values() for w in c), sum(c.total() for c in counts.values()) / len(counts)
    expected = set()
    for query in (i for i in counts if i % 5 == 0):
        scores = {}
        for key, c in counts.items():
            weights = [math.log(1 + (len(counts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for w in counts[query] if w in c]
            if weights:
                scores[key] = round(sum(weights), 9)
        expected |= {(query, key, rank + 1, round(scores[key], 6)) for rank, key in enumerate(sorted(scores, key=lambda x: (-scores[x], x))[:5])}
    assert max(len(c) for c in counts.values()) > 16

    def got():
        return {(r["query"], r.key, r["rank"], round(r.score, 6)) for r in ranking.bm25(docs, docs.filter("i % 5 = 0"), "i", "t", 5).collect()}

    assert got() == expected
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 4)  # several blocks
    assert got() == expected
    assert ranking.bm25(docs, docs.limit(0), "i", "t").count() == 0 == ranking.bm25(docs.limit(0), docs, "i", "t").count()


def test_fusion(spark):
    a = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("only", "z", 1)], "query string, key string, rank int")
    b = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "query string, key string, rank int")
    got = ranking.fuse(a, b).collect()
    q = [r.key for r in sorted((r for r in got if r["query"] == "q"), key=lambda r: r["rank"])]
    assert q == ["b", "a", "c"]
    assert [r.rrf_score for r in got if r["query"] == "only"] == [pytest.approx(1 / 61)]


def test_search_falls_back_to_rare_terms_and_session_first(spark):
    docs = spark.createDataFrame([("p1", "shell_zsh", "t", "alpha " * 3, 1_700_000_000), ("p2", "codex_session", "/w", "beta", 1_700_000_000), ("p3", None, None, None, None)],
                                 "file_path string, source_type string, title string, content string, created_at_epoch bigint")
    assert [r.file_path for r in search.search(docs, "alpha beta", 1_700_000_000).collect()] == ["p2", "p1"]
    assert search.search(docs, "nothing", 1_700_000_000).count() == 0
    assert search.least_frequent(docs, ["alpha", "p", "zzz"]) == ["alpha", "p"]
    assert search.route("0A1b2c3d-ff") == "session" and search.route("hello") == "search"


def test_prewarm_reasons(spark):
    said = [(1, "ok"), (2, "alpha beta gamma"), (3, "alpha beta delta"), (4, "please continue that"), (5, "where is the parser module"), (5000, "omega psi chi words")]
    rows = spark.createDataFrame([("w", t, m) for t, m in said], "w string, t bigint, m string")
    got = [r.reason for r in prewarm.classify(rows, "w", "t", "m").orderBy("t").collect()]
    assert got == ["trivial", "cold-start", "same-topic", "continuation", "structural", "new-topic"]


def test_source_totals_show_the_best_session(spark):
    kind = "source string, path string, session_id string, lines bigint, size_bytes bigint, first_timestamp string, last_timestamp string, snippet string, match_field string, match_score int"
    rows = [
        ("a", "/1", "s1", 1, 10, "t1", "t9", "x1", "f", 5), ("a", "/9", "s2", 2, 20, "t2", "t3", "x2", "g", 7), ("a", "/8", "s3", 3, 30, "t9", None, "x3", "f", 7),
        ("b", "/ab", "s4", 1, 1, None, "t1", "x4", "f", 1), ("b", "/a", "s5", 1, 1, "t0", "t1", "x5", "f", 1), ("b", "/abc", "s6", 1, 1, "t0", "t1", "x6", "f", 1),
        ("c", "/é", "s7", 1, 1, None, None, None, None, 0), ("c", "/z", "s8", 1, 1, None, None, None, None, 0),
    ]
    labels = spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "source string")
    got = sorted(map(tuple, scan.source_totals(spark.createDataFrame(rows, kind).repartition(4), labels).collect()))
    assert got == [
        ("a", 3, 6, 60, "/9", "s2", "t2", "t3", "x2", "g"), ("b", 3, 3, 3, "/a", "s5", "t0", "t1", "x5", "f"), ("c", 2, 2, 2, "/z", "s8", None, None, None, None),
        ("none", 0, 0, 0, None, None, None, None, None, None),
    ]


def test_repeats_and_sessions(spark):
    rows = spark.createDataFrame([("s", i, m) for i, m in enumerate(["a", "a", None, None, "a", "b"])], "s string, i int, m string")
    assert [r.i for r in sessions.drop_repeats(rows, "s", ["i"], "m").orderBy("i").collect()] == [0, 2, 4, 5]


def test_stream_closes_sessions_like_a_batch(spark, tmp_path):
    for n, texts in enumerate([[("s", "00:00:00", "a"), ("s", "00:01:00", "b <private>x</private>")], [("s", "02:00:00", "c"), ("s", "02:01:00", " "), ("s", "02:02:00", "d")], [("z", "09:00:00", "end")]]):
        (tmp_path / f"{n}.json").write_text("\n".join(json.dumps({"k": k, "ts": f"2024-01-01T{t}", "text": x}) for k, t, x in texts))
        os.utime(tmp_path / f"{n}.json", (1_700_000_000 + n,) * 2)  # the file source takes files in the order of their times
    schema = "k string, ts timestamp, text string"
    stream = sanitise(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path)))
    batches = []
    got = run_to_end(close_sessions(stream, "k", "ts", "5 minutes", "10 minutes"), lambda b, n: batches.append(b.count()))
    batch = close_sessions(sanitise(spark.read.schema(schema).json(str(tmp_path))), "k", "ts", "5 minutes", "10 minutes")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.filter("k = 's'").collect()))
    assert sum(batches) == 2
