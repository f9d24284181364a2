"""Conversations from a stream against a plain reconstruction."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tracewell.llm.conversations import PARTS, collect_spans, read_message, read_object, rebuild, validated
from tracewell.llm.queries_sessions import p5_found

T0 = 1_700_000_000_000


def text(role, t="x"):
    return json.dumps({"type": "text", "role": role, "text": t})


@pytest.mark.parametrize(
    ("data", "expected"),
    [
        ({"type": "text", "role": "Human", "text": "a"}, ("user", "a")),
        ({"type": "assistant_message", "message": "b"}, ("assistant", "b")),
        ({"type": "model", "message": {"role": "model", "content": "c"}}, ("assistant", "c")),
        ({"text": "d", "time": {"start": 1}, "role": "System"}, ("system", "d")),
        ({"type": "message", "role": "user", "content": [{"type": "input_text", "text": "e"}, {"type": "image"}]}, ("user", "e")),
        ({"type": "event_msg", "payload": {"type": "user_message", "message": "f"}}, ("user", "f")),
        ({"type": "reasoning", "role": "assistant", "text": "g"}, None),
        ({"type": "text", "role": "tool", "text": "h"}, None),
        ({"type": "patch", "role": None, "files": []}, None),
        ({"role": "user", "content": [{"type": "text", "text": "  \n"}]}, None),
        ({"type": "step-start"}, None),
    ],
)
def test_shapes(data, expected):
    assert read_message(data) == expected


def test_wrapped_once_and_unreadable():
    assert read_object(json.dumps(json.dumps({"a": 1}))) == {"a": 1}
    assert all(read_object(x) is None for x in (None, "", "[1]", "7", "{", json.dumps(json.dumps(json.dumps({"a": 1})))))


def plain(rows):
    sessions = {}
    for s, i, d, t in {r for r in rows if r[0] is not None}:
        sessions.setdefault(s, []).append((i, d, t))
    out = []
    for s, parts in sessions.items():
        if any(read_object(d) is None or t is None for _, d, t in parts):
            continue
        said = []
        for i, d, t in parts:
            if m := read_message(read_object(d)):
                said.append((t * 10**6 if t < 10**11 else t * 1000 if t < 10**14 else t, i, m[0]))
        said.sort()
        roles = [r for *_, r in said if r != "system"]
        if roles and roles[0] == "user" and roles[-1] != "user" and not any(a == b == "user" for a, b in zip(roles, roles[1:], strict=False)):
            out += [(s, n + 1, i, r) for n, (_, i, r) in enumerate(said)]
    return sorted(out)


def test_cases(spark, tmp_path):
    rows = [
        ("ok", "2", text("assistant"), T0 + 2000), ("ok", "1", text("user"), (T0 + 1000) // 1000), ("ok", "0", text("system"), T0 * 1000), ("ok", "1", text("user"), (T0 + 1000) // 1000),
        ("long", "a", text("user"), T0), ("long", "b", text("assistant"), T0 + 86_400_000), ("long", "c", text("user"), T0 + 90_000_000), ("long", "d", text("assistant"), T0 + 180_000_000),
        ("split", "a", text("user"), T0), ("split", "b", text("user"), T0 + 86_400_000), ("split", "c", text("ai"), T0 + 86_500_000),
        ("broken", "a", text("user"), T0), ("broken", "b", "{oops", T0 + 1), ("broken", "c", text("ai"), T0 + 2),
        ("untimed", "a", text("user"), T0), ("untimed", "b", text("ai"), None), ("unanswered", "a", text("user"), T0), ("silent", "a", text("system"), T0),
        ("backward", "a", text("ai"), T0), ("tie", "b", text("ai"), T0), ("tie", "a", text("user"), T0), ("far", "a", text("user"), 90_000_000_000_000), ("far", "b", text("ai"), 90_000_000_000_000_000), (None, "a", text("user"), T0), ("tools", "a", json.dumps({"type": "tool"}), T0),
    ]
    spark.createDataFrame(rows, PARTS).repartition(3).write.parquet(str(tmp_path / "p.parquet"))
    got = rebuild(spark, str(tmp_path / "p.parquet"))
    assert sorted((r.session_id, r.seq, r.part_id, r.role) for r in got.collect()) == plain(rows)
    assert {r.session_id for r in got.collect()} == {"ok", "long", "tie", "far"}


def test_late_rows_open_their_span_again(spark, tmp_path):
    """One file a batch, in an order in which rows come years late: the same conversations as in one batch, and late rows are counted."""
    day = 86_400_000
    batches = [
        [("a", "1", text("user"), T0), ("b", "1", text("user"), T0 + 900 * day), ("b", "2", text("ai"), T0 + 901 * day)],
        [("c", "1", text("user"), T0 + 902 * day)],  # a's span closes
        [("a", "2", text("ai"), T0 + 1000), ("a", "2", text("ai"), T0 + 1000), ("a", "0", text("system"), T0 - 5), ("c", "2", text("ai"), T0 + 1), ("d", "1", text("user"), T0 + 990 * day)],
        [("a", "2", text("ai"), T0 + 1000)],  # and stays closed
        [("b", "0", "{", None), ("d", "2", text("ai"), T0 + 991 * day), ("e", "1", text("user"), T0), ("e", "2", text("ai"), T0 + 1)],
    ]
    for n, rows in enumerate(batches):
        path = tmp_path / "p.parquet" / f"{n}.parquet"
        path.parent.mkdir(exist_ok=True)
        kind = pa.schema([("session_id", pa.string()), ("id", pa.string()), ("data", pa.string()), ("time_created", pa.int64())])
        pq.write_table(pa.table(list(zip(*rows, strict=True)), schema=kind), path)
        os.utime(path, (1_700_000_000 + n,) * 2)
    source = str(tmp_path / "p.parquet")
    got = [tuple(r) for r in rebuild(spark, source, with_text=False, batch_files=1).select("session_id", "seq", "part_id", "role").collect()]
    assert sorted(got) == plain([r for b in batches for r in b])
    assert sorted(got) == sorted(tuple(r) for r in rebuild(spark, source, with_text=False).select("session_id", "seq", "part_id", "role").collect())
    spans = collect_spans(spark, source, with_text=False, batch_files=1)
    late = {r.session_id: (r.kept, r.late) for r in validated(spark, spans, batch_files=1).collect()}
    assert late == {"a": (True, 2), "b": (False, 0), "c": (False, 0), "d": (True, 0), "e": (True, 0)}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], PARTS).write.parquet(str(tmp_path / "p.parquet"))
    assert rebuild(spark, str(tmp_path / "p.parquet")).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/oc_part.parquet").select("session_id", "id", "data", "time_created").collect()]
    assert sorted(map(tuple, p5_found(spark, sf).collect())) == plain(rows)
