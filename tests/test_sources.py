"""Parsers on small files of each writer."""

import json
import sqlite3

from pyspark.sql import functions as F

from tracewell.operators.scan import scan
from tracewell.plans.base import documents
from tracewell.plans.data import joined_pieces
from tracewell.sources import lines, tables, transcripts


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def read(spark, path):
    return lines.read_lines(spark, str(path))


def test_codex(spark, tmp_path):
    write(tmp_path / "a.jsonl", [
        {"type": "session_meta", "payload": {"id": "s1", "cwd": "/work/x", "timestamp": "2024-01-02T03:04:05Z"}}, "not json", "",
        {"type": "event_msg", "payload": {"type": "user_message", "message": " hello   there "}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "hi"}, {"type": "image"}]}},
        {"type": "event_msg", "payload": {"type": "user_message", "message": "You are Codex and so on"}}])
    doc = transcripts.codex(read(spark, tmp_path)).first()
    assert (doc.session_id, doc.title, doc.content, doc.created_at_epoch) == ("s1", "/work/x", "hello there\nhi", 1704164645)


def test_claude(spark, tmp_path):
    write(tmp_path / "b.jsonl", [
        {"sessionId": "c1", "cwd": "/first", "timestamp": "2024-01-02T03:04:05+00:00", "type": "user", "message": {"content": "question"}},
        {"sessionId": "c2", "cwd": "/second", "type": "assistant", "message": {"content": [{"type": "text", "text": "answer"}]}},
        {"type": "user", "message": {"content": [{"type": "text", "text": "a list is no user text"}]}}])
    doc = transcripts.claude(read(spark, tmp_path)).first()
    assert (doc.session_id, doc.title, doc.content) == ("c2", "/first", "question\nanswer")


def test_history_and_shell(spark, tmp_path):
    write(tmp_path / "h/h.jsonl", [{"display": " ", "text": "second"}, {"prompt": "third"}, [1], {"other": 1}])
    doc = transcripts.history(read(spark, tmp_path / "h"), "codex_history").first()
    assert (doc.title, doc.content) == ("h.jsonl", "second\nthird")
    write(tmp_path / "s/z.jsonl", [": 1700000000:0;git status", "ls -la", "", ": 1:0;"])
    assert transcripts.shell(read(spark, tmp_path / "s"), "shell_zsh").first().content == "git status\nls -la"
    write(tmp_path / "e/e.jsonl", ["", "  "])
    assert transcripts.history(read(spark, tmp_path / "e"), "codex_history").count() == 0


def test_generic(spark, tmp_path):
    deep = {"text": "deep"}
    for _ in range(40):
        deep = {"content": [deep]}
    write(tmp_path / "g.jsonl", [{"id": "g1", "title": "T", "message": "m", "content": [{"type": "text", "text": "m"}, {"parts": ["p", "p"]}]}, {"sessionId": "g2", "data": deep}])
    doc = transcripts.generic(read(spark, tmp_path), "kilo_session").first()
    assert (doc.session_id, doc.title, doc.content) == ("g2", "T", "m\nT\np")


def test_content_is_capped_in_order(spark):
    rows = spark.createDataFrame([("a", i, "x" * 10) for i in range(10)] + [("b", 0, None), ("b", 1, " ")], "path string, at int, text string")
    got = {r.path: r.content for r in lines.join_pieces(rows, cap=25).collect()}
    assert got == {"a": "x" * 10 + "\n" + "x" * 10 + "\n" + "x" * 3}


def test_joined_pieces_keep_whole_texts(spark, sf):
    expected = {}
    for r in documents(spark, sf).filter("machine_id is not null").orderBy("created_at_epoch", "file_path").collect():
        if title := " ".join((r.title or "").split()):
            expected.setdefault(r.machine_id, []).append(title)
    rows = joined_pieces(spark, sf).collect()
    assert {(r.machine_id, r.place, r.text) for r in rows} == {(m, i + 1, t) for m, all_ in expected.items() for i, t in enumerate(all_)}
    assert len(rows) == sum(map(len, expected.values()))
    pieces = spark.createDataFrame([("a", i, f"{i:05} x") for i in range(1000)] + [("b", 0, None), ("c", 1, " y \n z ")], "path string, at int, text string")
    got = sorted(map(tuple, lines.ordered_pieces(pieces.repartition(5)).collect()))
    assert got == [("a", i + 1, f"{i:05} x") for i in range(1000)] + [("c", 1, "y z")]


def test_markdown(spark, tmp_path):
    (tmp_path / "conversations").mkdir()
    (tmp_path / "conversations/note_s9.md").write_text("# Title\nTags: a, b,\nDate: 2024-01-02T00:00:00Z\n## Content\nbody <private>no</private>\nend")
    (tmp_path / "empty.md").write_text(" ")
    rows = transcripts.markdown(lines.read_whole(spark, str(tmp_path), "*.md")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.title, r.tags, r.content, r.session_id, r.source_type, r.created_at_epoch) == ("Title", ["a", "b"], "body \nend", "s9", "conversation", 1704153600)


def test_aider_json_and_titles(spark, tmp_path):
    (tmp_path / "c.md").write_text("intro\n#### first question here\nanswer one\n---\nshort\n#### second question here")
    doc = transcripts.aider(lines.read_whole(spark, str(tmp_path), "c.md")).first()
    assert "first question here" in doc.content and "short" not in doc.content
    (tmp_path / "j.json").write_text('// comment\n[{"role": "user", "content": "one"}, {"content": [{"type": "text", "text": "two"}]}]')
    doc = transcripts.json_files(lines.read_whole(spark, str(tmp_path), "j.json"), "cline_session").first()
    assert doc.content.split("\n")[-1] == "two"
    write(tmp_path / "f/f.jsonl", [{"x": 1}, {"sessionTitle": "st"}, {"title": "late"}])
    assert transcripts.first_titles(read(spark, tmp_path / "f")).first().title == "st"


def test_copilot_and_sidecar(spark, tmp_path):
    write(tmp_path / "e.jsonl", [{"type": "session.start", "timestamp": "2024-01-01T00:00:00Z", "data": {"sessionId": "p1", "cwd": "/w"}}, {"type": "user.message", "data": {"content": "q"}},
                                 {"type": "tool.execution_complete", "data": {"result": "r" * 900}}])
    docs = transcripts.copilot(read(spark, tmp_path))
    doc = docs.first()
    assert (doc.session_id, doc.title, len(doc.content)) == ("p1", "/w", 502)
    side = spark.createDataFrame([("p1", "Named")], "session_id string, title string")
    assert transcripts.with_sidecar(docs, side).first().title == "Named"


def test_session_tables_and_sqlite(spark, tmp_path):
    sessions = spark.createDataFrame([("s1", "T", "/d", 1000, 5000), ("s2", None, None, None, None), (None, "x", "y", 1, 1)], "id string, title string, directory string, time_created bigint, time_updated bigint")
    parts = spark.createDataFrame([("s1", "b", '{"text": "two"}', 2), ("s1", "a", '{"text": "one"}', 1), ("s3", "c", '{"text": "lost"}', 1), ("s1", "d", "bad", 3), (None, "e", "{}", 1)], "session_id string, id string, data string, time_created bigint")
    got = {r.session_id: (r.title, r.content, r.created_at_epoch) for r in tables.session_documents(sessions, parts, "kilo_session", full=True).collect()}
    assert got == {"s1": ("T", "one\ntwo", 5), "s2": ("s2", "s2", 1), "s3": ("s3", "lost", 1)}
    db = tmp_path / "state.vscdb"
    with sqlite3.connect(db) as con:
        con.execute("create table ItemTable (key text, value text)")
        con.executemany("insert into ItemTable values (?, ?)", [("aichat.data", "v" * 20), ("other", "w" * 20), ("chat.short", "x")])
    spark.dataSource.register(tables.SqliteTable)
    rows = spark.read.format("sqlite").option("path", str(db)).load()
    assert [r.key for r in tables.chat_values(rows).collect()] == ["aichat.data"]


def test_scan_takes_the_best_match_and_skips_tools(spark):
    data = [
        ("f", 1, json.dumps({"type": "session_meta", "payload": {"id": "S", "timestamp": "t1"}})),
        ("f", 2, json.dumps({"type": "response_item", "payload": {"type": "function_call_output", "text": "needle needle"}})),
        ("f", 3, json.dumps({"text": "a needle"})),
        ("f", 4, json.dumps({"message": {"content": [{"type": "text", "text": "best needle"}]}})),
        ("g", 1, json.dumps({"cwd": "/active", "text": "needle"})), ("h", 1, "needle but no json"),
    ]
    rows = spark.createDataFrame(data, "path string, line_no bigint, line string").withColumn("source", F.lit("x"))
    got = scan(rows, "Needle", active_dir="/active").collect()
    assert [(r.path, r.session_id, r.lines, r.first_timestamp, r.match_field, r.snippet, r.match_score) for r in got] == [("f", "S", 4, "t1", "message.content.text", "best needle", 145)]
    assert scan(rows.limit(0), "needle").count() == 0


def test_messages_under_other_keys(spark, tmp_path):
    """History of one editor, message metadata of another, quoted texts and descriptions."""
    record = {"sessionId": "k1", "title": "T", "workspaceDirectory": "/w", "history": [{"message": {"role": "user", "content": "asked"}}, {"message": {"content": [{"type": "text", "text": "told"}]}}]}
    assert transcripts.read_continue(record) == ("k1", "T", ["T", "/w", "asked", "told"])
    assert transcripts.read_zed({"id": "z", "summary": "S", "message_metadata": {"1": {"text": "one"}, "2": {"body": "two"}}}) == ("z", "S", ["S", "one", "two"])
    assert transcripts.read_zed({"messages": [{"text": "m"}, "no record"]}) == (None, None, ["m"])
    assert list(transcripts.fragments({"textDescription": '"in quotes"', "data": {"description": " d "}})) == ["in quotes", "d"]
    assert transcripts.read_continue([1]) == (None, None, []) and transcripts.read_messages({"a": 1}) == (None, None, [])
    files = spark.createDataFrame([("/t/7/api_conversation_history.json", '[{"role": "user", "content": "do it"}]', 1, 2)], "path string, text string, mtime bigint, size bigint")
    meta = spark.createDataFrame([("/t/7/task_metadata.json", '{"task": " The task "}')], "path string, text string")
    doc = transcripts.json_files(files, "cline_session", transcripts.task_titles(files, meta)).first()
    assert (doc.session_id, doc.title, doc.content) == ("7", "The task", "do it")


def test_messages_stand_in_for_missing_parts(spark):
    schema = "session_id string, id string, data string, time_created bigint"
    parts = spark.createDataFrame([("a", "1", '{"text": "part"}', 1), ("b", "1", "{}", 1)], schema)
    messages = spark.createDataFrame([("a", "9", '{"text": "no"}', 1), ("b", "9", '{"text": "message"}', 1)], schema)
    none = spark.createDataFrame([], "id string, title string, directory string, time_created bigint, time_updated bigint")
    docs = tables.session_documents(none, parts, "x", True, messages, None)
    assert {r.session_id: r.content for r in docs.collect()} == {"a": "part", "b": "message"}


def test_whole_texts_without_a_cap(spark):
    rows = spark.createDataFrame([("p", i, "w" * 9_999) for i in range(9)], "path string, at int, text string")
    assert lines.join_pieces(rows, cap=None).first().content == "\n".join(["w" * 9_999] * 9)
    assert len(lines.join_pieces(rows).first().content) == 24_000
