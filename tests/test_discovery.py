"""Discovery and synchronisation of a home folder."""

import json
import os

from pyspark.sql import functions as F

from tracewell.sources import discovery


def test_sync_of_a_home(spark, tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        return str(path)

    codex = write(".codex/sessions/2024/a.jsonl", json.dumps({"type": "event_msg", "payload": {"type": "user_message", "message": "hello codex"}}))
    write(".claude/projects/p/b.jsonl", json.dumps({"type": "user", "message": {"content": "hello claude"}, "cwd": "/w"}))
    shell = write(".zsh_history", ": 1700000000:0;make test\nls")
    write(".codex/history.jsonl", json.dumps({"text": "a prompt"}))
    write("code/.aider.chat.history.md", "#### a longer question for aider")
    write(".continue/sessions/c.json", json.dumps({"title": "T", "history": [], "messages": [{"content": "from continue"}]}))
    write("other/ignored.jsonl", "{}")
    files = discovery.discover(spark, str(tmp_path))
    assert {r.source_type: r.files for r in discovery.inventory(files).collect() if r.files} == {s: 1 for s in ("codex_session", "claude_session", "shell_zsh", "codex_history", "aider_session", "continue_session")}
    empty = discovery.parse_files(files.limit(0)).withColumn("updated_at_epoch", F.lit(0))
    first, counts = discovery.sync(files, empty, 1)
    first.write.parquet(str(tmp_path / "table1"))
    assert {r.change: r.n for r in counts.collect()} == {"added": 6}
    stored = spark.read.parquet(str(tmp_path / "table1"))
    assert {r.source_type: r.content for r in stored.collect()} | {} == {
        "codex_session": "hello codex", "claude_session": "hello claude", "shell_zsh": "make test\nls", "codex_history": "a prompt", "aider_session": "a longer question for aider", "continue_session": "T\nfrom continue"}
    write(".zsh_history", "changed command")
    os.utime(shell, (1, 1))
    os.unlink(codex)
    second, counts = discovery.sync(discovery.discover(spark, str(tmp_path)), stored, 2)
    assert {r.change: r.n for r in counts.collect()} == {"removed": 1, "updated": 1, "unchanged": 4}
    rows = {r.source_type: (r.content, r.updated_at_epoch) for r in second.collect()}
    assert len(rows) == 5 and rows["shell_zsh"] == ("changed command", 2) and rows["codex_history"] == ("a prompt", 1)
    assert "a prompt" in discovery.shown(stored.withColumn("snippet", F.col("content")))
