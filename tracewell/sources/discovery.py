"""Where tools keep their transcripts under a home folder, the listing of what is there, and its synchronisation into a table of documents."""

from __future__ import annotations

import os
from collections.abc import Iterator
from glob import iglob

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.memory import changes
from tracewell.sources import transcripts
from tracewell.sources.lines import file_name, parent, stem

# Source type and glob patterns under the home folder.
JSONL = {
    "codex_session": [".codex/sessions/**/*.jsonl", ".codex/archived_sessions/**/*.jsonl"],
    "claude_session": [".claude/projects/**/*.jsonl", ".claude/transcripts/**/*.jsonl"],
    "openclaw_session": [".openclaw/agents/**/sessions/*.jsonl"],
    "factory_session": [".factory/sessions/**/*.jsonl"],
    "hermes_session": [".hermes/sessions/**/*.jsonl"],
    "copilot_session": [".copilot/session-state/**/*.jsonl"],
    "accio_session": [".accio/**/*.messages.jsonl"],
    "codex_history": [".codex/history.jsonl"],
    "claude_history": [".claude/history.jsonl"],
    "opencode_history": [".local/state/opencode/prompt-history.jsonl", ".config/opencode/prompt-history.jsonl", ".opencode/prompt-history.jsonl"],
    "kilo_history": [".local/state/kilo/prompt-history.jsonl", ".config/kilo/prompt-history.jsonl"],
}
PLAIN = {"shell_zsh": [".zsh_history"], "shell_bash": [".bash_history"]}
WHOLE = {
    "cline_session": ["**/saoudrizwan.claude-dev/tasks/*/api_conversation_history.json"],
    "roo_session": ["**/rooveterinaryinc.roo-cline/tasks/*/api_conversation_history.json"],
    "continue_session": [".continue/sessions/*.json"],
    "zed_session": [".config/zed/conversations/*.json", ".local/share/zed/conversations/*.json"],
}
NOTES = {"aider_session": ["**/.aider.chat.history.md"]}
#: Files beside a task's messages that name it.
TASKS = {"cline_session": "task_metadata.json", "roo_session": "task_metadata.json"}
EVERY = JSONL | PLAIN | WHOLE | NOTES


def discover(spark: SparkSession, home: str) -> DataFrame:
    """(source_type, path, mtime, size) of all transcripts under a local home folder, each once. Archives elsewhere are read with sources.lines directly."""
    found = {}
    for source, patterns in EVERY.items():
        for pattern in patterns:
            for path in iglob(os.path.join(home, pattern), recursive=True, include_hidden=True):
                if os.path.isfile(path) and not os.path.islink(path):
                    stat = os.stat(path)
                    found[source, path] = (source, path, int(stat.st_mtime), stat.st_size)
    return spark.createDataFrame(sorted(found.values()), "source_type string, path string, mtime bigint, size bigint")


def inventory(files: DataFrame) -> DataFrame:
    """Files, bytes and last change of each known source, zeros for those not met."""
    labels = files.sparkSession.createDataFrame([(s,) for s in sorted(EVERY)], "source_type string")
    totals = files.groupBy("source_type").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("mtime").alias("newest"))
    return labels.join(totals, "source_type", "left").fillna({"files": 0, "bytes": 0})


def read_files(files: DataFrame, whole: bool = False) -> DataFrame:
    """Lines (path, at, line, mtime, size) or whole texts (path, text, mtime, size) of listed local files; undecodable bytes are dropped. A file that an executor cannot open is an error: on a cluster the folder must be shared."""
    kind = "path string, text string, mtime bigint, size bigint" if whole else "path string, at struct<block:bigint,row:bigint>, line string, mtime bigint, size bigint"
    at = pa.struct([("block", pa.int64()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, mtime, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(path, "rb") as f:
                    text = f.read().decode("utf-8", "ignore")
                if whole:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text]), pa.array([mtime], pa.int64()), pa.array([size], pa.int64())], names=["path", "text", "mtime", "size"])
                    continue
                lines = text.splitlines()
                n = len(lines)
                columns = [pa.array([path] * n, pa.string()), pa.array([{"block": 0, "row": i} for i in range(n)], at), pa.array(lines, pa.string()), pa.array([mtime] * n, pa.int64()), pa.array([size] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "at", "line", "mtime", "size"])

    return files.select("path", "mtime", "size").mapInArrow(run, kind)


def _beside(files: DataFrame, names: list[str]) -> DataFrame:
    """Those files beside the listed ones that are there: names with the stem of a listed file in place of {}."""
    name = stem(F.col("path"))
    paths = F.array(*[F.concat_ws("/", parent(F.col("path")), F.format_string(n.replace("{}", "%s"), *([name] if "{}" in n else []))) for n in names])
    there = F.udf(lambda p: os.path.isfile(p), "boolean")
    return files.select(F.explode(paths).alias("path")).distinct().filter(there("path")).select("path", F.lit(0).cast("bigint").alias("mtime"), F.lit(0).cast("bigint").alias("size"))


def parse_files(files: DataFrame) -> DataFrame:
    """Documents of listed files of all sources, as one union of the parsers of those that occur."""
    parts = []
    there = {r[0] for r in files.select("source_type").distinct().collect()}
    for source in [s for s in EVERY if s in there] or ["codex_history"]:
        own = files.filter(F.col("source_type") == source)
        if source in TASKS:
            texts = read_files(own, whole=True)
            parts.append(transcripts.json_files(texts, source, transcripts.task_titles(texts, read_files(_beside(own, [TASKS[source]]), whole=True))))
        elif source in WHOLE:
            parts.append(transcripts.json_files(read_files(own, whole=True), source))
        elif source == "hermes_session":
            rows = read_files(own)
            parts.append(transcripts.generic(rows, source, transcripts.sidecar_titles(rows, read_files(_beside(own, ["session_{}.json", "{}.json"]), whole=True))))
        elif source in NOTES:
            parts.append(transcripts.aider(read_files(own, whole=True)))
        else:
            parts.append(transcripts.parse(read_files(own), source))
    docs = parts[0]
    for p in parts[1:]:
        docs = docs.unionByName(p)
    return docs


def sync(files: DataFrame, stored: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """The table of documents after a synchronisation, and how many files were added, updated, unchanged and removed.

    Only files whose time or size changed are parsed; rows of vanished files go. stored has the columns of documents and
    updated_at_epoch.
    """
    listed = files.select(F.col("path").alias("file_path"), F.col("mtime").alias("file_mtime"), F.col("size").alias("file_size"))
    change = changes(listed, stored, "file_path", ["file_mtime", "file_size"])
    wanted = files.join(change.filter(F.col("change").isin("added", "updated")).select(F.col("file_path").alias("path")), "path", "left_semi")
    fresh = parse_files(wanted).withColumn("updated_at_epoch", F.lit(now))
    kept = stored.join(change.filter(F.col("change") == "unchanged").select("file_path"), "file_path", "left_semi")
    return kept.unionByName(fresh.select(*stored.columns)), change.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def shown(results: DataFrame, most: int = 10) -> str:
    """A few result rows as text for people: number, date, session, source, title and snippet."""
    rows = results.limit(most).select("created_at", "session_id", "source_type", F.coalesce("title", file_name(F.col("file_path"))).alias("title"), "snippet").collect()
    return "\n".join(f"[{i}] {(r.created_at or '')[:10]} | {r.session_id} | {r.source_type}\n    {r.title}\n    > {r.snippet}" for i, r in enumerate(rows, 1))
