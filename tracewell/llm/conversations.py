"""Conversations rebuilt from message rows by two streams of keyed state.

The first buffers the messages of each session by spans of event time, however late they arrive, and emits the ordered
span when the watermark has passed it; a row that comes later opens it again, and a new revision follows. The second
keeps a summary of each session's spans and emits the session anew, validated, when one of its spans closes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.session import new_path

# Names of speakers and of rows that carry messages.
SPEAKERS = {
    "user": "user", "human": "user",
    "assistant": "assistant", "ai": "assistant", "model": "assistant", "bot": "assistant", "agent": "assistant",
    "system": "system", "developer": "system",
}
PLAIN_TYPES = {"", "text", "message", "chat", "msg"}
TEXT_BLOCKS = {"", "text", "input_text", "output_text"}
WRAPPERS = {"event_msg", "response_item"}
SPEAKER_KEYS = ("role", "speaker", "author", "sender", "from")

#: Microseconds of event time that a span holds: a session of any size is as many keys as it has spans. How long a span waits for late rows before it closes.
SPAN, DELAY = 6 * 3600 * 1_000_000, "1 hour"
#: Bytes of input for which there is one bucket of sessions.
BUCKET_BYTES = 64 << 20
#: The most that one batch reads.
BATCH_BYTES = 32 << 30
#: Where rows go that break their session.
BROKEN = -(2**62)


def read_object(data: str | None) -> dict | None:
    """A JSON object, which may be wrapped once more as a JSON string; None for anything else."""
    for _ in range(2):
        try:
            data = json.loads(data)
        except (TypeError, ValueError, RecursionError):
            return None
        if isinstance(data, dict):
            return data
        if not isinstance(data, str):
            return None
    return None


def _text(value: object) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(t for t in map(_text, value) if t)
    if isinstance(value, dict) and str(value.get("type") or "") in TEXT_BLOCKS:
        for key in ("text", "content", "parts"):
            if t := _text(value.get(key)):
                return t
    return ""


def read_message(row: dict) -> tuple[str, str] | None:
    """Speaker and text of a message row; None for rows of tools, reasoning, steps and the like, and for blank ones."""
    kind = str(row.get("type") or "").lower()
    if kind in WRAPPERS and isinstance(row.get("payload"), dict):
        return read_message(row["payload"])
    inner = row.get("message")
    named = kind.removesuffix("_message")
    if kind not in PLAIN_TYPES and named not in SPEAKERS:
        return None
    role = None
    for source in (inner, row) if isinstance(inner, dict) else (row,):
        for key in SPEAKER_KEYS:
            value = source.get(key)
            if isinstance(value, dict):
                value = value.get("role")
            if isinstance(value, str):
                role = value
                break
        if role is not None:
            break
    role = SPEAKERS.get((role if role is not None else named).strip().lower())
    if role is None:
        return None
    for source in (inner.get("content"), inner.get("text")) if isinstance(inner, dict) else (inner,):
        if (t := _text(source)).strip():
            return role, t
    for key in ("text", "content", "parts"):
        if (t := _text(row.get(key))).strip():
            return role, t
    return None


def _micros(time: int) -> int:
    """Microseconds of a time in seconds, milliseconds, microseconds or nanoseconds since 1970, by its size."""
    size = abs(time)
    return time * 1_000_000 if size < 10**11 else time * 1000 if size < 10**14 else time if size < 10**17 else time // 1000


PARTS = "session_id string, id string, data string, time_created bigint"
_PACKED = "session_id string, span bigint, ts timestamp, pack string"
_PACKED_KINDS = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string()]
#: The last microsecond of a time that Spark's streams can hold: a row of it closes whatever is open.
_END = 99_999_999_999_999_999


def read_parts(df: DataFrame, span: int = SPAN, with_text: bool = True) -> DataFrame:
    """The rows (session_id, id, data, time_created) that matter, those of a session and span that a batch holds as one: (session_id, span, ts, pack).

    pack is a JSON list of messages [microseconds, part id, role, text] (without text: a hash of it), ts the time of the
    last. A broken row goes to the span BROKEN of its session. Rows that are neither messages nor broken are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packs: dict[tuple, list[list]] = {}
            for session, part, data, time in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = read_object(data)
                if row is None or time is None:
                    packs[session, BROKEN] = []
                elif message := read_message(row):
                    us, (role, text) = _micros(time), message
                    text = text.encode("utf-8", "replace")
                    packs.setdefault((session, us // span), []).append([us, part, role, text.decode() if with_text else hashlib.blake2b(text, digest_size=8).hexdigest()])
            rows = [(s, n, max((m[0] for m in p), default=None), json.dumps(p, ensure_ascii=False)) for (s, n), p in packs.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _PACKED_KINDS, strict=True)], names=["session_id", "span", "ts", "pack"])

    return df.select("session_id", "id", "data", "time_created").mapInArrow(run, _PACKED)


_SPANS = "session_id string, span bigint, revision int, late int, pack string"
_STATE = "sessions string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _buffer(span: int, delay_ms: int):
    """The messages of a bucket of sessions and a span in state: merged as they come, emitted in order on the span's timeout, and kept for rows that come later still.

    State is a JSON object: of each session [next revision, late rows, whether it is open, messages].
    """

    def emitted(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["session_id", "span", "revision", "late", "pack"])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number = int(key[1])
        if number == BROKEN:  # nothing to wait for
            yield emitted([(s, number, 0, 0, None) for s in {s for f in frames for s in f["session_id"]}])
            return
        sessions = json.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            closing = [(s, number, x[0], x[1], json.dumps(x[3], ensure_ascii=False)) for s, x in sessions.items() if x[2]]
            sessions = {s: [x[0] + x[2], x[1], 0, x[3]] for s, x in sessions.items()}
            state.update((json.dumps(sessions, ensure_ascii=False),))
            yield emitted(closing)
            return
        for frame in frames:
            for session, pack in zip(frame["session_id"], frame["pack"], strict=True):
                x = sessions.setdefault(session or "", [0, 0, 1, []])
                known = set(map(tuple, x[3]))
                new = set(map(tuple, json.loads(pack))) - known
                if new:  # else nothing but repeated rows
                    x[1] += 0 if x[2] else len(new)
                    x[2], x[3] = 1, sorted(known | new, key=lambda m: (m[0], m[1] or "", *m[2:]))
        state.update((json.dumps(sessions, ensure_ascii=False),))
        if any(x[2] for x in sessions.values()):
            state.setTimeoutTimestamp(max((number + 1) * span // 1000 + delay_ms, state.getCurrentWatermarkMs() + 1))

    return run


def _live(spark: SparkSession, source: str) -> SparkSession:
    """A session of its own for a stream's settings: state in RocksDB, in as many partitions as shuffles have, or as there are splits of the input."""
    live = spark.newSession()
    live.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    splits = spark.read.schema(PARTS).parquet(source).rdd.getNumPartitions()
    live.conf.set("spark.sql.shuffle.partitions", max(int(spark.conf.get("spark.sql.shuffle.partitions")), splits))
    return live


def _messages(spans: DataFrame) -> DataFrame:
    """(session_id, span, revision, late, messages) of written spans; messages are null for broken rows."""
    messages = F.transform(F.from_json("pack", "array<array<string>>"), lambda m: F.struct(m[0].cast("bigint").alias("us"), m[1].alias("id"), m[2].alias("role"), m[3].alias("text")))
    return spans.filter("session_id is not null").select("session_id", "span", "revision", "late", messages.alias("messages"))


def collect_spans(
    spark: SparkSession, source: str, with_text: bool = True, span: int = SPAN, delay: str = DELAY, batch_bytes: int = BATCH_BYTES, batch_files: int | None = None, buckets: int | None = None
) -> str:
    """Runs the first stream over the Parquet files of `source`, in batches of bounded size, until they are used up. Gives the folder of what it wrote: of each session and span its closed revisions.

    The watermark, `delay` behind the latest time seen, closes spans. No row is dropped for being late: its span, closed
    or not, takes it, and closes anew with the next revision, which counts such rows as `late`. State is keyed by
    span and bucket of sessions (by default one for BUCKET_BYTES of input), so that a key is neither tiny nor large and a
    session of any size is many keys; it lives as long as the stream, without texts unless they are wanted. At the end of the input a row of the last possible time
    closes what is open.
    """
    live, end, out, state = _live(spark, source), new_path(spark, "stream-end"), new_path(spark, "spans"), new_path(spark, "stream")
    delay_ms = int(spark.sql(f"select unix_millis(timestamp_micros(0) + interval '{delay}') ms").first()[0])
    files = source.rstrip("/")
    files = f"{files[:-1]}[{files[-1]}]"  # as a glob pattern it may name a single file as well as a folder
    if buckets is None:
        size = spark.read.format("binaryFile").load(source).agg(F.sum("length")).first()[0] or 0
        buckets = 1 + size // BUCKET_BYTES
    limit = {"maxFilesPerTrigger": batch_files} if batch_files else {"maxBytesPerTrigger": batch_bytes}

    def run() -> None:
        rows = live.readStream.schema(PARTS).options(**limit).parquet(files).filter("session_id is not null")
        rows = rows.unionByName(live.readStream.schema(PARTS).parquet(end))
        # behind the watermark each row has a time that is never late, as rows that are would be dropped before they reach the state
        on_time = F.lit(2**62).alias("ts", metadata={"spark.watermarkDelayMs": delay_ms})
        packs = read_parts(rows, span, with_text).withWatermark("ts", delay).select(F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket"), "span", "session_id", "pack", on_time)
        spans = packs.groupBy("bucket", "span").applyInPandasWithState(_buffer(span, delay_ms), _SPANS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
        stream = spans.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        stream.awaitTermination()

    spark.createDataFrame([], PARTS).write.parquet(end)
    live.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # what the last batch closes, the batch of the end emits
    run()
    live.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    spark.createDataFrame([(None, "end", '{"role": "user", "text": "end"}', _END)], PARTS).write.mode("append").parquet(end)
    run()  # goes on where it stopped
    return out


def summary(spans: DataFrame) -> DataFrame:
    """(session_id, s) of spans: how many messages, the first and last speaker other than the system, whether a user follows a user or a row is broken."""
    roles = F.filter(F.col("messages.role"), lambda r: r != "system")
    pairs = F.zip_with(F.slice(roles, 1, F.greatest(F.size(roles) - 1, F.lit(0))), F.slice(roles, 2, F.greatest(F.size(roles), F.lit(1))), lambda a, b: (a == "user") & (b == "user"))
    parts = F.struct(
        "span",
        (-F.col("revision")).alias("revision"),
        F.when(F.col("messages").isNull(), 0).otherwise(F.size("messages")).cast("bigint").alias("n"),
        F.get(roles, F.lit(0)).alias("first"),
        F.get(roles, F.size(roles) - 1).alias("last"),
        (F.col("messages").isNull() | F.coalesce(F.exists(pairs, lambda x: x), F.lit(False))).alias("bad"),
        "late",
    )
    return spans.select("session_id", parts.alias("s"))


def validate(summaries: DataFrame) -> DataFrame:
    """Each session as it stands: session_id, kept, places (span, revision and how many messages come before), late. The same plan runs over a stream and a table.

    A session is not kept if a row of it is broken, and if, system messages left aside, it has no message, does not begin
    with the user, or has a user message that is last or directly followed by another.
    """
    place = "struct<span:bigint,revision:int,before:bigint>"
    start = F.struct(
        F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("begins"), F.lit(None).cast("string").alias("said"), F.lit(False).alias("bad"), F.lit(0).cast("bigint").alias("late"),
        F.lit(None).cast("bigint").alias("span"), F.array().cast(f"array<{place}>").alias("places"),
    )

    def step(acc: Column, s: Column) -> Column:
        new = F.struct(
            (acc["n"] + s["n"]).alias("n"), F.coalesce(acc["begins"], s["first"]).alias("begins"), F.coalesce(s["last"], acc["said"]).alias("said"),
            (acc["bad"] | s["bad"] | F.coalesce((acc["said"] == "user") & (s["first"] == "user"), F.lit(False))).alias("bad"), (acc["late"] + s["late"]).alias("late"),
            s["span"].alias("span"), F.array_append(acc["places"], F.struct(s["span"].alias("span"), (-s["revision"]).alias("revision"), acc["n"].alias("before"))).alias("places"),
        )
        # of a span's revisions, the latest of which comes first, one counts
        return F.when(s["span"].eqNullSafe(acc["span"]), acc).otherwise(new)

    folded = summaries.groupBy("session_id").agg(F.array_sort(F.collect_set("s")).alias("s")).select("session_id", F.aggregate("s", start, step).alias("c"))
    kept = ~F.col("c.bad") & F.coalesce((F.col("c.begins") == "user") & (F.col("c.said") != "user"), F.lit(False))
    return folded.select("session_id", kept.alias("kept"), F.when(kept, F.col("c.places")).alias("places"), "c.late")


def validated(spark: SparkSession, spans: str, batch_files: int = 10_000) -> DataFrame:
    """Runs the second stream over what the first has written to `spans`: each session as it stands after the last of its spans that closed (see validate()).

    Each batch emits the sessions of which a span closed; an open conversation is emitted again when more of it has closed.
    """
    live, out = _live(spark, spans), new_path(spark, "conversations")
    rows = _messages(live.readStream.schema(_SPANS).option("maxFilesPerTrigger", batch_files).parquet(spans))

    def emit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is repeated replaces itself

    found = validate(summary(rows))
    stream = found.writeStream.outputMode("update").option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).foreachBatch(emit).start()
    stream.awaitTermination()
    every = spark.read.schema(f"{_ddl(found)}, batch bigint").option("basePath", out).parquet(f"{out}/batch=*")
    return every.groupBy("session_id").agg(F.max_by(F.struct("kept", "places", "late"), "batch").alias("c")).select("session_id", "c.*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def rebuild(
    spark: SparkSession, source: str, with_text: bool = True, span: int = SPAN, delay: str = DELAY, batch_bytes: int = BATCH_BYTES, batch_files: int | None = None
) -> DataFrame:
    """Ordered messages of all valid conversations: session_id, seq (from 1), part_id, us, role and, if wanted, text.

    source holds Parquet files with session_id, id, data (JSON) and time_created. Rows without a session_id belong to no
    conversation; rows with unreadable data or without a time break theirs; repeated rows count once; messages of one
    instant go by id. An empty source gives no rows, and other columns in it are not read. The result is the same
    whatever batches the input comes in (batch_bytes or batch_files a batch), and in whatever order.
    """
    spans = collect_spans(spark, source, with_text, span, delay, batch_bytes, batch_files)
    places = validated(spark, spans).filter("kept").select("session_id", F.inline("places"))
    found = _messages(spark.read.schema(_SPANS).parquet(spans)).drop("late").join(places, ["session_id", "span", "revision"])
    found = found.select("session_id", "before", F.posexplode("messages").alias("i", "m"))
    rest = ["us", "role", *(["text"] if with_text else [])]
    return found.select("session_id", (F.col("before") + F.col("i") + 1).cast("bigint").alias("seq"), F.col("m.id").alias("part_id"), *[F.col(f"m.{c}").alias(c) for c in rest])
