"""Queries of data processing: synchronisation, import, export, text cleaning, totals, sessions, documents out of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import compact_snippet, fingerprint, is_noise, normal_tags, path_only, redact_secrets, safe_name, strip_private
from tracewell.functions.vocabulary import SCAN_NOISE, SCAN_NOISE_PREFIXES, SECRET_MARKS, SECRETS
from tracewell.operators import memory, scan, sessions
from tracewell.plans.base import DOCS, OBS, documents, observations
from tracewell.sources.lines import ordered_pieces
from tracewell.sources.exports import memory_note, session_notes
from tracewell.sources.tables import part_texts, session_documents
from tracewell.streaming.live import close_sessions, run_to_end, stable_documents
from tracewell.tables import table

HALF = 1_720_000_000


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before a time, with those after it merged in by path."""
    rows = table(spark, sf_dir, "session_documents")
    merged = memory.upsert(rows.filter(F.col("updated_at_epoch") < HALF), rows.filter(F.col("updated_at_epoch") >= HALF), "file_path", "updated_at_epoch")
    return merged.select("file_path", "updated_at_epoch", F.md5(F.coalesce("content", F.lit(""))).alias("content_md5"))


def sync_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a scan's listing adds, changes and drops."""
    listed = table(spark, sf_dir, "session_summary").groupBy("path").agg(F.max("size_bytes").alias("size")).withColumnRenamed("path", "file_path")
    indexed = documents(spark, sf_dir, F.col("file_size").alias("size"))
    return memory.changes(listed, indexed, "file_path", ["size"])


def memory_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync does with stored observations, were the session documents its files."""
    stored = observations(spark, sf_dir, "file_path", "fingerprint", "source_type", "updated_at_epoch")
    files = documents(spark, sf_dir, "file_size").select("file_path", F.sha2(F.concat_ws("|", "file_path", F.col("file_size").cast("string")), 256).alias("fingerprint"))
    return memory.reconcile(stored, files).select("action", "file_path", "id")


def import_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of type import that are not yet stored, cleaned."""
    rows = observations(spark, sf_dir)
    found = memory.importable(rows.filter("source_type = 'import'"), rows.filter("source_type <> 'import'"))
    return found.select("fingerprint", "file_path", F.array_join("tags", ",").alias("tags"), F.md5("content").alias("content_md5"))


def export_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.export_rows(observations(spark, sf_dir, "created_at_epoch"), 500).select("id", "created_at_epoch")


def embed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose vector is missing or older than half of the id range."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7).alias("changed"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 5).alias("indexed"))
    return memory.to_embed(docs, vectors, "doc_id", "changed", "indexed")


def vector_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return memory.orphans(vectors, table(spark, sf_dir, "documents"), "doc_id")


def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "source_type", "created_at_epoch", "file_size", F.col("content").isNull().alias("bare"))
    return docs.groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.max("created_at_epoch").alias("newest"), F.sum("file_size").alias("bytes"), F.count_if("bare").alias("without_content"))


def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan summaries by source, with zeros for sources of the index that a scan did not meet."""
    rows = table(spark, sf_dir, "session_summary").distinct()
    labels = documents(spark, sf_dir, F.col("source_type").alias("source")).select("source").union(spark.sql("select 'copilot_session'"))
    return scan.source_totals(rows, labels)


def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best matches of a scan."""
    rows = table(spark, sf_dir, "session_summary").distinct().filter("snippet is not null")
    best = rows.orderBy(F.desc("match_score"), F.desc_nulls_last("last_timestamp"), F.desc_nulls_last("first_timestamp"), "path").limit(50)
    return best.select("path", "match_score", "match_field")


def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw scan over message rows, a session as a file: its best text with a word."""
    parts = table(spark, sf_dir, "oc_part").filter("session_id is not null and data is not null and id is not null").distinct()
    lines = parts.select(F.col("session_id").alias("path"), F.lit("opencode_session").alias("source"), F.coalesce("time_created", F.lit(0)).alias("line_no"), F.col("data").alias("line"))
    return scan.scan(lines, "scanner").select("path", "lines", "match_field", "match_score")


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without private blocks and secrets."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(redact_secrets(strip_private(F.col("text")))).alias("text_md5"))


def noise_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, is_noise(F.col("content")).alias("noise"), path_only(F.col("title"), F.col("content")).alias("path_only"))


def short_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir, compact_snippet(F.col("content")).alias("snippet")).filter("snippet is not null")


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = observations(spark, sf_dir, "tags_json").select(F.explode(normal_tags(F.col("tags_json"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, safe_name(F.col("title")).alias("name"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir, fingerprint(F.col("source_type"), F.col("title"), F.col("content"), F.col("created_at_epoch")).alias("own"))


def _tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir, "session_id", F.array_sort(normal_tags(F.col("tags_json"))).alias("tags")).filter("session_id is not null")
    return rows.groupBy("session_id", "tags").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


def tag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common share of the distinct tag sets of a session's observations, each named by its lowest id; tag_sets() gives the members.

    Sets without a common tag share nothing and have no row: sets meet at their tags, not all with all.
    """
    sets = _tag_sets(spark, sf_dir).select("session_id", "id", "tags")
    tags = sets.select("session_id", "id", F.size("tags").alias("n"), F.explode("tags").alias("tag"))
    other = tags.select("session_id", F.col("id").alias("other"), F.col("n").alias("m"), "tag")
    met = tags.join(other, ["session_id", "tag"]).filter("id < other").groupBy("id", "other").agg(F.count(F.lit(1)).alias("c"), F.any_value("n").alias("n"), F.any_value("m").alias("m"))
    return met.select("id", "other", F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 9).alias("overlap"))


def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct tag sets of each session: their lowest id and how many observations have them."""
    return _tag_sets(spark, sf_dir).select("session_id", "id", F.array_join("tags", ",").alias("tags"), "n")


def chat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each chat session known to sessions or parts."""
    docs = session_documents(table(spark, sf_dir, "oc_session"), table(spark, sf_dir, "oc_part").distinct(), "opencode_session", full=True)
    return docs.select("session_id", "created_at_epoch", F.length("title").alias("title_length"), F.length("content").alias("content_length"))


def joined_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of each machine's documents in order, all of them: a row for each piece of the joined text."""
    rows = documents(spark, sf_dir, "machine_id", "created_at_epoch", "title").filter("machine_id is not null").select("machine_id", F.struct("created_at_epoch", "file_path").alias("at"), F.col("title").alias("text"))
    return ordered_pieces(rows, "machine_id")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: events with less than a day between, two at least."""
    return sessions.sessions(_events(spark, sf_dir), "user_id", "ts", "1 day", 2)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of another type than their user's event before."""
    return sessions.drop_repeats(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type").select("event_id")


def last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "oc_part").filter("session_id is not null and id is not null and time_created is not null").select("session_id", "id", "time_created").distinct()
    return sessions.last_messages(parts, "session_id", ["time_created", "id"], 5).select("session_id", "id", "from_end")


def session_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chat session's last sixty texts as a note."""
    texts = part_texts(table(spark, sf_dir, "oc_part").filter("id is not null").distinct()).select("session_id", "at.time_created", "at.id", "text").filter("time_created is not null")
    notes = session_notes(texts, "session_id", ["time_created", "id"], "text", "opencode")
    return notes.select("session_id", "file_name", F.md5("note").alias("note_md5"))


def memory_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = memory_note(F.col("title"), normal_tags(F.col("tags_json")), F.coalesce("created_at", F.lit("")), F.col("content"))
    return observations(spark, sf_dir, F.md5(note).alias("note_md5"))


def scan_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source when it last changed, and how many documents and machines it has."""
    docs = documents(spark, sf_dir, "source_type", "file_mtime", "machine_id")
    return docs.groupBy("source_type").agg(F.max("file_mtime").alias("newest"), F.min("file_mtime").alias("oldest"), F.countDistinct("machine_id").alias("machines"))


def stable_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of each document once it rested for three minutes."""
    rows = table(spark, sf_dir, "session_documents").filter("content is not null").select("file_path", F.timestamp_seconds("updated_at_epoch").alias("ts"), "content").distinct()
    return stable_documents(rows, "file_path", "ts", "content").select("file_path", F.unix_timestamp("changed").alias("changed"))


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions by a stream that closes them; those still open at its end are not out yet."""
    schema = table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return run_to_end(close_sessions(rows, "user_id", "ts", "1 day", "1 hour", 2))


QUERIES = {
    "upsert_latest": upsert_latest, "sync_changes": sync_changes, "memory_sync": memory_sync, "import_new": import_new, "export_newest": export_newest, "embed_pending": embed_pending,
    "vector_orphans": vector_orphans, "source_stats": source_stats, "scan_totals": scan_totals, "scan_order": scan_order, "scan_lines": scan_lines, "clean_documents": clean_documents,
    "noise_flags": noise_flags, "short_snippets": short_snippets, "tag_counts": tag_counts, "file_names": file_names, "fingerprints": fingerprints, "tag_overlap": tag_overlap, "tag_sets": tag_sets,
    "chat_documents": chat_documents, "joined_pieces": joined_pieces, "event_sessions": event_sessions, "event_changes": event_changes, "last_messages": last_messages,
    "streamed_sessions": streamed_sessions, "session_exports": session_exports, "memory_notes": memory_notes, "scan_freshness": scan_freshness, "stable_versions": stable_versions,
}

_SESSIONS = """ev as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 day then 0 else 1 end as opens from events),
s as (select *, sum(opens) over (partition by user_id order by ts, event_id rows unbounded preceding) as no from ev),
g as (select user_id, no, min(ts) as started, max(ts) as ended, count(*) as n from s group by 1, 2)"""
_PARSED_TAGS = r"""t as (select *, trim(coalesce(tags_json, '')) as raw from obs),
u as (select *, list_transform(case when starts_with(raw, '[') and json_valid(raw) then from_json(raw, '["VARCHAR"]') else string_split(raw, ',') end, lambda x: trim(x)) as items from t),
tagged as (select *, list_filter(items, lambda x, i: x is not null and x <> '' and list_position(items, x) = i) as tags from u)"""



def clean_sql(column: str) -> str:
    """A text without private blocks and secrets, in SQL, from the same patterns."""
    bare = f"trim(regexp_replace(regexp_replace({column}, '(?is)<private>.*?</private>', '', 'g'), '(?i)</?private>', '', 'g'), ' ')"
    out = bare
    for pattern, to in SECRETS:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), to.replace("$1", "\\1"))
    marks = " or ".join(f"contains(lower({bare}), '{m}')" for m in SECRET_MARKS)
    return f"(case when {marks} then {out} else {bare} end)"


def _scan_sql(query: str) -> str:
    """The scan of chat rows in SQL: labelled texts, without noise, scored by field and hits in their snippet."""
    fields = [("message", "$.message", 100), ("root.display", "$.display", 70), ("root.text", "$.text", 100), ("root.prompt", "$.prompt", 20), ("root.content", "$.content", 70)]
    fields += [("root.user_instructions", "$.user_instructions", 20), ("root.last_agent_message", "$.last_agent_message", 70), ("root.output", "$.output", 40)]
    fields += [("payload.message", "$.payload.message", 100), ("payload.display", "$.payload.display", 70), ("payload.text", "$.payload.text", 100), ("payload.prompt", "$.payload.prompt", 20)]
    fields += [("payload.user_instructions", "$.payload.user_instructions", 20), ("payload.last_agent_message", "$.payload.last_agent_message", 70), ("payload.output", "$.payload.output", 40), ("message.content", "$.message.content", 100)]
    texts = " union all ".join(f"select path, line_no, {i} as i, '{f}' as field, {w} as w, d ->> '{p}' as text from v where json_type(d, '{p}') = 'VARCHAR'" for i, (f, p, w) in enumerate(fields))
    blocks = " union all ".join(
        f"select path, line_no, {i} as i, '{f}' as field, 120 as w, unnest(d ->> '{p}[*].text') as text from v where json_type(d, '{p}') = 'ARRAY'" for i, f, p in ((15, "payload.content.text", "$.payload.content"), (17, "message.content.text", "$.message.content"))
    )
    low = "lower(trim(text, ' '))"
    marks = " or ".join("contains({}, '{}')".format(low, m) for m in [*SCAN_NOISE, "drwx", "rwxr-xr-x"])
    starts = " or ".join(f"starts_with({low}, '{p.strip()}')" for p in SCAN_NOISE_PREFIXES)
    short = f"len(list_filter(list_transform(string_split({low}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' and strlen(x) <= 40 and not contains(x, ' ') and length(x) - length(replace(x, '/', '')) < 2 and length(x) - length(replace(x, '-', '')) <= 3))"
    n = len(query)
    return f"""with p as (select distinct session_id as path, id, data, time_created from oc_part where session_id is not null and data is not null and id is not null),
counts as (select path, count(*) as lines from p group by 1),
v as (select path, coalesce(time_created, 0) as line_no, case when json_valid(data) then data end as d from p),
k as (select * from v where d is not null and not (coalesce(d ->> '$.type' in ('turn_context', 'custom_tool_call'), false) or coalesce(d ->> '$.type' = 'response_item' and d ->> '$.payload.type' in ('function_call_output', 'function_call', 'reasoning'), false)
  or coalesce(d ->> '$.type' = 'event_msg' and d ->> '$.payload.type' in ('token_count', 'task_started'), false))),
t as ({texts.replace("from v", "from k")} union all {blocks.replace("from v", "from k")}),
h as (select *, trim(text, ' ') as c from t where contains(lower(text), '{query}') and not ({marks} or contains({low}, chr(10) || 'total ') or {starts} or {short} >= 5)),
g as (select *, instr(lower(c), '{query}') - 1 as hit, length(c) as n from h),
e as (select *, least(n, hit + {n} + 90) as e, greatest(0, hit - 90) as s0 from g),
f as (select *, case when n <= 180 then c else substr(c, case when e - s0 < 180 then greatest(0, e - 180) else s0 end + 1, e - case when e - s0 < 180 then greatest(0, e - 180) else s0 end) end as snippet from e),
z as (select *, w + 25 * ((length(lower(snippet)) - length(replace(lower(snippet), '{query}', ''))) // {n}) as score from f)
select path, lines, field as match_field, score::int as match_score from z join counts using (path) qualify row_number() over (partition by path order by score desc, line_no, i) = 1"""


SQL = {
    "scan_lines": _scan_sql("scanner"),
    "clean_documents": f"select doc_id, md5({clean_sql('text')}) as text_md5 from documents where text is not null",
    "import_new": rf"""with {OBS}, {_PARSED_TAGS}, clean as (select *, {clean_sql("coalesce(title, '')")} as t2, {clean_sql("coalesce(content, '')")} as c2,
  case when regexp_matches(file_path, '^(?:/|~|[A-Za-z]:[\/]|\\)') or contains(file_path, '..') then 'import://local-path-redacted' else coalesce(file_path, '') end as p2 from tagged where source_type = 'import'),
own as (select coalesce(nullif(fingerprint, ''), sha256(concat_ws('|', source_type, t2, c2, coalesce(created_at_epoch::varchar, '')))) as fingerprint, p2 as file_path, array_to_string(tags, ',') as tags,
  md5(c2) as content_md5, created_at_epoch, t2, c2, session_id from clean where t2 <> '' and c2 <> '')
select fingerprint, file_path, tags, content_md5 from own where fingerprint not in (select fingerprint from obs where source_type <> 'import' and fingerprint is not null)
qualify row_number() over (partition by fingerprint order by created_at_epoch, t2, c2, file_path, session_id) = 1""",
    "chat_documents": r"""with one as (select id as session_id, time_updated as u, time_created as c, title as t, directory as d from oc_session where id is not null
  qualify row_number() over (partition by id order by time_updated desc nulls last, time_created desc nulls last, title desc nulls last, directory desc nulls last) = 1),
p as (select distinct session_id, id, data, time_created from oc_part where session_id is not null),
x as (select session_id, id, time_created, trim(regexp_replace(case when json_valid(data) and json_type(data) = 'OBJECT' then coalesce(case when json_type(data, '$.text') = 'VARCHAR' then data ->> '$.text' end,
  case when json_type(data, '$.message') = 'VARCHAR' then data ->> '$.message' end, case when json_type(data, '$.message.content') = 'VARCHAR' then data ->> '$.message.content' end) end, '\s+', ' ', 'g'), ' ') as text from p),
q as (select *, 24000 - coalesce(sum(length(text) + 1) over (partition by session_id order by time_created nulls first, id rows between unbounded preceding and 1 preceding), 0) as room from x where text <> ''),
j as (select session_id, string_agg(substr(text, 1, room::bigint), chr(10) order by time_created nulls first, id) as content from q where room > 0 group by 1)
select coalesce(one.session_id, j.session_id) as session_id, greatest(1, coalesce(u, c, 0) // 1000)::bigint as created_at_epoch,
  length(coalesce(nullif(t, ''), nullif(d, ''), one.session_id, j.session_id))::int as title_length,
  length(coalesce(nullif(content, ''), nullif(t, ''), nullif(d, ''), one.session_id, j.session_id))::int as content_length from one full join j on one.session_id = j.session_id""",
    "upsert_latest": f"with {DOCS} select file_path, updated_at_epoch, md5(coalesce(content, '')) as content_md5 from docs",
    "sync_changes": f"""with {DOCS}, listed as (select path as file_path, max(size_bytes) as size from session_summary where path is not null group by 1)
select coalesce(l.file_path, d.file_path) as file_path, case when d.file_path is null then 'added' when l.file_path is null then 'removed' when l.size is not distinct from d.file_size then 'unchanged' else 'updated' end as change
from listed l full join docs d on l.file_path = d.file_path""",
    "memory_sync": f"""with {DOCS}, {OBS}, files as (select file_path, sha256(file_path || '|' || file_size) as fp from docs),
newest as (select * from obs where file_path <> '' qualify row_number() over (partition by file_path order by updated_at_epoch desc, id desc) = 1),
dup as (select 'duplicate' as action, file_path, id from obs where file_path <> '' and id not in (select id from newest)),
known as (select case when n.fingerprint = f.fp then 'touched' else 'updated' end as action, f.file_path, n.id from files f join newest n using (file_path)),
gone as (select * from newest where file_path not in (select file_path from files)),
one as (select fingerprint, min(id) as id from gone group by 1),
open as (select case when o.id is null then 'added' else 'renamed' end as action, f.file_path, o.id from files f left join one o on f.fp = o.fingerprint where f.file_path not in (select file_path from newest)),
removed as (select 'removed' as action, file_path, id from gone where source_type in ('history', 'conversation') and id not in (select id from open where action = 'renamed'))
select * from known union all select * from open union all select * from removed union all select * from dup""",
    "export_newest": f"with {OBS} select id, created_at_epoch from obs order by created_at_epoch desc, id desc limit 500",
    "embed_pending": """select doc_id, case when vec_id is null then 'missing' else 'stale' end as why from documents left join embeddings on doc_id = vec_id
        where vec_id is null or doc_id % 7 > vec_id % 5""",
    "vector_orphans": "select distinct vec_id as doc_id from embeddings where vec_id not in (select doc_id from documents)",
    "source_stats": f"with {DOCS} select source_type, count(*) as n, max(created_at_epoch) as newest, sum(file_size)::bigint as bytes, count(*) filter (content is null) as without_content from docs group by 1",
    "scan_totals": f"""with {DOCS}, labels as (select distinct source_type as source from docs union select 'copilot_session'), rows_ as (select distinct * from session_summary),
t as (select source, count(*) as session_count, sum(lines)::bigint as total_lines, sum(size_bytes)::bigint as total_bytes from rows_ group by 1),
b as (select source, path as first_path, session_id, first_timestamp, last_timestamp, snippet, match_field from rows_ qualify row_number() over (partition by source order by coalesce(match_score, 0) desc,
  last_timestamp desc nulls last, first_timestamp desc nulls last, path nulls first, session_id desc nulls last, snippet desc nulls last, match_field desc nulls last) = 1)
select source, coalesce(session_count, 0) as session_count, coalesce(total_lines, 0) as total_lines, coalesce(total_bytes, 0) as total_bytes, first_path, session_id, first_timestamp, last_timestamp, snippet, match_field
from labels left join t using (source) left join b using (source)""",
    "scan_order": """select path, match_score, match_field from (select distinct * from session_summary) where snippet is not null
        order by match_score desc, last_timestamp desc nulls last, first_timestamp desc nulls last, path limit 50""",
    "short_snippets": rf"""with {OBS}, c as (select id, trim(regexp_replace(content, '[\s\x{{a0}}\x{{3000}}]+', ' ', 'g'), ' ') as c from obs where content is not null)
select id, case when length(c) <= 120 then c else rtrim(substr(c, 1, 119), ' ') || '…' end as snippet from c""",
    "tag_counts": f"with {OBS}, {_PARSED_TAGS} select tag, count(*) as n from (select unnest(tags) as tag from tagged) group by 1",
    "tag_overlap": f"""with {OBS}, {_PARSED_TAGS}, s as (select session_id, list_sort(tags) as tags, min(id) as id from tagged where session_id is not null group by 1, 2)
select a.id, b.id as other, round(len(list_intersect(a.tags, b.tags))::double / len(list_distinct(list_concat(a.tags, b.tags))), 9) as overlap
from s a join s b on a.session_id = b.session_id and a.id < b.id where len(list_intersect(a.tags, b.tags)) > 0""",
    "tag_sets": f"""with {OBS}, {_PARSED_TAGS} select session_id, min(id) as id, array_to_string(list_sort(tags), ',') as tags, count(*) as n from tagged where session_id is not null group by session_id, list_sort(tags)""",
    "file_names": rf"""with {DOCS}, c as (select file_path, regexp_replace(regexp_replace(lower(trim(coalesce(title, ''), ' ')), '[^a-zA-Z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') as n from docs)
select file_path, substr(case when n = '' then 'memory' else n end, 1, 120) as name from c""",
    "fingerprints": f"with {OBS} select id, sha256(concat_ws('|', coalesce(source_type, ''), coalesce(title, ''), coalesce(content, ''), coalesce(created_at_epoch::varchar, ''))) as own from obs",
    "event_sessions": f"with {_SESSIONS} select user_id, started, ended, n from g where n >= 2",
    "streamed_sessions": f"with {_SESSIONS} select user_id, started, ended, n from g where n >= 2 and ended + interval 1 day <= (select max(ts) - interval 1 hour from events)",
    "session_exports": r"""with p as (select distinct session_id, id, data, time_created from oc_part where session_id is not null and id is not null and time_created is not null),
t as (select session_id, id, time_created, case when json_valid(data) and json_type(data) = 'OBJECT' then coalesce(case when json_type(data, '$.text') = 'VARCHAR' then data ->> '$.text' end,
  case when json_type(data, '$.message') = 'VARCHAR' then data ->> '$.message' end, case when json_type(data, '$.message.content') = 'VARCHAR' then data ->> '$.message.content' end) end as text from p),
l as (select *, row_number() over (partition by session_id order by time_created desc, id desc) as back from t where text is not null qualify back <= 60),
n as (select session_id, count(*) as n, '# ' || session_id || chr(10) || chr(10) || '- ' || string_agg(substr(text, 1, 2000), chr(10) || '- ' order by back desc) as note from l group by 1)
select session_id, 'opencode_' || substr(regexp_replace(regexp_replace(lower(session_id), '[^a-zA-Z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 1, 64) || '.md' as file_name, md5(note) as note_md5 from n where n >= 2""",
    "memory_notes": f"""with {OBS}, {_PARSED_TAGS} select id, case when trim(coalesce(title, ''), ' ') <> '' and trim(coalesce(content, ''), ' ') <> ''
        then md5('# ' || trim(title, ' ') || chr(10) || chr(10) || 'Tags: ' || array_to_string(tags, ', ') || chr(10) || 'Date: ' || coalesce(created_at, '') || chr(10) || chr(10) || '## Content'
          || chr(10) || chr(10) || trim(content, ' ') || chr(10)) end as note_md5 from tagged""",
    "scan_freshness": f"with {DOCS} select source_type, max(file_mtime) as newest, min(file_mtime) as oldest, count(distinct machine_id) as machines from docs group by 1",
    "stable_versions": """with v as (select distinct file_path, updated_at_epoch as t, content from session_documents where content is not null),
s as (select *, case when t - lag(t) over (partition by file_path order by t) < 180 then 0 else 1 end as opens from v),
g as (select *, sum(opens) over (partition by file_path order by t rows unbounded preceding) as no from s),
w as (select * from g qualify row_number() over (partition by file_path, no order by t desc, content desc) = 1)
select file_path, t as changed from w where length(content) >= 400""",
    "event_changes": "select event_id from events qualify lag(event_type) over (partition by user_id order by ts, event_id) is distinct from event_type",
    "last_messages": """select session_id, id, row_number() over (partition by session_id order by time_created desc, id desc)::int as from_end
        from (select distinct session_id, id, time_created from oc_part where session_id is not null and id is not null and time_created is not null) qualify from_end <= 5""",
    "noise_flags": rf"""with {DOCS}, c as (select file_path, trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g'), ' ') as t, trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g'), ' ') as c from docs)
select file_path, c = '' or contains(c, '### Available skills') or contains(c, 'You are Codex') or contains(c, 'You are Claude') or contains(c, '<environment_context>')
  or (length(c) - length(replace(c, 'SKILL.md', ''))) / 8 >= 3 as noise, t <> '' and t = c and contains(c, '/') and not regexp_matches(c, '[。，.:]') as path_only from c""",
    "joined_pieces": rf"""with {DOCS}, p as (select machine_id, created_at_epoch, file_path, trim(regexp_replace(title, '\s+', ' ', 'g'), ' ') as text from docs where machine_id is not null and title is not null)
select machine_id, row_number() over (partition by machine_id order by created_at_epoch nulls first, file_path) as place, text from p where text <> ''""",
}
