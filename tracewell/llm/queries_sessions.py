"""Queries over session documents, observations and chat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.boilerplate import find_repeated, remove_repeated
from tracewell.llm.conversations import rebuild
from tracewell.llm.near_duplicates import similar_pairs
from tracewell.llm.personal import find_personal, redact
from tracewell.tables import table


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "session_documents").select("file_path", "source_type", "content")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session documents and observations under common names."""
    docs = table(spark, sf_dir, "session_documents").select(F.lit("session_documents").alias("table_name"), F.col("file_path").alias("key"), "content")
    notes = table(spark, sf_dir, "observations").select(F.lit("observations").alias("table_name"), F.col("id").cast("string").alias("key"), "content")
    return docs.unionByName(notes)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one table with similar contents."""
    return similar_pairs(_records(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of e-mail addresses, phone and identity numbers, street addresses and names."""
    spans = find_personal(_records(spark, sf_dir), table(spark, sf_dir, "given_names"))
    rows = spans.select("table_name", F.col("key").alias("record_key"), F.explode("spans").alias("s"))
    return rows.select("table_name", "record_key", "s.kind", "s.value").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents with placeholders for mentions."""
    records = _records(spark, sf_dir)
    return redact(records.distinct(), find_personal(records, table(spark, sf_dir, "given_names")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines repeated excessively within a source_type."""
    return find_repeated(_contents(spark, sf_dir), "file_path", "source_type", "content").select("file_path", "line_no")


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session documents without the lines repeated in their source."""
    docs = _contents(spark, sf_dir).distinct()
    return remove_repeated(docs, "file_path", "source_type", "content", find_repeated(docs, "file_path", "source_type", "content"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the conversations that are whole."""
    return rebuild(spark, f"{sf_dir}/oc_part.parquet", with_text=False).select("session_id", "seq", "part_id", "role")


def p5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with time and text."""
    return rebuild(spark, f"{sf_dir}/oc_part.parquet")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_clean": p4_clean, "p5_found": p5_found, "p5_conversations": p5_conversations}

_P4_LINES = r"""
docs as (select distinct file_path, source_type, content from session_documents
         where content is not null and source_type is not null and file_path is not null),
lines as (select file_path, source_type, unnest(string_split(content, chr(10))) as line,
                 generate_subscripts(string_split(content, chr(10)), 1) as line_no from docs),
keyed as (select *, lower(regexp_replace(line, '[^\p{L}]+', '', 'g')) as k from lines),
heavy as (select source_type, k from keyed where length(k) >= 12 group by source_type, k
          having count(distinct file_path) >= 4 and count(distinct file_path) >=
            0.05 * (select count(distinct d.file_path) from docs d where d.source_type = keyed.source_type))
"""
SQL = {
    "p5_found": r"""with raw as (select distinct session_id, id, data, time_created as t from oc_part where session_id is not null),
once as (select *, case when json_valid(data) then case when json_type(data) = 'VARCHAR' then data ->> '$' else data end end as d from raw),
obj as (select *, case when json_valid(d) and json_type(d) = 'OBJECT' then d end as o, case when abs(t) < 100000000000 then t * 1000000 when abs(t) < 100000000000000 then t * 1000 else t end as us from once),
named as (select *, lower(coalesce(o ->> '$.type', '')) as kind, case when json_type(o, '$.message.role') = 'VARCHAR' then o ->> '$.message.role' when json_type(o, '$.role') = 'VARCHAR' then o ->> '$.role' end as r,
  case when json_type(o, '$.message.content') = 'VARCHAR' then o ->> '$.message.content' end as t1, case when json_type(o, '$.message') = 'VARCHAR' then o ->> '$.message' end as t2,
  case when json_type(o, '$.text') = 'VARCHAR' then o ->> '$.text' end as t3,
  case when json_type(o, '$.content') = 'VARCHAR' then o ->> '$.content' when json_type(o, '$.content') = 'ARRAY' then array_to_string(o ->> '$.content[*].text', ' ') end as t4 from obj),
told as (select *, lower(trim(coalesce(r, regexp_replace(kind, '_message$', '')))) as who, o is null or us is null as broken,
  regexp_matches(coalesce(t1, '') || coalesce(t2, '') || coalesce(t3, '') || coalesce(t4, ''), '[^\s\x{a0}\x{3000}]') as has_text from named),
said as (select session_id, id, us, broken, case when who in ('user', 'human') then 'user' when who in ('assistant', 'ai', 'model', 'bot', 'agent') then 'assistant' when who in ('system', 'developer') then 'system' end as role,
  has_text and (kind in ('', 'text', 'message', 'chat', 'msg') or regexp_replace(kind, '_message$', '') in ('user', 'human', 'assistant', 'ai', 'model', 'bot', 'agent', 'system', 'developer')) as ok from told),
whole as (select session_id from said group by 1 having not bool_or(broken)),
m as (select session_id, id, us, role, row_number() over (partition by session_id order by us, id) as seq from said join whole using (session_id) where ok and role is not null),
turns as (select *, lag(role) over w as before, lead(role) over w as after from m where role <> 'system' window w as (partition by session_id order by us, id)),
good as (select session_id from turns group by 1 having not bool_or(role = 'user' and (after is null or after = 'user')) and not bool_or(before is null and role <> 'user'))
select session_id, seq, id as part_id, role from m join good using (session_id)""",
    "p2_found": r"""with r as (select distinct 'session_documents' as table_name, file_path as key, content from session_documents where file_path is not null and content is not null
  union select distinct 'observations', id::varchar, content from observations where id is not null and content is not null),
w as (select table_name, key, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') as w from r),
s as (select distinct table_name, key, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select table_name, key, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 40)),
n as (select table_name, key, count(*) as n from s group by all),
c as (select a.table_name, a.key as key_a, b.key as key_b, count(*) as c from s a join s b on a.table_name = b.table_name and a.s = b.s and a.key < b.key group by all)
select c.table_name, key_a, key_b from c join n x on x.table_name = c.table_name and x.key = key_a join n y on y.table_name = c.table_name and y.key = key_b where 2 * c >= x.n + y.n - c""",
    "p4_found": f"with {_P4_LINES} select distinct file_path, cast(line_no as int) as line_no from keyed join heavy using (source_type, k)",
    "p4_clean": f"""with {_P4_LINES}
        select file_path, source_type,
          case when count(k.line_no) = 0 then any_value(content)
               else coalesce(string_agg(line, chr(10) order by k.line_no) filter (h.k is null), '') end as content
        from (select distinct file_path, source_type, content from session_documents) d
        left join keyed k using (file_path, source_type) left join heavy h using (source_type, k)
        group by file_path, source_type""",
}


def _conversations_sql() -> str:
    """The SQL of p5_found with the time and the text of each message: the first of its texts that is not blank."""

    def text(path: str) -> str:
        block = "case when json_type(b) = 'VARCHAR' then b ->> '$' when json_type(b) = 'OBJECT' and coalesce(b ->> '$.type', '') in ('', 'text', 'input_text', 'output_text') then coalesce(nullif(b ->> '$.text', ''), nullif(b ->> '$.content', '')) end"
        listed = f"array_to_string(list_filter(list_transform(cast(o -> '{path}' as json[]), lambda b: {block}), lambda x: x is not null and x <> ''), chr(10))"
        return f"case json_type(o, '{path}') when 'VARCHAR' then o ->> '{path}' when 'ARRAY' then {listed} end"

    said = ", ".join(f"case when regexp_matches({x}, '[^\\s\\x{{a0}}\\x{{3000}}]') then {x} end" for x in map(text, ("$.message.content", "$.message.text", "$.message", "$.text", "$.content", "$.parts")))
    sql = SQL["p5_found"].replace("has_text from named", f"has_text, coalesce({said}) as text from named")
    sql = sql.replace("said as (select session_id, id, us, broken,", "said as (select session_id, id, us, text, broken,").replace("m as (select session_id, id, us, role,", "m as (select session_id, id, us, role, text,")
    return sql.replace("select session_id, seq, id as part_id, role from m", "select session_id, seq, id as part_id, us, role, text from m")


SQL["p5_conversations"] = _conversations_sql()
