"""Queries over documents: token ids, leaked evaluation items, garbled text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.garbled import restore
from tracewell.llm.leaks import find_leaks, remove_leaks
from tracewell.llm.tokenize import encode
from tracewell.tables import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document; rows that are the same record count once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").distinct()
    return encode(docs).select("doc_id", "ids")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain eight consecutive words of an evaluation item's question or answer."""
    items = table(spark, sf_dir, "eval_items")
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", ["question", "answer"])


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the leaked stretches."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").distinct()
    return remove_leaks(docs, "text", table(spark, sf_dir, "eval_items"), "item_id", ["question", "answer"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was read with the wrong encoding, wholly or in places."""
    return restore(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").filter("garbled").select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These documents with the text restored."""
    return restore(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").filter("garbled").select("doc_id", "restored").distinct()


QUERIES = {"p6_ids": p6_ids, "p7_found": p7_found, "p7_clean": p7_clean, "p8_found": p8_found, "p8_restored": p8_restored}

SQL: dict[str, str] = {
    "p7_found": r"""
with w as (select item_id, regexp_extract_all(lower(p), '[\p{L}\p{N}]+') as w
           from (select item_id, unnest([question, answer]) as p from eval_items) where p is not null),
grams as (select distinct item_id, list_aggregate(w[i : i + 7], 'string_agg', ' ') as g
          from (select item_id, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
windows as (select doc_id, list_aggregate(w[i : i + 7], 'string_agg', ' ') as g
            from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8))
select distinct doc_id, item_id from windows join grams using (g)""",
    "p7_clean": rf"""
with w as (select item_id, regexp_extract_all(lower(p), '[\p{{L}}\p{{N}}]+') as w
           from (select item_id, unnest([question, answer]) as p from eval_items) where p is not null),
grams as (select distinct list_aggregate(w[i : i + 7], 'string_agg', ' ') as g
          from (select item_id, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
d as (select row_number() over () as r, * from (select distinct doc_id, text from documents)),
pieces as (select r, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') as p from d where text <> ''),
tok as (select r, unnest(p) as t, generate_subscripts(p, 1) as j from pieces),
said as (select r, j, lower(t) as t from tok where regexp_matches(t, '^[\p{{L}}\p{{N}}]')),
win as (select r, j as a, lead(j, 7) over o as b, {" || ' ' || ".join(f"lead(t, {i}) over o" for i in range(8))} as g from said window o as (partition by r order by j)),
hit as (select distinct r, a, b from win join grams using (g) where b is not null),
gone as (select distinct tok.r, tok.j from tok join hit on tok.r = hit.r and tok.j between a and b),
kept as (select tok.r, string_agg(t, '' order by tok.j) filter (gone.j is null) as x from tok left join gone on tok.r = gone.r and tok.j = gone.j group by 1)
select doc_id, case when text is null then null when text = '' then '' else coalesce(x, '') end as text, d.r in (select r from hit) as leaked from d left join kept using (r)""",
}
