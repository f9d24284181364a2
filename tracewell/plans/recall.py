"""Queries of recall and of results with their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import recall_queries
from tracewell.functions.vocabulary import SCAN_NOISE
from tracewell.operators import ranking, recall, search
from tracewell.plans.base import AS_OF, DOCS, OBS, documents, observations
from tracewell.plans.search import QUERY, RANKED, TERMS, VERSIONS
from tracewell.tables import table

MESSAGE, WORDS = "why is the frozen scanner of src/juniper slow", ["scanner", "juniper"]


def memory_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty memories whose path or content holds a word."""
    rows = observations(spark, sf_dir, "file_path", "content", "created_at_epoch")
    return recall.memory_matches(rows, "Retry", "file_path", "content", "created_at_epoch", 50).select("id", "created_at_epoch")


def recall_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.recall(table(spark, sf_dir, "observations"), MESSAGE, WORDS, ("file_path", "content"), "id", "created_at_epoch", 50, ["updated_at_epoch"])


def recall_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions that a message recalls."""
    return recall.recall(table(spark, sf_dir, "session_documents"), MESSAGE, WORDS, search.SESSION_FIELDS, "file_path", "created_at_epoch", None, ["updated_at_epoch"])


def enriched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of the ranked search with their title and the surroundings of a word."""
    found = search.search(table(spark, sf_dir, "session_documents"), QUERY, AS_OF, versions=VERSIONS).select("file_path", "score")
    return recall.enrich(found, documents(spark, sf_dir), "file_path", TERMS[0])


def enriched_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a raw scan that show a word, with their documents."""
    hits = recall.scan_hits(table(spark, sf_dir, "session_summary").distinct(), "the").select(F.col("path").alias("file_path"), "match_score", F.col("snippet").alias("hit"))
    return recall.enrich(hits, documents(spark, sf_dir), "file_path", "the").select("file_path", "match_score", F.md5("hit").alias("hit_md5"), "title", "source_type", F.md5("snippet").alias("snippet_md5"))


def results_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.rank(table(spark, sf_dir, "session_documents"), TERMS, AS_OF, versions=VERSIONS)
    order = [F.desc("score"), F.desc("created_at_epoch"), F.col("file_path")]
    return recall.of_source(found, order, "c", 10).select("file_path", "source_type", "score")


def active_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts that changed within a year, without those of skills and sub-agents."""
    files = documents(spark, sf_dir, F.col("file_mtime").alias("mtime")).withColumnRenamed("file_path", "path")
    return recall.active_files(files, 1_720_000_000, 365 * 86_400)


def refreshed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of documents after an update: which were kept, which are new."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 7).alias("changed")).distinct()
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", (F.col("vec_id") % 5).alias("indexed"))
    found = recall.refresh_vectors(docs, vectors, "doc_id", "changed", lambda rows: ranking.embed(rows, "text"), 9)
    return found.select("doc_id", "indexed", F.size("embedding").alias("dim"))


def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a phrase: the words of a token follow each other."""
    return ranking.match_all(documents(spark, sf_dir), "stayed-quiet", "file_path", {"title": 10.0, "content": 5.0}, k=100_000).select("key")


QUERIES = {
    "memory_newest": memory_newest, "recall_memories": recall_memories, "recall_sessions": recall_sessions, "enriched_results": enriched_results, "enriched_hits": enriched_hits,
    "results_of_source": results_of_source, "active_listing": active_listing, "refreshed_vectors": refreshed_vectors, "phrase_match": phrase_match,
}


def _first_sql(fields: tuple[str, ...]) -> str:
    tests = [" or ".join(f"contains(lower(coalesce({f}, '')), '{q.lower()}')" for f in fields) for q in recall_queries(MESSAGE, WORDS)]
    return "case " + " ".join(f"when {t} then {i}" for i, t in enumerate(tests)) + " end"


def _around(query: str) -> str:
    at = f"instr(lower(content), '{query}')"
    return f"trim(case when {at} > 0 then substr(content, greatest(1, {at} - 120), {at} + {len(query)} + 120 - greatest(1, {at} - 120)) else substr(content, 1, 240) end, ' ')"


_QUIET = " or ".join("contains(lower(snippet), '{}')".format(m.lower()) for m in SCAN_NOISE)
SQL = {
    "memory_newest": f"""with {OBS} select id, created_at_epoch from obs where contains(lower(coalesce(file_path, '')), 'retry') or contains(lower(coalesce(content, '')), 'retry')
order by created_at_epoch desc, file_path limit 50""",
    "recall_memories": f"""with {OBS}, f as (select id, created_at_epoch, {_first_sql(('file_path', 'content'))} as query_no from obs)
select * from f where query_no is not null order by query_no, created_at_epoch desc, id limit 50""",
    "recall_sessions": f"with {DOCS}, f as (select file_path, created_at_epoch, {_first_sql(search.SESSION_FIELDS)} as query_no from docs) select * from f where query_no is not null",
    "enriched_results": f"""{RANKED}, best as (select * from ranked order by score desc, created_at_epoch desc, file_path limit 10)
select file_path, score, title, source_type, {_around(TERMS[0])} as snippet from best""",
    "enriched_hits": f"""with {DOCS}, h as (select distinct * from session_summary where contains(lower(snippet), 'the') and not ({_QUIET}))
select file_path, match_score, md5(h.snippet) as hit_md5, d.title, d.source_type, md5({_around('the')}) as snippet_md5 from h join docs d on h.path = d.file_path""",
    "results_of_source": f"""{RANKED}, best as (select * from ranked order by score desc, created_at_epoch desc, file_path limit 50)
select file_path, source_type, score from best where starts_with(source_type, 'c') order by score desc, created_at_epoch desc, file_path limit 10""",
    "active_listing": f"""with {DOCS} select file_path as path, file_mtime as mtime from docs where file_mtime >= 1720000000 - 365 * 86400
and not contains(file_path, '/skills/') and not contains(file_path, 'skills-repo') and not contains(file_path, '/subagents/')""",
    "refreshed_vectors": """with d as (select distinct doc_id, text, doc_id % 7 as changed from documents), v as (select vec_id, vec_id % 5 as indexed, len(embedding) as dim from embeddings)
select d.doc_id, case when vec_id is null or changed > indexed then 9 else indexed end as indexed, case when vec_id is null or changed > indexed then 256 else dim end::int as dim from d left join v on d.doc_id = v.vec_id""",
    "phrase_match": rf"""with {DOCS}, w as (select file_path as key, ' ' || array_to_string(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2), ' ') || ' | '
  || array_to_string(list_filter(regexp_extract_all(lower(coalesce(content, '')), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2), ' ') || ' ' as w from docs)
select key from w where contains(w, ' stayed quiet ')""",
}
