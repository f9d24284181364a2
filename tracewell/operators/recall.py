"""Recall: what memories and sessions hold for a message, and results with their documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import contains_any, hit_snippet, recall_queries
from tracewell.functions.vocabulary import SCAN_NOISE
from tracewell.operators.memory import orphans, to_embed
from tracewell.operators.search import contains_terms, first_phrasing, route
from tracewell.operators.topk import newest


def memory_matches(rows: DataFrame, query: str, path: str, content: str, time: str, limit: int) -> DataFrame:
    """The newest rows whose path or content holds a query as it stands, whatever the case; the limit is the search's feature."""
    return rows.filter(contains_terms([query.strip()], (path, content))).orderBy(F.desc(time), path).limit(max(1, limit))


def recall(rows: DataFrame, message: str, words: Sequence[str], fields: Sequence[str], key: str, time: str, limit: int | None = 5, versions: Sequence[str] = ()) -> DataFrame:
    """What a message recalls: (key, time, query_no) of the rows that hold one of its searches (see recall_queries), by the first search, the newest first.

    All searches are one pass. versions: rows are versions of keys, of which the newest count.
    """
    number = first_phrasing([[q] for q in recall_queries(message, words)] or [["\0"]], fields)
    docs = newest(rows, key, versions, [time, number.alias("query_no")]) if versions else rows.select(key, time, number.alias("query_no"))
    found = docs.filter("query_no is not null")
    return found if limit is None else found.orderBy("query_no", F.desc(time), key).limit(limit)


def enrich(ranked: DataFrame, docs: DataFrame, key: str, query: str, text: str = "content", columns: Sequence[str] = ("title", "source_type")) -> DataFrame:
    """Ranked keys with columns of their documents and the surroundings of the query; their order stays in `rank`, keys without a document go."""
    kept = docs.select(key, *columns, hit_snippet(F.col(text), query).alias("snippet"))
    return ranked.join(kept, key)


def scan_hits(hits: DataFrame, query: str, marks: Sequence[str] = SCAN_NOISE) -> DataFrame:
    """Hits of a raw scan that show something: a snippet with the query and without marks of no content."""
    low = F.lower(F.coalesce("snippet", F.lit("")))
    return hits.filter(F.contains(low, F.lit(query.strip().lower())) & (F.trim(low) != "") & ~contains_any(low, [m.lower() for m in marks]))


def of_source(results: DataFrame, order: Sequence[Column], source: str | None, limit: int = 10) -> DataFrame:
    """The best results of sources that begin so, out of the five times as many best of all (None or 'all': of any)."""
    if source in (None, "", "all"):
        return results.orderBy(*order).limit(limit)
    return results.orderBy(*order).limit(limit * 5).filter(F.col("source_type").startswith(source)).orderBy(*order).limit(limit)


def active_files(files: DataFrame, now: int, seconds: int, subagents: bool = False) -> DataFrame:
    """Listed files (path, mtime) that changed within some seconds, without those of sub-agents and skills."""
    kept = files.filter((F.col("mtime") >= now - seconds) & ~contains_any(F.col("path"), ["/skills/", "skills-repo"]))
    return kept if subagents else kept.filter(~F.contains("path", F.lit("/subagents/")))


def refresh_vectors(docs: DataFrame, vectors: DataFrame, key: str, changed: str, embedder: Callable[[DataFrame], DataFrame], now: int) -> DataFrame:
    """The table of vectors (key, embedding, indexed) after an update: missing and stale documents are embedded, vectors without a document go, the others stay.

    embedder adds the column embedding to rows of documents; only those that need it reach it.
    """
    pending = to_embed(docs, vectors, key, changed, "indexed")
    fresh = embedder(docs.join(pending.select(key), key, "left_semi")).select(key, "embedding", F.lit(now).cast(vectors.schema["indexed"].dataType).alias("indexed"))
    gone = pending.select(key).unionByName(orphans(vectors, docs, key)).distinct()
    return vectors.select(key, "embedding", "indexed").join(gone, key, "left_anti").unionByName(fresh)


def ask(query: str, sessions: Callable[[str], DataFrame], hybrid: Callable[[str], DataFrame], search: Callable[[str], DataFrame]) -> DataFrame:
    """One query by its form: what looks like a session id is looked up; else the fused search answers, or, where it finds nothing, the ranked one."""
    if route(query) == "session":
        return sessions(query)
    found = hybrid(query)
    return search(query) if found.isEmpty() else found
