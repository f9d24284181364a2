"""Searches over session documents and observations: containment, ranking, prefixes, ids, filters."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scoring import score
from tracewell.functions.text import best_window, query_terms
from tracewell.operators.topk import latest, newest
from tracewell.session import pin

SESSION_FIELDS = ("title", "content", "file_path")


def contains_terms(terms: Sequence[str], fields: Sequence[str] = SESSION_FIELDS) -> Column:
    """Whether any field holds any term, whatever the case. Terms are plain text, never patterns."""
    tests = [F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(t.lower())) for t in terms for f in fields]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def newest_first(docs: DataFrame, limit: int = 200) -> DataFrame:
    return docs.orderBy(F.desc("created_at_epoch"), F.desc("file_path")).limit(limit)


def candidates(docs: DataFrame, terms: Sequence[str], limit: int = 200) -> DataFrame:
    """The newest documents that hold a term. The limit is the operator's feature, not a sample."""
    return newest_first(docs.filter(contains_terms(terms)), limit)


def rank(docs: DataFrame, terms: Sequence[str], as_of: int, skip_title: str | None = None, versions: tuple[str, list[str]] | None = None) -> DataFrame:
    """Documents that hold a term with their whole-number score, those above 0. skip_title leaves out documents titled so.

    versions (key, version columns): docs are versions of documents, of which the newest count. Every row is scored where
    it is read, and only file_path, source_type, created_at_epoch and score are shuffled to find the newest.
    """
    scored = F.when(contains_terms(terms), score(terms, as_of))
    if skip_title is not None:
        scored = F.when(~F.col("title").eqNullSafe(F.lit(skip_title)), scored)
    if versions:
        docs = newest(docs, *versions, ["source_type", "created_at_epoch", scored.alias("_score")])
    else:
        docs = docs.withColumn("_score", scored)
    return docs.filter("_score > 0").withColumn("score", F.col("_score").cast("bigint")).drop("_score")


def least_frequent(docs: DataFrame, terms: Sequence[str], n: int = 2, versions: tuple[str, list[str]] | None = None) -> list[str]:
    """Of a query's terms those that fewest documents hold (but some do), longer ones first; one aggregation for all terms."""
    held = [contains_terms([t]).alias(f"_{i}") for i, t in enumerate(terms)]
    docs = newest(docs, *versions, held) if versions else docs.select(*held)
    row = docs.agg(*[F.count_if(f"_{i}") for i in range(len(terms))]).first()
    found = [(row[i], -len(t), i, t) for i, t in enumerate(terms) if row[i]]
    return [t for *_, t in sorted(found)[:n]]


def search(docs: DataFrame, query: str, as_of: int, limit: int = 10, skip_title: str | None = None, versions: tuple[str, list[str]] | None = None) -> DataFrame:
    """The ranked search: candidates by any term, scored; if nothing scores, again with the two rarest terms.

    Every document is scored in one pass that ends in a top-k; the plan needs no shuffle but that of the result and, for
    docs that are versions (see rank()), one of narrow rows.
    """
    terms = query_terms(query) or [query.strip()]
    limit = max(1, min(limit, 100))
    found = pin(best_first(rank(docs, terms, as_of, skip_title, versions), limit), "search")  # a hundred rows at most, looked at twice
    if found.isEmpty():
        found = best_first(rank(docs, least_frequent(docs, terms, 2, versions), as_of, skip_title, versions), limit)
    return found.orderBy(F.desc("score"), F.desc("created_at_epoch"), "file_path")


def best_first(found: DataFrame, limit: int) -> DataFrame:
    return found.orderBy(F.desc("score"), F.desc("created_at_epoch"), "file_path").limit(limit)


def first_phrasing(phrasings: Sequence[Sequence[str]], fields: Sequence[str] = SESSION_FIELDS) -> Column:
    """The number (from 0) of the first phrasing, each a list of terms, of which a row holds a term; null for none. All phrasings in one pass."""
    return F.coalesce(*[F.when(contains_terms(terms, fields), F.lit(i)) for i, terms in enumerate(phrasings)])


def with_snippets(results: DataFrame, terms: Sequence[str], radius: int = 80) -> DataFrame:
    """Adds the best window of each result row. For results, which are few; runs as an Arrow batch function after the top-k."""
    @F.pandas_udf("string")
    def window(text: pd.Series) -> pd.Series:
        return text.map(lambda t: best_window(t, terms, radius))

    return results.withColumn("snippet", window("content"))


def lookup_session(docs: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Newest documents whose session id begins so, whatever the case."""
    found = docs.filter(F.lower("session_id").startswith(prefix.lower()))
    return found.orderBy(F.desc("created_at_epoch"), "file_path").limit(limit)


def by_ids(rows: DataFrame, ids: Sequence[int], limit: int = 300) -> DataFrame:
    wanted = list(ids)[: max(1, min(limit, 300))]
    return rows.filter(F.col("id").isin(wanted)).orderBy(F.desc("created_at_epoch"), F.desc("id"))


def observations_matching(rows: DataFrame, query: str = "", source_type: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """Observations that hold the query in title, content or tags; of one type; within epoch bounds. Open conditions filter nothing."""
    if query.strip():
        rows = rows.filter(contains_terms([query.strip()], ("title", "content", "tags_json")))
    if source_type and source_type != "all":
        rows = rows.filter(F.col("source_type") == source_type)
    if since is not None:
        rows = rows.filter(F.col("created_at_epoch") >= since)
    return rows if until is None else rows.filter(F.col("created_at_epoch") <= until)


def page(rows: DataFrame, limit: int, offset: int = 0, key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc("created_at_epoch"), F.desc(key)).offset(max(0, offset)).limit(max(1, min(limit, 200)))


def route(query: str) -> str:
    """'session' for what looks like a session id, else 'search'."""
    return "session" if re.fullmatch(r"[0-9a-f]{8}[-0-9a-f]*", query.strip(), re.I) else "search"


def first_wins(results: Sequence[DataFrame], key: str, order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """Union of result lists: a row counts in the first list that has it; lists in turn, each in its order, up to the limit, if any."""
    every = reduce(DataFrame.unionByName, [r.withColumn("query_no", F.lit(i)) for i, r in enumerate(results)])
    found = latest(every, [key], [F.col("query_no"), *order])
    return found if limit is None else found.orderBy("query_no", *order).limit(limit)


def semantic(memories: DataFrame, sessions: DataFrame, limit: int | None = 5) -> DataFrame:
    """Memory results if there are any, else session results: one plan, decided by a count of the former. Both with columns (origin, key, title)."""
    some = memories.limit(1).agg((F.count(F.lit(1)) > 0).alias("_some"))
    kept = sessions.join(F.broadcast(some), F.lit(True)).filter(~F.col("_some")).drop("_some")  # a single row
    found = memories.unionByName(kept)
    return found if limit is None else found.limit(limit)
