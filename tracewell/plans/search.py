"""Queries of retrieval: containment, ranking, lookups, BM25, vectors, fusion, timeline."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import clip_snippet, hit_snippet, keywords, query_terms
from tracewell.functions.vocabulary import SEARCH_NOISE, SOURCE_WEIGHTS, STOP_WORDS
from tracewell.operators import memory, prewarm, ranking, search, topk
from tracewell.plans.base import AS_OF, DOCS, OBS, documents, observations
from tracewell.tables import table

QUERY = "frozen scanner juniper"
TERMS = query_terms(QUERY)
#: Key and versions of session documents.
VERSIONS = ("file_path", ["updated_at_epoch"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked search over all session documents: the ten best for a query."""
    docs = table(spark, sf_dir, "session_documents")
    return search.search(docs, QUERY, AS_OF, versions=VERSIONS).select("file_path", "source_type", "created_at_epoch", "score")


def like_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "created_at_epoch", search.contains_terms(TERMS).alias("held"))
    return search.newest_first(docs.filter("held")).select("file_path", "created_at_epoch")


def rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "session_documents"), TERMS, AS_OF, versions=VERSIONS).select("file_path", "score")


def session_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lookup_session(documents(spark, sf_dir, "session_id", "created_at_epoch"), "A3", 1000).select("file_path", "session_id")


def term_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each term of the query, one pass for all."""
    held = documents(spark, sf_dir, *[search.contains_terms([t]).alias(f"_{i}") for i, t in enumerate(TERMS)])
    row = held.agg(*[F.count_if(f"_{i}").alias(t) for i, t in enumerate(TERMS)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("n_docs")) for t in TERMS])))


def filter_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.observations_matching(observations(spark, sf_dir), "retry", "history", 1_680_000_000, 1_740_000_000)
    return found.select("id", "created_at_epoch")


def page_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(search.observations_matching(observations(spark, sf_dir), "index"), 50, 20).select("id", "created_at_epoch")


def id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_ids(observations(spark, sf_dir), range(1, 200)).select("id", "created_at_epoch")


def memory_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.match_all(observations(spark, sf_dir), "workers index", "id", {"title": 1.0, "content": 1.0}, k=20)


def session_match_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"title": 10.0, "content": 5.0, "file_path": 1.0}
    return ranking.match_all(documents(spark, sf_dir), "froz scan", "file_path", fields, prefix=True, k=20)


def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 100, among all."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return ranking.bm25(docs, docs.filter("doc_id % 100 = 0"), "doc_id", "text", 10).select("query", "key", F.round("score", 6).alias("score"))


def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each vector whose id is divisible by 100, among all."""
    rows = table(spark, sf_dir, "embeddings")
    return ranking.nearest(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10).select("query", "key", F.round("score", 6).alias("score"))


def hybrid_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and word ranks of the same queries fused by reciprocal ranks."""
    rows = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    vectors = ranking.nearest(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", 50)
    terms = ranking.bm25(docs, docs.filter("doc_id % 100 = 0"), "doc_id", "text", 50)
    return ranking.fuse(vectors, terms, 10).select("query", "key", F.round("rrf_score", 9).alias("rrf_score"))


def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours of documents whose id is divisible by 100 by their character vectors, among all."""
    docs = ranking.embed(table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", "text"), "text").select("doc_id", "embedding")
    return ranking.nearest(docs, docs.filter("doc_id % 100 = 0"), "doc_id", "embedding", 5).select("query", "key", F.round("score", 6).alias("score"))


def timeline_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir, "created_at_epoch")
    return memory.timeline(rows, rows.filter("id % 100 = 0"), 3, 3).select("anchor", "id", "created_at_epoch", "side")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).filter(search.contains_terms(["frozen"], ("content",)))
    return found.select("file_path", hit_snippet(F.col("content"), "frozen").alias("around"), clip_snippet(F.col("content"), "frozen").alias("clipped"))


def result_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best windows of the ten best documents."""
    found = search.search(documents(spark, sf_dir), QUERY, AS_OF)
    return search.with_snippets(found, TERMS).select("file_path", "score", "snippet")


def recall_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of several phrasings in turn, each document once in the first that has it."""
    number = search.first_phrasing([[t] for t in (*TERMS, "watcher")])
    return documents(spark, sf_dir, number.alias("query_no")).filter("query_no is not null")


def semantic_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory before sessions: where no observation holds the text, sessions answer."""
    word = "codex_session"
    notes = observations(spark, sf_dir, "title", F.contains("content", F.lit(word)).alias("held")).filter("held").select(F.lit("memory").alias("origin"), F.col("id").cast("string").alias("key"), "title")
    docs = documents(spark, sf_dir, "source_type", "title").filter(F.col("source_type") == word).select(F.lit("session").alias("origin"), F.col("file_path").alias("key"), "title")
    return search.semantic(notes, docs, None)


def prewarm_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document's title is for its machine, compared with the one before."""
    docs = documents(spark, sf_dir, "machine_id", "created_at_epoch", "title").filter("machine_id is not null")
    rows = prewarm.classify(docs.select("machine_id", "created_at_epoch", "file_path", F.coalesce("title", F.lit("")).alias("title")), "machine_id", "created_at_epoch", "title")
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def title_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, F.array_join(keywords(F.col("title"), STOP_WORDS), " ").alias("keywords")).filter("keywords is not null")


def newest_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest documents of each source."""
    found = topk.top_k(documents(spark, sf_dir, "source_type", "created_at_epoch"), ["source_type"], [F.desc("created_at_epoch"), F.col("file_path")], 5)
    return found.select("source_type", "file_path", "rank")


QUERIES = {
    "search_ranked": flagship, "search_like": like_candidates, "search_rank_all": rank_all, "session_prefix": session_prefix, "term_documents": term_documents,
    "observation_filter": filter_observations, "observation_page": page_observations, "observation_ids": id_list, "memory_match_all": memory_match_all,
    "session_match_prefix": session_match_prefix, "bm25_documents": bm25_documents, "vector_top": vector_top, "hybrid_fused": hybrid_fused, "embedded_texts": embedded_texts,
    "timeline_neighbours": timeline_neighbours, "snippets": snippets, "result_snippets": result_snippets, "recall_union": recall_union, "semantic_fallback": semantic_fallback,
    "prewarm_reasons": prewarm_reasons, "title_keywords": title_keywords, "newest_of_source": newest_of_source,
}

_T, _C, _P = (f"lower(coalesce({c}, ''))" for c in ("title", "content", "file_path"))


def any_of(term: str) -> str:
    return "(" + " or ".join(f"contains({f}, '{term}')" for f in (_T, _C, _P)) + ")"


def _score_sql(terms: list[str]) -> str:
    """The score in SQL, from the same weights."""
    weights = " ".join(f"when '{k}' then {v}" for k, v in SOURCE_WEIGHTS.items())
    parts = [f"(case source_type {weights} else 1 end)::double"]
    for t in (t.lower() for t in terms):
        size = max(4, len(t) ** 2)
        tf = f"least(100.0, (length({_C}) - length(replace({_C}, '{t}', ''))) / {len(t)}.0 * {math.sqrt(len(t))!r})"
        parts += [f"(case when {any_of(t)} then {size} + {tf} else 0 end)", f"(case when contains({_T}, '{t}') then {2 * size} else 0 end)"]
    parts.append(f"(case when {any_of(' '.join(t.lower() for t in terms))} then 50 else 0 end)")
    parts.append(f"greatest(0.0, 20.0 - 3.0 * log2(1.0 + greatest(0, {AS_OF} - coalesce(created_at_epoch, 0)) / 86400.0))")
    clean = {c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))" for c in ("title", "content")}
    path = f"{clean['title']} <> '' and {clean['title']} = {clean['content']} and contains({clean['content']}, '/') and not regexp_matches({clean['content']}, '[。，.:]')"
    hay = f"concat_ws(chr(10), {_T}, {_C}, {_P})"
    marks = " + ".join("contains({}, '{}')::int".format(hay, m.lower().replace("'", "''")) for m in SEARCH_NOISE)
    short = f"len(list_filter(list_transform(string_split({hay}, chr(10)), lambda x: trim(x)), lambda x: x <> '' and length(x) <= 40 and not contains(x, ' ') and length(x) - length(replace(x, '/', '')) < 2 and length(x) - length(replace(x, '-', '')) <= 3))"
    either = lambda *m: " or ".join(f"contains({hay}, '{x}')" for x in m)
    lost = [
        f"(case when {path} then 180 else 0 end)", f"least(120, 60 * ({marks}))", f"(case when {either('/skills/', 'skills-repo')} then 120 else 0 end)",
        f"(case when {either('guardian_truncated')} then 60 else 0 end)", f"(case when {either('chunk id:', 'wall time:')} then 120 else 0 end)", f"(case when {short} >= 8 then 200 else 0 end)",
        f"(case when {either('drwx', 'rwxr-xr-x')} or contains({hay}, chr(10) || 'total ') then 200 else 0 end)",
    ]
    return " + ".join(parts) + " - " + " - ".join(lost)


RANKED = f"""with {DOCS}, scored as (select *, {_score_sql(TERMS)} as s from docs where {' or '.join(any_of(t.lower()) for t in TERMS)}),
ranked as (select *, trunc(s)::bigint as score from scored where s > 0)"""
_WORDS = r"list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2)"


def _bm25_sql(k: int) -> str:
    return rf"""tokens as (select doc_id, unnest({_WORDS.format('text')}) as term from documents where text is not null),
index as (select doc_id, term, count(*) as tf from tokens group by all), lens as (select doc_id, count(*) as dl from tokens group by 1),
freq as (select term, count(*) as df from index group by 1), tot as (select count(*) as n, avg(dl) as mean from lens),
wanted as (select i.doc_id as query, i.term, df from index i join freq using (term) where i.doc_id % 100 = 0),
bm as (select query, i.doc_id as key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))), 9) as score
  from wanted join index i using (term) join lens using (doc_id), tot group by all),
bmk as (select *, row_number() over (partition by query order by score desc, key) as rank from bm where score > 0 qualify rank <= {k})"""


def _nearest_sql(k: int) -> str:
    return f"""e as (select vec_id, embedding::double[] as v, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as norm from embeddings),
near as (select q.vec_id as query, d.vec_id as key, round(list_dot_product(q.v, d.v) / (q.norm * d.norm + 1e-10), 9) as score from e q, e d where q.vec_id % 100 = 0),
neark as (select *, row_number() over (partition by query order by score desc, key) as rank from near where score > 0 qualify rank <= {k})"""


def _match_sql(base: str, rows: str, key: str, fields: dict[str, float], tokens: list[str], test: str, k: int) -> str:
    words = " union all ".join(f"select {key} as key, {w} as w, unnest({_WORDS.format(f)}) as word from {rows}" for f, w in fields.items())
    terms = ", ".join(f"'{t}'" for t in tokens)
    return f"""with {base}, words as ({words}), len as (select key, count(*) as dl from words group by 1), tot as (select count(*) as n, avg(dl) as mean from len),
hits as (select key, t as term, sum(w) as tf from words, (select unnest([{terms}]) as t) where {test} group by all),
freq as (select term, count(*) as df from hits group by 1),
found as (select key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 9) as score, count(*) as c
  from hits join freq using (term) join len using (key), tot group by key)
select key, score from found where c = {len(tokens)} order by score desc, key limit {k}"""



_HAN = "㐀-䶿一-鿿"
_STOPPED = ", ".join(f"'{w}'" for w in STOP_WORDS)
_KEYWORDS = rf"""k1 as (select *, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+') as runs from docs),
k2 as (select *, flatten(list_transform(runs, lambda r: case when regexp_matches(r, '[{_HAN}]') and length(r) > 1 then
  list_concat(list_filter(list_transform(range(1, greatest(length(regexp_replace(r, '[^{_HAN}]', '', 'g')) - 1, 1) + 1), lambda i: substr(regexp_replace(r, '[^{_HAN}]', '', 'g'), i, 2)), lambda p: length(p) = 2),
    [regexp_replace(r, '[^{_HAN}]', '', 'g'), regexp_replace(r, '[{_HAN}]', '', 'g')]) else [r] end)) as parts from k1),
k3 as (select *, list_filter(parts, lambda t, i: length(t) >= 2 and list_position(parts, t) = i and t not in ({_STOPPED})) as kept from k2),
kw as (select *, list_transform(list_sort(list_transform(kept, lambda t, i: {{'n': -length(t), 'i': i, 't': t}}))[1:6], lambda s: s.t) as words from k3)"""


SQL = {
    "search_ranked": f"{RANKED} select file_path, source_type, created_at_epoch, score from ranked order by score desc, created_at_epoch desc, file_path limit 10",
    "search_like": f"with {DOCS} select file_path, created_at_epoch from docs where {' or '.join(any_of(t.lower()) for t in TERMS)} order by created_at_epoch desc, file_path desc limit 200",
    "search_rank_all": f"{RANKED} select file_path, score from ranked",
    "session_prefix": f"with {DOCS} select file_path, session_id from docs where starts_with(lower(session_id), 'a3') order by created_at_epoch desc, file_path limit 1000",
    "term_documents": f"with {DOCS} " + " union all ".join(f"select '{t}' as term, count(*) filter ({any_of(t.lower())}) as n_docs from docs" for t in TERMS),
    "observation_filter": f"""with {OBS} select id, created_at_epoch from obs where (contains(lower(coalesce(title, '')), 'retry') or contains(lower(coalesce(content, '')), 'retry')
        or contains(lower(coalesce(tags_json, '')), 'retry')) and source_type = 'history' and created_at_epoch between 1680000000 and 1740000000""",
    "observation_page": f"""with {OBS} select id, created_at_epoch from obs where contains(lower(coalesce(title, '')), 'index') or contains(lower(coalesce(content, '')), 'index')
        or contains(lower(coalesce(tags_json, '')), 'index') order by created_at_epoch desc, id desc limit 50 offset 20""",
    "observation_ids": f"with {OBS} select id, created_at_epoch from obs where id between 1 and 199",
    "memory_match_all": _match_sql(OBS, "obs", "id", {"title": 1.0, "content": 1.0}, ["workers", "index"], "word = t", 20),
    "session_match_prefix": _match_sql(DOCS, "docs", "file_path", {"title": 10.0, "content": 5.0, "file_path": 1.0}, ["froz", "scan"], "starts_with(word, t)", 20),
    "bm25_documents": f"with {_bm25_sql(10)} select query, key, round(score, 6) as score from bmk",
    "vector_top": f"with {_nearest_sql(10)} select query, key, round(score, 6) as score from neark",
    "hybrid_fused": f"""with {_bm25_sql(50)}, {_nearest_sql(50)}, both_ as (select coalesce(a.query, b.query) as query, coalesce(a.key, b.key) as key, a.rank as ra, b.rank as rb
  from neark a full join bmk b on a.query = b.query and a.key = b.key),
known as (select coalesce(a.query, b.query) as query, a.query is not null as in_a, b.query is not null as in_b
  from (select distinct query from neark) a full join (select distinct query from bmk) b on a.query = b.query),
fused as (select query, key, round(case when in_a and in_b then 1.0::double / (60 + coalesce(ra, 9999)) + 1.0::double / (60 + coalesce(rb, 9999))
  when in_a then 1.0::double / (60 + coalesce(ra, 9999)) else 1.0::double / (60 + coalesce(rb, 9999)) end, 12) as s from both_ join known using (query))
select query, key, round(s, 9) as rrf_score from fused qualify row_number() over (partition by query order by s desc, key) <= 10""",
    "timeline_neighbours": f"""with {OBS}, anchors as (select id as anchor, created_at_epoch as t from obs where id % 100 = 0)
(select anchor, id, created_at_epoch, 'before' as side from anchors join obs on created_at_epoch <= t qualify row_number() over (partition by anchor order by created_at_epoch desc, id desc) <= 4)
union all (select anchor, id, created_at_epoch, 'after' as side from anchors join obs on created_at_epoch > t qualify row_number() over (partition by anchor order by created_at_epoch, id) <= 3)""",
    "snippets": f"""with {DOCS}, f as (select file_path, content, trim(content, ' ') as c, instr(lower(content), 'frozen') as i from docs where contains(lower(content), 'frozen')),
g as (select *, instr(lower(c), 'frozen') - 1 as hit, length(c) as n, least(length(c), instr(lower(c), 'frozen') - 1 + 6 + 90) as e from f)
select file_path, trim(substr(content, greatest(1, i - 120), i + 6 + 120 - greatest(1, i - 120)), ' ') as around,
  case when n <= 180 then c else (select substr(c, s + 1, e - s) from (select case when e - greatest(0, hit - 90) < 180 then greatest(0, e - 180) else greatest(0, hit - 90) end as s)) end as clipped from g""",
    "recall_union": f"with {DOCS}, hits as (" + " union all ".join(f"select file_path, {i} as query_no from docs where {any_of(t.lower())}" for i, t in enumerate((*TERMS, "watcher"))) + ") select file_path, min(query_no)::int as query_no from hits group by 1",
    "semantic_fallback": f"""with {DOCS}, {OBS}, m as (select 'memory' as origin, id::varchar as key, title from obs where contains(content, 'codex_session'))
select * from m union all select 'session', file_path, title from docs where source_type = 'codex_session' and not exists (select 1 from m)""",
    "newest_of_source": f"with {DOCS} select source_type, file_path, row_number() over (partition by source_type order by created_at_epoch desc, file_path)::int as rank from docs qualify rank <= 5",
    "title_keywords": f"with {DOCS}, {_KEYWORDS} select file_path, array_to_string(words, ' ') as keywords from kw where title is not null",
    "prewarm_reasons": rf"""with {DOCS.replace("select *", "select machine_id, created_at_epoch, file_path, updated_at_epoch, coalesce(title, '') as title")}, {_KEYWORDS},
c as (select *, lower(trim(regexp_replace(title, '[\s\x{{a0}}\x{{3000}}]+', ' ', 'g'), ' ')) as t from kw where machine_id is not null),
v as (select *, t = '' or (length(t) <= 24 and regexp_matches(t, '{prewarm.ACKNOWLEDGED}')) or (len(words) < 2 and length(t) < 12 and not regexp_matches(t, '{prewarm.CONTINUED}')) as trivial from c),
w as (select *, last_value(case when not trivial then {{'t': created_at_epoch, 'k': words}} end ignore nulls) over (partition by machine_id order by created_at_epoch nulls first, title
  rows between unbounded preceding and 1 preceding) as state from v),
x as (select *, case when state is not null and len(words) > 0 and len(state.k) > 0 then len(list_intersect(words, state.k))::double / len(list_distinct(list_concat(words, state.k))) else 0.0 end as overlap,
  coalesce(created_at_epoch - state.t < {prewarm.LASTS}, false) as recent from w),
y as (select case when trivial then 'trivial' when regexp_matches(t, '{prewarm.CONTINUED}') then 'continuation'
  when regexp_matches(t, '{prewarm.STRUCTURAL}') then case when recent and round(overlap, 9) >= {prewarm.SAME} then 'same-topic' else 'structural' end
  when state is null then 'cold-start' when recent and round(overlap, 9) >= {prewarm.SAME} then 'same-topic' when regexp_matches(title, '{prewarm.IDENTIFIER}') or round(overlap, 9) <= {prewarm.NEW} then 'new-topic'
  when not recent then 'stale-context' else 'same-topic' end as reason from x)
select reason, count(*) as n from y group by 1""",
    "embedded_texts": """with d as (select distinct doc_id, text from documents where text <> ''),
c as (select doc_id, ((unicode(ch) * 2654435761) % 4294967296) >> 7 & 255 as slot, count(*) as n from (select doc_id, unnest(string_split(text, '')) as ch from d) group by 1, 2),
v as (select doc_id, slot, (n / sqrt(sum(n * n) over (partition by doc_id)))::float::double as x from c),
z as (select doc_id, sqrt(sum(x * x)) as norm from v group by 1),
s as (select q.doc_id as query, d.doc_id as key, sum(q.x * d.x) as dot from v q join v d using (slot) where q.doc_id % 100 = 0 group by 1, 2),
r as (select query, key, round(dot / (a.norm * b.norm + 1e-10), 6) as score from s join z a on a.doc_id = query join z b on b.doc_id = key)
select query, key, score from r qualify row_number() over (partition by query order by score desc, key) <= 5""",
}
