"""Batched ranking: BM25, vectors, and their fusion by reciprocal ranks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.topk import top_k
from tracewell.session import pin

K1, B = 1.5, 0.75
RRF_K, MISSING_RANK = 60, 9999
#: Query vectors that are broadcast as one matrix; more go in further passes.
QUERY_BLOCK = 4096
#: Pairs of a query and a term that are broadcast at a time.
TERM_BLOCK = 500_000
#: Entries of a task's matrices; what adding up a product costs, as a multiple of a product within a matrix.
CELLS, DENSE = 2_000_000, 80


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script, in lower case, of two characters at least."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda t: F.length(t) >= 2)


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words) of all texts of each key, without those that have no word."""
    split = docs.select(F.col(key).alias("key"), words(F.col(text)).alias("words"))
    return split.groupBy("key").agg(F.flatten(F.collect_list("words")).alias("words")).filter(F.size("words") > 0)


def statistics(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df) and one row (n, mean length) of an index, over all its documents that have a word."""
    frequency = index.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return frequency, index.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean"))


def known_terms(queries: DataFrame, key: str, text: str, frequency: DataFrame) -> DataFrame:
    """(query, term, df): all distinct terms of each query text that some document has."""
    terms = queries.select(F.col(key).alias("query"), F.explode(F.array_distinct(words(F.col(text)))).alias("term")).distinct()
    return terms.join(frequency, "term").select("query", "term", "df")


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int = 10) -> DataFrame:
    """The k best documents of each query: query, key, score, rank. Queries are rows (key, text) too, and all their distinct terms count.

    Lucene's variant of BM25 with k1 1.5 and b 0.75. Queries are broadcast in blocks of QUERY_BLOCK queries or TERM_BLOCK
    terms, each block one pass over all documents: a sparse product for each chunk of documents, of which each task keeps
    k rows of a query. Work is the number of terms that queries and documents share, so it grows with both.
    """
    index = pin(tokens(docs, key, text), "tokens")  # used for statistics and by each block
    frequency, totals = statistics(index)
    wanted = pin(known_terms(queries, key, text, frequency), "query-terms")
    n, mean = totals.first()
    size = wanted.agg(F.countDistinct("query"), F.count(F.lit(1))).first()
    parts = max(-(-size[0] // QUERY_BLOCK), -(-size[1] // TERM_BLOCK), 1)
    if parts > 1:
        parts *= 2
    found = None
    kinds = queries.schema[key].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    for p in range(parts):
        block = wanted.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == p).toArrow()
        part = _bm25_block(index, block, n, mean or 1.0, kinds, k)
        found = part if found is None else found.unionByName(part)
    return top_k(found, ["query"], [F.desc("score"), F.col("key")], k)


def _bm25_block(index: DataFrame, block: pa.Table, n: int, mean: float, kinds: tuple[str, str], k: int) -> DataFrame:
    query = block.column("query").combine_chunks().dictionary_encode(null_encoding="encode")
    term = block.column("term").combine_chunks().dictionary_encode()
    names, vocabulary, asked = query.dictionary, term.dictionary, len(query.dictionary)
    q, t = np.asarray(query.indices, np.int64), np.asarray(term.indices, np.int64)
    df, qf = np.zeros(len(vocabulary)), np.bincount(t, minlength=len(vocabulary))
    df[t] = block.column("df").to_numpy()
    q = q[np.argsort(t, kind="stable")]  # the queries of each term, term after term
    start = np.cumsum(qf) - qf
    # terms that many queries and documents have are columns of a matrix; to add up the rest one by one is less work
    dense = np.flatnonzero(df * qf * DENSE > float(n) * asked)
    dense = dense[np.argsort(-(df * qf)[dense], kind="stable")][: CELLS // max(1, asked)]
    shared = index.sparkSession.sparkContext.broadcast((names, vocabulary, np.log(1 + (n - df + 0.5) / (df + 0.5)), q, qf, start, dense))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vocabulary, idf, q, qf, start, dense = shared.value
        terms = len(vocabulary)
        if not terms:
            return
        column = np.full(terms, -1)
        column[dense] = np.arange(len(dense))
        has = np.zeros((asked, len(dense)))
        for i, t in enumerate(dense):
            has[q[start[t] : start[t] + qf[t]], i] = 1
        step = max(1, CELLS // asked)
        least = np.zeros(asked)  # what a document must reach to be among the k best that the task has seen
        held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        size = 0

        def best() -> list[tuple[np.ndarray, pa.Array, np.ndarray]]:
            own, keys, score = np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held])
            by_key = np.empty(len(own), np.int64)
            by_key[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(own))
            order = np.lexsort((by_key, -score, own))
            place = np.arange(len(own)) - np.searchsorted(own[order], own[order])
            last = order[place == k - 1]
            least[own[last]] = score[last]
            order = order[place < k]
            return [(own[order], keys.take(pa.array(order)), score[order])]

        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            lengths = np.asarray(lists.value_lengths(), np.int64)
            values = lists.flatten()
            ids = pc.index_in(values, value_set=vocabulary.cast(values.type)).fill_null(-1).to_numpy()
            ends = np.concatenate([[0], np.cumsum(lengths)])
            for at in range(0, len(lengths), step):
                to = min(len(lengths), at + step)
                m = to - at
                d, t = np.repeat(np.arange(m), lengths[at:to]), ids[ends[at] : ends[to]]
                code, tf = np.unique(d[t >= 0] * terms + t[t >= 0], return_counts=True)
                d, t = code // terms, code % terms
                w = idf[t] * tf / (tf + K1 * (1 - B + B * lengths[at:to][d] / mean))
                wide = column[t] >= 0
                matrix = np.zeros((m, len(dense)))
                matrix[d[wide], column[t[wide]]] = w[wide]
                scores = has @ matrix.T
                d, t, w = d[~wide], t[~wide], w[~wide]
                sums = np.cumsum(qf[t])
                x = 0
                while x < len(t):
                    y = max(x + 1, int(np.searchsorted(sums, (sums[x - 1] if x else 0) + CELLS, side="right")))
                    times = qf[t[x:y]]
                    which = np.repeat(np.arange(x, y), times)
                    of = q[start[t[which]] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)]
                    scores += np.bincount(of * m + d[which], weights=w[which], minlength=asked * m).reshape(asked, m)
                    x = y
                scores = np.round(scores, 9)
                enough = np.maximum(least, np.partition(scores, m - k, axis=1)[:, m - k]) if m > k else least
                own, place = np.nonzero((scores > 0) & (scores >= enough[:, None]))
                held.append((own, keys.take(pa.array(place + at)), scores[own, place]))
                size += len(own)
                if size > max(CELLS, 2 * asked * k):
                    held[:] = best()
                    size = len(held[0][0])
        if held:
            [(own, keys, score)] = best()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), keys, pa.array(score)], names=["query", "key", "score"])

    return index.select("key", "words").mapInArrow(run, f"query {kinds[0]}, key {kinds[1]}, score double")


def match_all(docs: DataFrame, query: str, key: str, fields: dict[str, float], prefix: bool = False, k: int = 10) -> DataFrame:
    """Documents that hold all words of one query, best first: key, score. fields: weight of each column; a word of the query may be a prefix.

    A token of several words, as `foo-bar`, is a phrase: its words must follow each other. Frequencies are weighted by
    field before they saturate; document frequencies count over all documents. A query without words is an error;
    documents without words never match.
    """
    spoken = [tuple(re.findall(r"\w{2,}", t)) for t in query.lower().replace('"', " ").split()]
    tokens = list(dict.fromkeys(t for t in spoken if t))
    split = docs.select(F.col(key).alias("key"), *[words(F.col(f)).alias(f"_{i}") for i, f in enumerate(fields)])

    def begins(word: Column, t: str, last: bool) -> Column:
        return word.startswith(t) if prefix and last else word == F.lit(t)

    def weight(phrase: tuple[str, ...]) -> Column:
        def at(field: str, i: Column) -> Column:
            tests = [begins(F.get(field, i + n), t, n == len(phrase) - 1) for n, t in enumerate(phrase)]
            return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))

        def hits(field: str) -> Column:
            if len(phrase) == 1:
                return F.size(F.filter(field, lambda x: begins(x, phrase[0], True)))
            return F.size(F.filter(F.transform(field, lambda x, i: at(field, i)), lambda x: x))

        found = [w * hits(f"_{i}") for i, w in enumerate(fields.values())]
        return sum(found[1:], found[0])

    sizes = [F.size(f"_{i}") for i in range(len(fields))]
    # a query has few words: their frequencies are columns of one pass, and nothing is shuffled but the totals and the result
    rows = split.select("key", sum(sizes[1:], sizes[0]).alias("length"), F.array(*map(weight, tokens)).alias("tf")).filter("length > 0")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(tokens))]).alias("df"))
    found = rows.filter(F.forall("tf", lambda x: x > 0)).join(F.broadcast(totals), F.lit(True))  # a single row
    idf = [F.log(1 + (F.col("n") - F.col("df")[i] + 0.5) / (F.col("df")[i] + 0.5)) for i in range(len(tokens))]
    norm = 1.2 * (1 - B + B * F.col("length") / F.col("mean"))
    parts = [idf[i] * F.col("tf")[i] * (1.2 + 1) / (F.col("tf")[i] + norm) for i in range(len(tokens))]
    return found.select("key", F.round(sum(parts[1:], parts[0]), 9).alias("score")).orderBy(F.desc("score"), "key").limit(k)


def embed(df: DataFrame, text: str, out: str = "embedding", dim: int = 256) -> DataFrame:
    """Adds a vector of each text: its characters' counts, hashed to dim places, of length 1. Stands in for a static model, which is a parameter of a pipeline.

    Null and empty texts give a vector of zeros.
    """
    kept = df.drop(out)
    schema = kept.withColumn(out, F.lit(None).cast("array<float>")).schema
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, dim), np.float32)
            for i, t in enumerate(batch.column(place).to_pylist()):
                if t:
                    codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
                    rows[i] = np.bincount((codes * np.uint32(2654435761) >> np.uint32(7)) % dim, minlength=dim)
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            rows /= np.where(norms > 0, norms, 1)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, dim), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """The k vectors of highest cosine with each query, exactly: query, key, score, rank; positive cosines only.

    Query vectors are broadcast in blocks of QUERY_BLOCK, each block one pass over all vectors: a product of matrices for
    each batch, of which k rows of a query go on. Vectors of another dimension than the query's, and null ones, never match.
    """
    rows = queries.filter(F.col(vector).isNotNull()).select(key, vector)
    n = rows.count()
    if n > QUERY_BLOCK:
        parts = -(-n // QUERY_BLOCK) * 2
        blocks = [rows.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == p) for p in range(parts)]
    else:
        blocks = [rows]
    found = None
    kind = vectors.schema[key].dataType.simpleString()
    for block in blocks:
        part, shared = _nearest_block(vectors.filter(F.col(vector).isNotNull()).select(key, vector), block.collect(), kind, k)
        if len(blocks) > 1:  # a block's vectors are let go of before the next ones come
            part = pin(part, "nearest")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return top_k(found.withColumn("score", F.round("score", 9)), ["query"], [F.desc("score"), F.col("key")], k)


def _nearest_block(vectors: DataFrame, block: list, kind: str, k: int) -> tuple[DataFrame, Broadcast]:
    keys = [r[0] for r in block]
    shared = vectors.sparkSession.sparkContext.broadcast((keys, [np.asarray(r[1], np.float64) for r in block]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted = shared.value
        dims = {len(q) for q in wanted}
        for batch in batches:
            own = batch.column(0)
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths())
            out_q, out_i, out_s = [], [], []
            for dim in dims:
                at = np.flatnonzero(sizes == dim)
                if not len(at) or not dim:
                    continue
                m = np.asarray(lists.take(pa.array(at)).flatten(), np.float64).reshape(len(at), dim)
                which = [i for i, q in enumerate(wanted) if len(q) == dim]
                q = np.stack([wanted[i] for i in which])
                scores = q @ m.T / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :] + 1e-10)
                least = np.partition(scores, len(at) - k - 8, axis=1)[:, len(at) - k - 8] if len(at) > k + 8 else np.full(len(which), -np.inf)
                for row, i in enumerate(which):
                    chosen = np.flatnonzero(scores[row] >= least[row])  # with all ties
                    s = scores[row, chosen]
                    good = s > 0
                    out_q += [names[i]] * int(good.sum())
                    out_i.append(at[chosen[good]])
                    out_s.append(s[good])
            index = pa.array(np.concatenate(out_i) if out_i else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_q, own.type), own.take(index), pa.array(np.concatenate(out_s) if out_s else np.zeros(0))], names=["query", "key", "score"]
            )

    return vectors.mapInArrow(run, f"query {kind}, key {kind}, score double"), shared


def fuse(one: DataFrame, two: DataFrame, k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query, key, rank): query, key, rrf_score, rank. Absent ones count as rank 9999; a query that only one list knows is ranked by that one."""
    a, b = one.select("query", "key", F.col("rank").alias("_a")), two.select("query", "key", F.col("rank").alias("_b"))
    both = a.join(b, ["query", "key"], "full")
    known = a.select("query").distinct().withColumn("_in_a", F.lit(True)).join(b.select("query").distinct().withColumn("_in_b", F.lit(True)), "query", "full")
    part = {c: 1.0 / (rrf_k + F.coalesce(F.col(c), F.lit(MISSING_RANK))) for c in ("_a", "_b")}
    total = F.when(F.col("_in_a") & F.col("_in_b"), part["_a"] + part["_b"]).when(F.col("_in_a"), part["_a"]).otherwise(part["_b"])
    scored = both.join(known, "query").select("query", "key", F.round(total, 12).alias("rrf_score"))
    return top_k(scored, ["query"], [F.desc("rrf_score"), F.col("key")], k)
