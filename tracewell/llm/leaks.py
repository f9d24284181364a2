"""Passages of evaluation items that occur in training texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracewell.llm.words import WORD, words
from tracewell.session import pin

#: Consecutive words that make a leak; n-grams of evaluation items up to which their set is broadcast.
LENGTH, BROADCAST_NGRAMS = 8, 2_000_000
#: Tasks over which the documents of one n-gram are spread.
SALTS = 16


def item_ngrams(items: DataFrame, item: str, passages: list[str], length: int = LENGTH) -> DataFrame:
    """The distinct n-grams of each item's passages: item, ngram (words joined by a space). Null and shorter passages have none."""
    kind = items.schema[item].dataType
    schema = T.StructType([T.StructField("item", kind), T.StructField("ngram", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple] = set()
            for key, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for text in texts:
                    w = words(text)
                    out.update((key, " ".join(w[i : i + length])) for i in range(len(w) - length + 1))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field(0).type), pa.array(b, pa.string())], names=["item", "ngram"])

    return items.select(item, *passages).filter(F.col(item).isNotNull()).mapInArrow(run, schema).distinct()


class NgramScanner:
    """Finds the windows of a text whose words are an n-gram of the set. Windows with a word of no n-gram are passed over at once."""

    def __init__(self, ngrams: list[str], length: int) -> None:
        self.length = length
        self.set = set(ngrams)
        self.known = {w for g in self.set for w in g.split(" ")}

    def hits(self, text: str) -> list[tuple[str, int, int]]:
        """Each hit with the place of its first and after its last character in the lower-cased text."""
        found, known, length = [], self.known, self.length
        low = text.lower()
        w = WORD.findall(low)
        if len(w) < length or known.isdisjoint(w):
            return found
        run, places = 0, None
        for i, word in enumerate(w):
            run = run + 1 if word in known else 0
            if run >= length:
                gram = " ".join(w[i - length + 1 : i + 1])
                if gram in self.set:
                    if places is None:
                        places = [m.span() for m in WORD.finditer(low)]
                    found.append((gram, places[i - length + 1][0], places[i][1]))
        return found


HITS = "array<struct<ngram:string,start:int,end:int>>"


def _scan(df: DataFrame, text: str, wanted: list[str], length: int) -> DataFrame:
    """Adds column _hits: the wanted n-grams, a broadcast set of bounded size, that occur in text, with their places. Null texts have none."""
    shared = df.sparkSession.sparkContext.broadcast(wanted)
    kept = df.drop("_hits")
    schema = kept.withColumn("_hits", F.lit(None).cast(HITS)).schema
    place = kept.columns.index(text)
    kind = pa.list_(pa.struct([("ngram", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = NgramScanner(shared.value, length)
        for batch in batches:
            hits = [[{"ngram": g, "start": a, "end": b} for g, a, b in scanner.hits(t)] if t else [] for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], names=[*batch.schema.names, "_hits"])

    return kept.mapInArrow(run, schema)


def _windows(df: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """All windows of all texts as rows (_key, ngram), for a set of n-grams that is too large to broadcast."""
    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("ngram", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, grams = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(t)
                own = {" ".join(w[i : i + length]) for i in range(len(w) - length + 1)}
                keys += [k] * len(own)
                grams += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(grams, pa.string())], names=["_key", "ngram"])

    return df.select(key, text).mapInArrow(run, schema)


def _met(windows: DataFrame, grams: DataFrame) -> DataFrame:
    """Windows with the rows of their n-gram. A passage that a third of all documents have is spread over SALTS tasks."""
    salted = grams.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return windows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).join(salted, ["ngram", "_salt"]).drop("_salt")


def find_leaks(
    df: DataFrame, key: str, text: str, items: DataFrame, item: str, passages: list[str], length: int = LENGTH, broadcast_ngrams: int = BROADCAST_NGRAMS
) -> DataFrame:
    """Each document with each item of which it contains at least `length` consecutive words: key, item.

    Words are compared in lower case without what stands between them. A document is named once for an item, however
    often or in how many rows it has its words; null and shorter texts and passages have no case, and rows with a null
    key are left out. The items' n-grams are broadcast with the items that have them; if there are more than
    broadcast_ngrams, documents meet them in a join on the n-gram instead.
    """
    docs = df.select(key, text).filter(F.col(text).isNotNull() & F.col(key).isNotNull())
    grams = pin(item_ngrams(items, item, passages, length), "leak-ngrams")
    if grams.count() > broadcast_ngrams:
        return _met(_windows(docs, key, text, length), grams).select(F.col("_key").alias(key), F.col("item").alias(item)).distinct()
    owners = defaultdict(list)
    for owner, gram in grams.collect():
        owners[gram].append(owner)
    shared = df.sparkSession.sparkContext.broadcast(dict(owners))
    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("_item", items.schema[item].dataType)])
    kind = to_arrow_type(items.schema[item].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = NgramScanner(list(shared.value), length)
        for batch in batches:
            found: dict[tuple, None] = {}
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update(((k, owner), None) for gram, *_ in scanner.hits(t) for owner in shared.value[gram])
            keys, owned = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(owned, kind)], names=["_key", "_item"])

    return docs.mapInArrow(run, schema).select(F.col("_key").alias(key), F.col("_item").alias(item)).distinct()


def remove_leaks(
    df: DataFrame, text: str, items: DataFrame, item: str, passages: list[str], length: int = LENGTH, broadcast_ngrams: int = BROADCAST_NGRAMS
) -> DataFrame:
    """df with every leaked window taken out of text, and whether anything was in column `leaked`; null texts stay null.

    What surrounds a removed stretch is kept as it is. If the items have more than broadcast_ngrams n-grams, distinct
    texts meet them in a join, and rows get their text's hits by its hash.
    """
    grams = pin(item_ngrams(items, item, passages, length).select("ngram").distinct(), "leak-ngrams")
    kept = df.drop("leaked")
    place, schema = kept.columns.index(text), kept.withColumn("leaked", F.lit(True)).schema
    if grams.count() > broadcast_ngrams:
        mark = F.when(F.col(text).isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")))
        texts = kept.select(mark.alias("_mark"), F.col(text).alias("_text")).filter("_mark is not null").dropDuplicates(["_mark"])
        hits = _met(_windows(texts, "_mark", "_text", length), grams).groupBy("_key").agg(F.collect_set("ngram").alias("_grams"))
        joined = kept.withColumn("_mark", mark).join(hits.withColumnRenamed("_key", "_mark"), "_mark", "left")
        found = joined.select(*kept.columns, F.transform("_grams", lambda g: F.struct(g.alias("ngram"))).alias("_hits"))
    else:
        found = _scan(kept, text, [r[0] for r in grams.collect()], length)

    def cut(value: str | None, hits: list[dict] | None) -> str | None:
        if not hits:
            return value
        if "start" not in hits[0] or len(value.lower()) != len(value):  # lower-casing may lengthen a few letters: then places don't hold
            return _cut_by_words(value, {h["ngram"] for h in hits}, length)
        out, at = [], 0
        for h in hits:
            if h["start"] > at:
                out.append(value[at : h["start"]])
            at = max(at, h["end"])
        return "".join(out) + value[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, hits = batch.columns
            hits = hits.to_pylist()
            columns[place] = pa.array(map(cut, columns[place].to_pylist(), hits), pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bool(h) for h in hits])], names=[*batch.schema.names[:-1], "leaked"])

    return found.mapInArrow(run, schema)


def _cut_by_words(value: str, grams: set[str], length: int) -> str:
    spans = [m.span() for m in WORD.finditer(value)]
    low = [value[a:b].lower() for a, b in spans]
    out, at = [], 0
    for i in range(len(low) - length + 1):
        if " ".join(low[i : i + length]) in grams:
            if spans[i][0] > at:
                out.append(value[at : spans[i][0]])
            at = max(at, spans[i + length - 1][1])
    return "".join(out) + value[at:]
