"""Personal information in free text: candidate spans, scored by boosted trees, and redaction with typed placeholders."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.lookup import Asked, by_chunks
from tracewell.llm.mentions import FEATURES, KINDS, Generator, Survey
from tracewell.session import pin, spread

#: Trees, their depth, and parts of the labelled candidates, each scored by trees of the other parts to find the thresholds.
TREES, DEPTH, FOLDS = 12, 4, 2
#: Different feature vectors in a task of a fit; up to that many, sums come in the same order in every run.
FIT_ROWS = 250_000
#: Words that the model of names has if it is broadcast whole; beyond, each chunk of texts gets the part that it asks for.
NAME_WORDS = 400_000
FLUSH = 200_000
#: A family name goes with so many listed given names at least, to tell that another word is a given name.
SURE_FAMILY = 3


def _survey(records: DataFrame) -> DataFrame:
    """(kind, a, b, n): words in lower case (0) and pairs of possible family and given names (1), counted over all texts; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        survey = Survey()

        def flush() -> pa.RecordBatch:
            a = [*survey.lower, *(f for f, _ in survey.pairs)]
            b = [""] * len(survey.lower) + [g for _, g in survey.pairs]
            kinds = [0] * len(survey.lower) + [1] * len(survey.pairs)
            n = [*survey.lower.values(), *survey.pairs.values()]
            survey.lower.clear()
            survey.pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], names=["kind", "a", "b", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    survey.add(text)
            if len(survey.lower) + len(survey.pairs) > FLUSH:
                yield flush()
        yield flush()

    return records.select("content").mapInArrow(run, "kind int, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def learn_names(records: DataFrame, given_names: DataFrame) -> tuple[set[str], DataFrame]:
    """Listed given names, and what the texts tell of words: (ask, item, a, b).

    ask is a digit and the word: 0 and a family name (with a listed given names, b times), 1 and a further given name (with
    a such families), 2 and such a word in lower case (a times). Counted over all texts. The list of given names is a
    table of its own, of fixed size.
    """
    listed = given_names.select(F.initcap(F.col("given_name")).alias("b")).filter("b is not null").distinct()
    counts = pin(_survey(records), "name-counts")
    pairs = counts.filter("kind = 1").select(F.col("a").alias("family"), F.col("b").alias("given"), "n")
    families = pairs.join(listed.withColumnRenamed("b", "given"), "given").groupBy("family")
    families = pin(families.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total")), "families")
    givens = pairs.drop("n").join(families.filter(F.col("n") >= SURE_FAMILY), "family").groupBy("given").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    givens = pin(givens, "givens")
    words = families.select(F.lower("family").alias("a")).union(givens.select(F.lower("given"))).distinct()
    lower = counts.filter("kind = 0").join(words, "a").select("a", "n")
    table = [families.select(F.lit("0"), "family", "n", "total"), givens.select(F.lit("1"), "given", "n", F.lit(0).cast("bigint")), lower.select(F.lit("2"), "a", "n", F.lit(0).cast("bigint"))]
    every = table[0].union(table[1]).union(table[2]).toDF("kind", "item", "a", "b")
    return {r[0] for r in listed.collect()}, pin(every.select(F.concat("kind", "item").alias("ask"), "item", "a", "b"), "names")


CANDIDATES = "table_name string, key string, a int, b int, kind string, value string, features array<double>"


def _generator(listed: set[str], found: list[tuple]) -> Generator:
    tables: tuple[dict, dict, dict] = ({}, {}, {})
    for item, a, b, ask in found:
        kind = int(ask[0])
        tables[kind][item] = a if kind else (a, b)
    return Generator(listed, *tables)


def candidates(records: DataFrame, listed: set[str], names: DataFrame, entries: int = NAME_WORDS) -> DataFrame:
    """Spans that may be mentions, with their features; those of repeated rows once. names of more entries are not broadcast: chunks of texts get what they ask for, with the same result."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64())]
    columns = [c.split()[0] for c in CANDIDATES.split(", ")]

    def spans(generate: Generator, rows: pa.RecordBatch | pa.Table) -> list[pa.Array]:
        out = []
        for table, key, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            out += [(table, key, a, b, kind, text[a:b], f) for a, b, kind, f in generate(text)]
        data = list(zip(*out, strict=True)) or [()] * len(kinds)
        return [pa.array(c, k) for c, k in zip(data, kinds, strict=True)]

    rows = records.select("table_name", "key", "content").filter("content is not null and key is not null")
    if names.count() <= entries:
        shared = records.sparkSession.sparkContext.broadcast([tuple(r) for r in names.select("item", "a", "b", "ask").collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            generate = _generator(listed, shared.value)
            for batch in batches:
                yield pa.RecordBatch.from_arrays(spans(generate, batch), names=columns)

        found = rows.mapInArrow(run, CANDIDATES)
    else:

        def asks():
            tables = Asked((1, 1)), Asked(1), Asked(1)
            generate = Generator(listed, *tables)

            def of(text: str) -> set[str]:
                for t in tables:
                    t.keys_asked.clear()
                generate(text)
                return {f"{k}{word}" for k, t in enumerate(tables) for word in t.keys_asked}

            return of

        def work(part: pa.Table, entries: list[tuple]) -> pa.Table:
            return pa.table(spans(_generator(listed, entries), part), names=columns)

        found = by_chunks(rows, "content", asks, names, work, CANDIDATES)
    return found.dropDuplicates(["table_name", "key", "a", "b", "kind"])


def _is(name: str) -> Column:
    return F.col("features")[FEATURES.index(name)]


def label() -> Column:
    """Labels that are sure for some candidates and null for the rest: what the trees learn from. Context decides numbers, co-occurrence decides names."""
    on = {f: _is(f) > 0 for f in FEATURES}
    email = F.when(on["local_git"] | on["numeric_domain"] | on["file_end"] | ~on["form"], 0).when(~on["next_colon"], 1)
    number = F.when(~on["form"] | on["cue_not"], 0).when(on["cue"] | on["plus"] | on["alone"], 1)
    plain = _is("lower_family") < F.log1p(F.lit(3.0))
    known = on["listed"] | (_is("givens") > F.log1p(F.lit(8.0)))
    told = on["cue"] | on["title"] | on["next_cue"]
    shared = (_is("families") > F.log1p(F.lit(1.5))) & (_is("repeats") < F.log1p(F.lit(10.0)))
    name = (
        F.when((_is("middle") == 2) | (on["mixed"] & ~on["title"]) | on["family_given"] | ~plain, 0)
        .when(known & (shared | told), 1)
        .when(on["initial"] & shared & told, 1)
        .when(~shared & ~told, 0)
        .when(~(known | on["initial"] | on["title"]), 0)
    )
    # two of a word before, an end behind and a capital letter tell an address where nothing speaks against it; a number and a street word in running text are none
    signs = sum((F.when(on[f], 1).otherwise(0) for f in ("cue", "next_cue", "capital")), F.lit(0))
    address = F.when((signs > 1) & ~on["cue_not"], 1).when((on["cue_not"] | on["runs_on"]) & ~on["capital"] & ~on["cue"], 0)
    kind = F.col("kind")
    return F.when(kind == "email", email).when(kind.isin("phone", "id_number"), number).when(kind == "address", address).when(kind == "name", name).cast("double")


class Scorer:
    """Boosted trees over the features of all labelled candidates, with a threshold for each kind.

    Candidates with equal features are one row with their number as weight, so that a fit takes all of them. Thresholds
    come from all of them too: each part is scored by trees that are fitted on the other parts.
    """

    def __init__(self, found: DataFrame) -> None:
        part = F.pmod(F.xxhash64("value", "kind", "table_name", "key", "a"), F.lit(FOLDS))
        parts = [f"n{i}" for i in range(FOLDS)]
        labelled = found.withColumn("label", label()).filter("label is not null").groupBy("kind", "features", "label")
        rows = pin(labelled.agg(*[F.sum(F.when(part == i, 1.0).otherwise(0.0)).alias(n) for i, n in enumerate(parts)]), "labelled-mentions")
        seen = [r.asDict() for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(n).alias(n) for n in parts]).collect()]
        size = sum(r["rows"] for r in seen)
        rows = rows.repartition(1 + size // FIT_ROWS, "features").sortWithinPartitions("features")
        vectors = rows.withColumn("x", array_to_vector("features")).cache()
        # the engine takes split points from a sample where rows are more than the square of maxBins and 10,000: never here
        bins = max(32, math.isqrt(size) + 1)

        def fit(own: list[str]) -> GBTClassificationModel | None:
            if sum(any(r[n] for n in own) for r in seen) < 2:
                return None
            trees = GBTClassifier(featuresCol="x", labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, maxBins=bins, stepSize=0.3, seed=7, cacheNodeIds=False)
            return trees.fit(vectors.withColumn("n", sum(map(F.col, own), F.lit(0.0))).filter("n > 0"))

        with ThreadPool(FOLDS + 1) as pool:
            self.model, *others = pool.map(inheritable_thread_target(found.sparkSession)(fit), [parts, *([x for x in parts if x != n] for n in parts)])
        scored = [m.transform(vectors.withColumn("n", F.col(n)).filter("n > 0")).select("kind", vector_to_array("probability")[1].alias("p"), "label", "n") for n, m in zip(parts, others, strict=True) if m]
        self.thresholds = dict.fromkeys(KINDS, 0.5) | (self.best(reduce(DataFrame.union, scored)) if scored else {})
        vectors.unpersist()

    @staticmethod
    def best(scored: DataFrame) -> dict[str, float]:
        """For each kind the middle of the gap at which the F measure is highest, the upper of equal ones; none for kinds whose labels are all the same. scored: (kind, p, label, n)."""
        points = scored.groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("hits"))
        down, whole = Window.partitionBy("kind").orderBy(F.desc("p")), Window.partitionBy("kind")
        points = points.select(
            "kind", "p", F.lead("p", 1, 0.0).over(down).alias("below"), F.sum("n").over(down).alias("above"), F.sum("hits").over(down).alias("right"),
            F.sum("n").over(whole).alias("every"), F.sum("hits").over(whole).alias("total"),
        ).filter("below < p and 0 < right and total < every")
        measured = points.select("kind", F.struct((2 * F.col("right") / (F.col("above") + F.col("total"))).alias("f"), "p", ((F.col("p") + F.col("below")) / 2).alias("at")).alias("point"))
        return {r["kind"]: r["at"] for r in measured.groupBy("kind").agg(F.max("point")["at"].alias("at")).collect()}

    def keep(self, found: DataFrame) -> DataFrame:
        """found with score p, without what is below its kind's threshold."""
        if self.model is None:
            return found.withColumn("p", F.coalesce(label(), F.lit(0.0))).filter("p > 0.5")
        scored = self.model.transform(found.withColumn("x", array_to_vector("features")))
        scored = scored.withColumn("p", vector_to_array("probability")[1])
        limit = F.create_map(*[F.lit(v) for pair in self.thresholds.items() for v in pair])[F.col("kind")]
        return scored.filter(F.col("p") >= limit).select(*found.columns, "p")


def _choose(scored: DataFrame) -> DataFrame:
    """Of overlapping spans of a text the likeliest stays, of equal ones the longest; a number whose context names another kind that it may be comes last."""
    other = ((_is("cue_other") > 0) & (_is("cue") == 0)).alias("other")
    spans = scored.groupBy("table_name", "key").agg(F.collect_list(F.struct("p", "a", "b", "kind", "value", other)).alias("spans"))
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(2).to_pylist():
                kept: list[dict] = []
                for s in sorted(found, key=lambda s: (s["other"], -round(s["p"], 2), s["a"] - s["b"], s["a"], s["kind"])):
                    if all(s["b"] <= k["a"] or k["b"] <= s["a"] for k in kept):
                        kept.append({x: s[x] for x in ("a", "b", "kind", "value")})
                out.append(sorted(kept, key=lambda s: s["a"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["table_name", "key", "spans"])

    return spans.mapInArrow(run, "table_name string, key string, spans array<struct<a:int,b:int,kind:string,value:string>>")


def find_personal(records: DataFrame, given_names: DataFrame, entries: int = NAME_WORDS) -> DataFrame:
    """The mentions of each record: table_name, key, spans (place, kind and value, in order, not overlapping).

    records: (table_name, key, content). Candidates of all texts are scored by trees that are fitted on all labelled
    ones; statistics of names are counted over all texts. Records with a null key or content, and those
    without a mention, have no row; repeated rows count once. Empty tables give none. entries decides how the statistics
    of names reach the texts (see candidates()), not the result.
    """
    records = spread(records)
    found = pin(candidates(records, *learn_names(records, given_names), entries), "mentions")
    return _choose(Scorer(found).keep(found))


def redact(records: DataFrame, spans: DataFrame) -> DataFrame:
    """records with each mention replaced by its kind in brackets, as [EMAIL]; everything else stays. Null contents stay null."""
    joined = records.join(spans, ["table_name", "key"], "left")
    schema = joined.drop("spans").schema
    place, last = joined.columns.index("content"), joined.columns.index("spans")

    def cut(text: str | None, found: list[dict] | None) -> str | None:
        for s in reversed(found or []):
            if text is not None and text[s["a"] : s["b"]] == s["value"]:
                text = f"{text[: s['a']]}[{s['kind'].upper()}]{text[s['b'] :]}"
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array(map(cut, columns[place].to_pylist(), columns[last].to_pylist()), pa.string())
            del columns[last]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema)
