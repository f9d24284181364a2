"""Lines repeated across the documents of one source: found with sparse bitmaps, and removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import pin

#: Lines with fewer letters never count; a line counts from this share and this number of its source's documents.
MIN_LETTERS, MIN_SHARE, MIN_DOCUMENTS = 12, 0.05, 4


def letters(line: Column) -> Column:
    """The letters of a line alone, in lower case: variants of a line that differ in anything else share them."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def _lines(df: DataFrame, content: str) -> DataFrame:
    """One row for each line with enough letters: the given columns besides content, _line_no, _line and the key of its letters (128 bits)."""
    rest = [c for c in df.columns if c != content]
    lines = df.select(*rest, F.posexplode(F.split(content, "\n", -1)).alias("_i", "_line"))
    lines = lines.select(*rest, (F.col("_i") + 1).alias("_line_no"), "_line", letters(F.col("_line")).alias("_letters"))
    lines = lines.filter(F.length("_letters") >= MIN_LETTERS)
    return lines.withColumns({"_k1": F.xxhash64("_letters"), "_k2": F.xxhash64(F.lit(7), "_letters")}).drop("_letters")


def _rows(df: DataFrame, key: str, source: str, content: str) -> DataFrame:
    rows = df.select(F.col(key).alias("_key"), F.xxhash64(source).alias("_src"), F.col(source).alias("_source"), F.col(content).alias("_content"))
    return rows.filter(F.col("_content").isNotNull() & F.col("_source").isNotNull() & F.col("_key").isNotNull()).drop("_source")


def number_documents(df: DataFrame, key: str, source: str, content: str) -> DataFrame:
    """Numbers each source's documents from 0 without gaps: _key, _src, _doc. Written once, as later steps must see the same numbers.

    Documents are numbered within hashed parts of their source, and each part begins where the parts before it end, so
    that a source with a third of all documents is many tasks.
    """
    parts = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = _rows(df, key, source, content).select("_key", "_src").distinct()
    docs = docs.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(parts)).cast("int"))
    docs = pin(docs.withColumn("_n", F.row_number().over(Window.partitionBy("_src", "_part").orderBy("_key"))), "line-parts")
    sizes = docs.groupBy("_src", "_part").agg(F.count(F.lit(1)).alias("_size"))  # a row for each part of a source
    before = F.sum("_size").over(Window.partitionBy("_src").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_src", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return pin(docs.join(sizes, ["_src", "_part"]).select("_key", "_src", (F.col("_before") + F.col("_n") - 1).alias("_doc")), "line-documents")


def repeated_lines(
    df: DataFrame,
    numbers: DataFrame,
    key: str,
    source: str,
    content: str,
    min_share: float = MIN_SHARE,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """The lines repeated excessively within a source, as bitmaps: _src, _k1, _k2, _word, _bits, n_docs.

    Each written form of a line has a bitmap of its source's documents, compressed to its non-zero words of 64 bits. The
    bitmaps of forms with the same letters are united, and the line stays if the united bitmap's exact cardinality reaches
    min_documents and min_share of the source's documents. Only lines that stand in so many rows, which is as many as
    they have documents or more, get bitmaps; contents stay where they are read. Every step is an aggregation with a
    map-side part on keys that hold the word's number, so that neither a line that stands in a third of all documents nor
    a source that has a third of all documents meets in one task. Setting a bit twice changes nothing: repeated rows
    count once.
    """
    line = ["_src", "_k1", "_k2"]
    lines = _lines(_rows(df, key, source, content), "_content")
    totals = numbers.groupBy("_src").agg(F.count(F.lit(1)).alias("_total"))
    often = lines.groupBy(*line).agg(F.count(F.lit(1)).alias("_times")).filter(F.col("_times") >= min_documents).join(totals, "_src")
    often = pin(often.filter(F.col("_times") >= F.col("_total") * min_share).select(*line), "line-candidates")
    bit = F.expr("shiftleft(1L, cast(_doc & 63 as int))")
    forms = (
        lines.join(often, line)
        .select("_key", *line, F.xxhash64("_line").alias("_form"))
        .join(numbers, ["_key", "_src"])
        .select(*line, "_form", F.shiftright("_doc", 6).alias("_word"), bit.alias("_bits"))
        .groupBy(*line, "_form", "_word")
        .agg(F.bit_or("_bits").alias("_bits"))
    )
    united = forms.groupBy(*line, "_word").agg(F.bit_or("_bits").alias("_bits"))
    sizes = united.groupBy(*line).agg(F.sum(F.bit_count("_bits")).alias("n_docs"))
    heavy = sizes.filter(F.col("n_docs") >= min_documents).join(totals, "_src")
    heavy = heavy.filter(F.col("n_docs") >= F.col("_total") * min_share).drop("_total")
    return pin(united.join(heavy, line), "line-bitmaps")


def find_repeated(df: DataFrame, key: str, source: str, content: str, min_share: float = MIN_SHARE, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Each line of each document that is repeated excessively in the document's source: key, line_no (from 1), _line, n_docs.

    A document's rows are looked up in the bitmaps that repeated_lines() wrote. Rows with a null key, source or content
    have no cases; an empty table gives none. Other columns, whatever their names, are not looked at. The number of
    repeated lines of a source is at most lines per document / min_share; they are read back as a table, so that their
    size decides whether they are broadcast.
    """
    numbers = number_documents(df, key, source, content)
    bitmaps = repeated_lines(df, numbers, key, source, content, min_share, min_documents)
    line = ["_src", "_k1", "_k2"]
    heavy = pin(bitmaps.select(*line, "n_docs").distinct(), "line-heavy")
    marked = _lines(_rows(df, key, source, content), "_content").join(heavy, line)
    marked = marked.join(numbers, ["_key", "_src"]).withColumn("_word", F.shiftright("_doc", 6))
    marked = marked.join(bitmaps.select(*line, "_word", "_bits"), [*line, "_word"])
    marked = marked.filter(F.expr("shiftright(_bits, cast(_doc & 63 as int)) & 1 = 1"))
    return marked.select(F.col("_key").alias(key), F.col("_line_no").cast("int").alias("line_no"), "_line", "n_docs").distinct()


def remove_repeated(df: DataFrame, key: str, source: str, content: str, found: DataFrame) -> DataFrame:
    """df with the lines in `found` (of find_repeated) taken out of content; the other lines and columns stay as they are.

    A document whose lines are all repeated gets an empty content; null contents stay null.
    """
    gone = found.groupBy(F.col(key).alias("_gone_key")).agg(F.collect_set(F.struct("line_no", "_line")).alias("_gone"))
    joined = df.join(gone, df[key] == gone["_gone_key"], "left")
    kept = F.filter(
        F.split(F.col(content), "\n", -1),
        lambda x, i: ~F.coalesce(F.array_contains("_gone", F.struct((i + 1).cast("int").alias("line_no"), x.alias("_line"))), F.lit(False)),
    )
    cleaned = F.when(F.col("_gone_key").isNull(), F.col(content)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(content, cleaned).drop("_gone_key", "_gone")
