"""Texts that meet a table of any size: the entries that a chunk of rows asks for are joined to it, and the chunk is worked on with these alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.session import pin

#: Bytes of text of a chunk.
CHUNK_BYTES = 16_000_000


class Asked(dict):
    """A table that notes what is looked up in it and answers with one value, so that code shows what it needs by running."""

    def __init__(self, answer: object) -> None:
        super().__init__()
        self.answer, self.keys_asked = answer, set()

    def get(self, key: object, default: object = None) -> object:
        self.keys_asked.add(key)
        return self.answer

    def __contains__(self, key: object) -> bool:
        self.keys_asked.add(key)
        return True


def by_chunks(
    rows: DataFrame, text: str, asks: Callable[[], Callable[[str], set[str]]], table: DataFrame, work: Callable[[pa.Table, list[tuple]], pa.Table], schema: T.StructType, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """work(rows of a chunk, entries) of all chunks.

    asks() gives the function that tells what a text asks for; table is (ask, item, a, b), and entries are its rows
    (item, a, b, ask) that a text of the chunk asks for. Chunks are random, so that equal rows are spread.
    """
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // chunk_bytes)
    placed = pin(rows.withColumn("_chunk", F.floor(F.rand(7) * chunks).cast("int")), "chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = asks()
        for batch in batches:
            found: dict[int, set[str]] = {}
            for chunk, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    found.setdefault(chunk, set()).update(tell(t))
            pairs = [(c, a) for c, own in found.items() for a in own]
            ids, names = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(names, pa.string())], names=["_chunk", "ask"])

    needed = placed.select("_chunk", text).mapInArrow(run, "_chunk int, ask string").distinct()
    entries = needed.join(table, "ask").select("_chunk", "item", "a", "b", "ask")

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left.drop_columns(["_chunk"]), list(zip(*(right.column(c).to_pylist() for c in ("item", "a", "b", "ask")), strict=True)))

    return placed.groupBy("_chunk").cogroup(entries.groupBy("_chunk")).applyInArrow(both, schema)
