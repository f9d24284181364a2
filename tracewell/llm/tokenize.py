"""Encoding of a whole corpus with a public byte-level tokenizer."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.byte_pairs import merge, read_ranks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer splits a text before merging (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A piece longer than this is not kept in the cache, and a full cache is emptied; neither changes a result.
CACHED_LENGTH, CACHE_SIZE = 40, 250_000
#: A pre-token never reaches across the place before a space, unless white space is on both sides of that space.
CUT, RUN = re.compile(r"(?<=\S) | (?=\S)"), re.compile(r" \s")


class Encoder:
    """Encodes texts. What was seen before comes from bounded caches, the rest is merged with the rank queue."""

    def __init__(self, vocabulary: bytes) -> None:
        self.ranks = read_ranks(vocabulary)
        # Python's \s also holds four separators that the tokenizer's pattern treats as other characters
        self.split = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.pieces: dict[str, list[int]] = {}
        self.words: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        ids = merge(piece.encode("utf-8", "replace"), self.ranks)
        if len(piece) <= CACHED_LENGTH:
            if len(self.pieces) >= CACHE_SIZE:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def word(self, word: str) -> list[int]:
        get, ids = self.pieces.get, []
        for piece in self.split(word):
            ids += get(piece) or self.piece(piece)
        if len(word) <= CACHED_LENGTH:
            if len(self.words) >= CACHE_SIZE:
                self.words.clear()
            self.words[word] = ids
        return ids

    def extend(self, out: array, text: str) -> None:
        get, new, extend = self.words.get, self.word, out.extend
        first, *rest = CUT.split(text) if RUN.search(text) or text.endswith(" ") else text.split(" ")
        if first:
            extend(get(first) or new(first))
        for word in rest:
            word = " " + word
            extend(get(word) or new(word))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds column ids (array of int): the token ids of column text, without special tokens.

    Null and empty texts give an empty list, blank ones are encoded like any other; rows keep their order and number,
    repeated ones too. Other columns pass through; one that is named as `ids` is replaced. The vocabulary is a file of
    fixed size, read once on the driver and broadcast. The work is one pass without a shuffle, so it stays as
    partitioned as its input.
    """
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    kept = df.drop(ids)
    schema = kept.withColumn(ids, F.lit(None).cast("array<int>")).schema
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            values, starts = array("i"), array("i", [0])
            for t in batch.column(place).to_pylist():
                if t:
                    encoder.extend(values, t)
                starts.append(len(values))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids])

    return kept.mapInArrow(run, schema)
