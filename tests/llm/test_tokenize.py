"""Token ids against public implementations of the same vocabulary."""

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm.byte_pairs import RankQueue, merge, read_ranks
from tracewell.llm.queries_text import p6_ids
from tracewell.llm.tokenize import PATTERN, VOCABULARY, Encoder, encode

with open(VOCABULARY, "rb") as f:
    DATA = f.read()
RANKS = read_ranks(DATA)
ENCODER = Encoder(DATA)
OTHER = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    from array import array

    out = array("i")
    ENCODER.extend(out, text)
    return list(out)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_equals_another_implementation(text):
    assert ids(text) == OTHER.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(" \n\t　 ab1.'s", max_size=40))
def test_white_space(text):
    assert ids(text) == OTHER.encode_ordinary(text)


def test_very_long_pre_token():
    for text in ("a" * 50_000, "abAB" * 20_000, "漢字" * 10_000):
        assert merge(text.encode(), RANKS) == OTHER.encode_ordinary(text)


def test_queue_gives_ranks_in_order():
    q = RankQueue()
    for r in (50_000, 3, 64, 4096, 3, 63):
        q.push(r, r)
    out = []
    while q.top:
        r = q.least()
        out += [r] * len(q.take(r))
    assert out == [3, 3, 63, 64, 4096, 50_000]


def test_nulls_empties_repetitions_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, " \n ", "y"), (4, "hi", "z"), (4, "hi", "z"), (5, "a " * 200_000, "long")], "doc_id bigint, text string, ids string")
    got = encode(rows, "text").collect()
    assert len(got) == 6
    assert [r.ids for r in got if r.doc_id in (1, 2)] == [[], []]
    assert [r.ids for r in got if r.doc_id == 4] == [OTHER.encode_ordinary("hi")] * 2
    assert [r.ids for r in got if r.doc_id == 5] == [OTHER.encode_ordinary("a " * 200_000)]
    assert [r.ids for r in got if r.doc_id == 3] == [OTHER.encode_ordinary(" \n ")]
    assert encode(rows.limit(0), "text").count() == 0


def test_query(spark, sf):
    rows = p6_ids(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert all(r.ids == (OTHER.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else []) for r in rows)
