"""Repeated lines and leaked items against SQL and small cases."""

import pytest

from tests.compare import same
from tracewell.llm import boilerplate, leaks, queries_sessions, queries_text


@pytest.mark.parametrize("name", sorted(queries_sessions.SQL))
def test_queries_match_sql(spark, sf, name):
    same(spark, sf, queries_sessions.QUERIES[name], queries_sessions.SQL[name])


def test_leaks_match_sql(spark, sf):
    same(spark, sf, queries_text.QUERIES["p7_found"], queries_text.SQL["p7_found"])


NOTICE = "Shared with the team panel"


def line_rows():
    rows = [(f"f{i}", "a", f"own line of the text {chr(97 + i)}\n{NOTICE if i % 2 else '** ' + NOTICE.upper() + ' 12 **'}\nshort", "x") for i in range(6)]
    rows += [("f0", "a", rows[0][2], "x")] * 5  # repeated rows
    rows += [("g", "b", NOTICE, None), ("h", None, NOTICE, None), (None, "a", NOTICE, None), ("n", "a", None, None), ("e", "a", "", None)]
    return rows


def test_variants_count_together_and_repetitions_once(spark):
    docs = spark.createDataFrame(line_rows(), "file_path string, source_type string, content string, line_no string")
    found = boilerplate.find_repeated(docs, "file_path", "source_type", "content")
    assert {(r.file_path, r.line_no, r.n_docs) for r in found.collect()} == {(f"f{i}", 2, 6) for i in range(6)}
    clean = {r.file_path: r.content for r in boilerplate.remove_repeated(docs.distinct(), "file_path", "source_type", "content", found).collect()}
    assert clean["f0"] == "own line of the text a\nshort" and clean["g"] == NOTICE and clean["n"] is None and clean["e"] == ""
    assert boilerplate.find_repeated(docs.limit(0), "file_path", "source_type", "content").count() == 0


def test_share_and_number_of_documents(spark):
    rows = [(f"d{i}", "s", "the repeated notice" if i < 4 else f"some other words {'x' * i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "k string, s string, c string")
    assert boilerplate.find_repeated(docs, "k", "s", "c").count() == 0  # 4 of 100
    assert boilerplate.find_repeated(docs.limit(80), "k", "s", "c", min_share=0.04).count() == 4
    assert boilerplate.find_repeated(docs.filter("k in ('d0', 'd1', 'd2')"), "k", "s", "c").count() == 0  # only 3


ITEMS = [(1, "One two three four five six seven eight nine", None), (2, "short question", "a b c d e f g H"), (3, None, None), (4, "", "a-b c_d e f g h")]


def test_leak_cases(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, question string, answer string")
    docs = spark.createDataFrame([
        (1, "x TWO, three; four five-six seven_eight\nnine y", 9), (2, "one two three four five six seven", 9), (3, None, 9), (4, "", 9), (5, "A B C D E F G H", 9), (5, "A B C D E F G H", 9),
        (6, "w " * 300_000 + "one two three four five six seven eight", 9)], "doc_id bigint, text string, item_id int")
    found = leaks.find_leaks(docs, "doc_id", "text", items, "item_id", ["question", "answer"])
    expected = [(1, 1), (5, 2), (5, 4), (6, 1)]
    assert sorted(map(tuple, found.collect())) == expected
    joined = leaks.find_leaks(docs, "doc_id", "text", items, "item_id", ["question", "answer"], broadcast_ngrams=0)
    assert sorted(map(tuple, joined.collect())) == expected
    clean = {r.doc_id: (r.text, r.leaked) for r in leaks.remove_leaks(docs, "text", items, "item_id", ["question", "answer"]).collect()}
    assert clean[1] == ("x  y", True) and clean[2] == ("one two three four five six seven", False) and clean[3] == (None, False) and clean[5] == ("", True)
    far = leaks.remove_leaks(docs, "text", items, "item_id", ["question", "answer"], broadcast_ngrams=0)
    assert {(r.doc_id, r.text, r.item_id, r.leaked) for r in far.collect()} == {(k, t, 9, x) for k, (t, x) in clean.items()} and far.count() == docs.count()
    assert leaks.find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", ["question"]).count() == 0
    assert leaks.find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", ["question"]).count() == 0
