"""Similar records against comparison of all pairs."""

import itertools
import random

import numpy as np
import pytest

from tracewell.llm.near_duplicates import _put, _take, level, similar_pairs
from tracewell.llm.queries_sessions import _records, p2_found
from tracewell.llm.words import words


def plain(rows, least=40, width=3, similarity=0.5):
    known = {}
    for name, key, text in rows:
        w = words(text)
        if key is not None and len(w) >= least:
            known[name, key] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    out = set()
    for (a, x), (b, y) in itertools.combinations(sorted(known.items()), 2):
        if a[0] == b[0] and len(x & y) >= similarity * len(x | y):
            out.add((a[0], a[1], b[1]))
    return out


def edited(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        i = rng.randrange(len(w))
        w[i : i + rng.choice([0, 1])] = [rng.choice(["new", "word", "here"])]
    return " ".join(w)


def test_all_pairs_of_edited_copies(spark):
    rng = random.Random(5)
    common = "the log shows some frozen scanner at line".split()
    rows = []
    for i in range(40):
        base = " ".join(rng.choice(common if rng.random() < 0.3 else [f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(40, 160)))
        rows.append(("t", f"{i}", base))
        for j in range(4):
            rows.append(("t" if j else "u", f"{i}-{j}", edited(rng, base, rng.choice([0, 2, 8, 15, 25]))))
        halves = base.split()
        rows.append(("t", f"{i}-r", " ".join(halves[len(halves) // 2 :] + halves[: len(halves) // 2])))
    rows += [("t", "short", "too few words " * 5), ("t", None, rows[0][2]), ("t", "null", None), ("t", "empty", ""), ("t", "0", rows[0][2]), ("t", "same", rows[0][2].upper()), ("t", "long", "a b c " * 100_000)]
    found = similar_pairs(spark.createDataFrame(rows, "table_name string, key string, content string"))
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(plain(rows)) and len(got) > 100


def test_pairs_that_share_few_shingles(spark):
    texts = ["ok " * 40, "ok " * 60, "a b c " * 20, "a b c " * 30, "b c a " * 20, "c d " * 25, "c d " * 40, "e f g h " * 15, "e f g h " * 25, "ok " * 45 + "no", "ok " * 50 + "no no", "a b c " * 20 + "d", "c d " * 30 + "e f"]
    rows = [("t", f"{i:02}", x) for i, x in enumerate(texts)]
    got = sorted(map(tuple, similar_pairs(spark.createDataFrame(rows, "table_name string, key string, content string")).collect()))
    assert got == sorted(plain(rows)) and ("t", "00", "01") in got and ("t", "02", "03") in got


@pytest.mark.parametrize("bounds", [{"chunk": 500, "longest": 512}, {"chunk": 3000, "longest": 3}, {"chunk": 2_000_000, "longest": 7}])
def test_bounds_change_nothing(spark, bounds):
    """Many chunks, and lists that are split: all shingles are common here, so that short lists are long."""
    rng = random.Random(9)
    bases = [" ".join(rng.choice("log scan index".split()) for _ in range(rng.randrange(60, 90))) for _ in range(12)]
    rows = [("t", f"{i}-{j}", edited(rng, b, j * 2) if j else b) for i, b in enumerate(bases) for j in range(12)]
    got = sorted(map(tuple, similar_pairs(spark.createDataFrame(rows, "table_name string, key string, content string").repartition(3), **bounds).collect()))
    assert got == sorted(plain(rows)) and len(got) > 100


def test_levels():
    n = np.array([1, 2, 127, 128, 200, 10**5, 10**9])
    got = level(n)
    assert got.tolist()[:4] == [1, 2, 127, 128] and (np.diff(got.astype(int)) >= 0).all() and got[-1] <= 255


def test_packed_columns():
    columns = [np.array([1, 5, 2**40], np.uint64), np.zeros(3, np.uint64), np.array([2**64 - 1, 0, 7], np.uint64)]
    assert all((a == b).all() for a, b in zip(columns, _take(_put(*columns)), strict=True))
    assert [len(x) for x in _take(_put(np.zeros(0, np.uint64)))] == [0]


def test_empty_table(spark):
    assert similar_pairs(spark.createDataFrame([], "table_name string, key string, content string")).count() == 0


def test_query(spark, sf):
    assert {tuple(r) for r in p2_found(spark, sf).collect()} == plain({tuple(r) for r in _records(spark, sf).collect()})
