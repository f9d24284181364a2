"""The relevance score of session documents for a query's terms."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import CJK, contains_any, occurrences, path_only
from tracewell.functions.vocabulary import SEARCH_NOISE, SOURCE_WEIGHTS


def _in_any(term: str, fields: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(f, F.lit(term)) for f in fields])


def source_weight(source_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SOURCE_WEIGHTS.items() for x in pair])
    return F.coalesce(table[source_type], F.lit(1)).cast("double")


def noise_penalty(title: Column, content: Column, path: Column, marks: Sequence[str] = SEARCH_NOISE) -> Column:
    """What marks of no content cost: skill texts, tool output, listings, long lists of short lines."""
    text = F.lower(F.concat_ws("\n", title, content, path))
    hits = reduce(add, [F.contains(text, F.lit(m.lower())).cast("int") for m in marks]) if marks else F.lit(0)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    short = F.filter(lines, lambda x: (F.length(x) <= 40) & ~F.contains(x, F.lit(" ")) & (occurrences(x, "/") < 2) & (occurrences(x, "-") <= 3))
    return (
        F.least(F.lit(120), hits * 60)
        + F.when(contains_any(text, ["/skills/", "skills-repo"]), 120).otherwise(0)
        + F.when(contains_any(text, ["guardian_truncated"]), 60).otherwise(0)
        + F.when(contains_any(text, ["chunk id:", "wall time:"]), 120).otherwise(0)
        + F.when(F.size(short) >= 8, 200).otherwise(0)
        + F.when(contains_any(text, ["drwx", "rwxr-xr-x", "\ntotal "]), 200).otherwise(0)
    )


def recency_bonus(epoch: Column, as_of: int) -> Column:
    """20 for today, falling with the logarithm of the age in days, as of a given time."""
    days = F.greatest(F.lit(0), F.lit(as_of) - F.coalesce(epoch, F.lit(0))) / 86400.0
    return F.greatest(F.lit(0.0), 20.0 - F.log2(1.0 + days) * 3.0)


def score(terms: Sequence[str], as_of: int, marks: Sequence[str] = SEARCH_NOISE) -> Column:
    """Score of a row with source_type, title, content, file_path and created_at_epoch. Terms are few (8 at most), unrolled into one expression."""
    title, content, path = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "content", "file_path"))
    fields, wanted = (title, content, path), [t.lower() for t in terms]
    total = source_weight(F.col("source_type"))
    for t in wanted:
        size = float(max(4, len(t) ** 2))
        frequency = F.least(F.lit(100.0), occurrences(content, t) * math.sqrt(len(t)))
        total = total + F.when(_in_any(t, fields), size + frequency).otherwise(0.0) + F.when(F.contains(title, F.lit(t)), 2 * size).otherwise(0.0)
    phrase = " ".join(wanted)
    if len(phrase) >= 2:
        total = total + F.when(_in_any(phrase, fields), 50.0).otherwise(0.0)
    pairs = list(dict.fromkeys(a + b for t in wanted for run in [CJK.findall(t)] for a, b in zip(run, run[1:], strict=False)))
    for pair in pairs:
        total = total + F.when(_in_any(pair, fields), 8.0).otherwise(0.0)
    total = total + recency_bonus(F.col("created_at_epoch"), as_of) - F.when(path_only(F.col("title"), F.col("content")), 180.0).otherwise(0.0)
    return total - noise_penalty(title, content, path, marks)
