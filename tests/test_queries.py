"""Every registered core query against its SQL, or at least run to its end."""

import re

import pytest

import __spark_entry__
from tests.compare import same
from tracewell.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["source_stats", "newest_of_source", "sync_changes", "scan_freshness", "scan_totals", "export_newest", "tag_counts", "timeline_neighbours"])
def test_contents_are_not_shuffled(spark, sf, name):
    """Queries on a few narrow columns read no contents, or (where they count missing ones) only whether they are there."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Aggregate" in line or "Project" in line:
            assert not re.search(r"(?<!isnull\()\bcontent#", line)
