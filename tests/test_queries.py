"""Every registered query runs; those with SQL equal DuckDB row by row."""

import pytest

from tests.oracle import connect, same
from tidewell.plans import queries as own


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    same(own.QUERIES[name](spark, sf_dir), con, own.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert own.QUERIES[name](spark, sf_dir).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["canonical_id", "bm25", "created_at"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(own.QUERIES["feed_new_page0"](spark, sf_dir))
    assert "WindowGroupLimit" in plan_of(own.QUERIES["latest_state"](spark, sf_dir))
    text = plan_of(own.QUERIES["reply_counts"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint>" in text  # neither text nor source
    assert "BroadcastNestedLoopJoin" not in plan_of(own.QUERIES["blocklist_purge"](spark, sf_dir))
