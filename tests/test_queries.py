"""Every catalogued query against its SQL in DuckDB."""

from __future__ import annotations

import os

import pytest
from compare import differences, duck

import __spark_entry__ as entry_points
from leadlane.plans.catalogue import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    assert differences(df, connection, SQL[name]) == ""


def test_every_query_has_a_check():
    assert set(QUERIES) <= set(SQL) and set(QUERIES) <= set(entry_points.queries())


def test_ranked_leads_come_in_order(spark):
    from leadlane.plans.qualify import qualify
    from leadlane.sources.order_leads import order_leads

    ranked = [row["lead_id"] for row in qualify(order_leads(spark, SF_DIR)).ranked().collect()]
    by_rank = entry_points.queries()["ranked_leads"](spark, SF_DIR).select("rank", "lead_id").orderBy("rank").collect()
    assert [row["lead_id"] for row in by_rank] == ranked
    assert [row["rank"] for row in by_rank] == list(range(1, len(ranked) + 1))


@pytest.mark.parametrize("merged", ["true", "false"])
def test_files_written_in_parts_are_numbered_as_one_table(spark, connection, merged):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, merged)
    try:
        assert differences(QUERIES["csv_round_trip"](spark, SF_DIR), connection, SQL["csv_round_trip"]) == ""
    finally:
        spark.conf.unset(key)


def test_the_entry_works_without_the_training_data_queries():
    """Only names of queries of the training-data subpackage may be missing."""
    assert set(entry_points.queries()) - set(QUERIES) <= {n for n in entry_points.queries() if n.startswith("op")} | {"pipeline"}


def test_counts_add_up(spark):
    stats = entry_points.queries()["run_stats"](spark, SF_DIR).first()
    parts = stats["junk_rows_dropped"] + stats["duplicate_rows_dropped"] + stats["qualified_rows"]
    assert stats["total_rows_read"] == parts
    assert stats["qualified_rows"] == stats["contact_now"] + stats["nurture"] + stats["disqualify"]
