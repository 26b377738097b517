"""A sample of registered queries beside their SQL, and the shape of the registry."""

import pytest
from compare import compare, duck
from conftest import SF

import __spark_entry__ as entry_points

SAMPLE = ["risk_stress", "risk_contributions", "sharpe_ratios", "folds_leakage", "ledger_category_rollup", "ledger_running_total",
          "facts_label_tags", "suite_build", "suite_grades", "lineage_spans", "lineage_explain", "chat_route", "context_pairs",
          "banned_first", "citation_references", "stream_dedup"]


def test_every_counterpart_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_flagship(spark):
    assert entry_points.entry(spark).count() == 10


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, duck(SF), name, entry_points.queries()[name], entry_points.oracle_sql()[name], SF)
    assert ok, note
