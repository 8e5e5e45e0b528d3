"""Findings F4 to F10 and F22: reports on decisions, purchases and entries wait for no marks and no store."""

import pytest

from bookloom.operators import capex, statements, workpapers
from bookloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
UNSPLIT = ["capex_items", "capex_apply", "category_summary", "cogs_bank_proxy", "cogs_inventory",
           "fallback_review", "inventory_spikes"]


@pytest.mark.parametrize("name", [*UNSPLIT, "entry_balance"])
def test_no_marks_and_no_store(spark, name):
    plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "mismatch" not in plan
    if name in UNSPLIT:
        assert "LOAN_ESTIMATED_SPLIT" not in plan


@pytest.mark.parametrize("report", [capex.items, workpapers.category_summary, statements.cogs_proxy,
                                    statements.inventory_spikes])
def test_same_as_from_posted_rows(spark, report):
    a = catalog._analysis(spark, FOLDER)
    got, want = report(a.purchased).collect(), report(a.posted).collect()
    assert got and sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["pnl_build", "pnl_multi_period", "pnl_checks"])
def test_keywords_are_looked_for_once_in_each_description(spark, name):
    """F46, F47, F50."""
    plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [description" in plan and "Join" in plan
