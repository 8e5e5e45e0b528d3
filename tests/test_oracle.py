"""A cross-section of registered queries against their SQL on the smallest tables."""

import os

import pytest
from compare import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["exact_match", "pattern_match", "loan_split", "categorize", "trial_balance",
          "profit_and_loss", "flag_summary", "package_fields", "tax_items", "tax_unmapped", "capex_items",
          "correction_list", "split_shares", "pnl_assumptions", "ledger_rollup", "keyword_rollup", "industry_scorecard", "cover_sheet", "acceptance_verdict", "redact_text", "pnl_checks"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    con = duck(FOLDER)
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER) is None
