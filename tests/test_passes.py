"""Findings of the fourth round: how often rows are read and worked out, and what is kept of them."""

import pytest
from pyspark.sql import functions as F

from bookloom.operators import checks, journal, workpapers
from bookloom.plans import catalog
from bookloom.sources import statements

FOLDER = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_delimited_lines_are_split_once_and_stay_in_place(spark):
    """cells were worked out in the join's condition too, and all lines were shuffled by their source."""
    plan = optimized(catalog.QUERIES["delimited_scan"](spark, FOLDER))
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("split(" in line for line in joins) and "_salt" not in plan


def test_headers_sent_to_lines_and_joined_by_source_agree(spark):
    lines = [("a", 0, "Date,Description,Amount"), ("a", 1, '01/02/2024,"x, y",-5.00'), ("a", 2, ""),
             ("b", 7, "Memo;Debit;Credit;Date"), ("b", 8, "rent;9.00;;2024-01-03"), ("b", 9, "pay;;8.5;2024-01-04"),
             ("c", 3, "Date,Description,Amount"), (None, 1, "x"), ("a", None, "01/02/2024,z,1"), ("a", 3, None)]
    df = spark.createDataFrame(lines, "source_id string, seq long, line string")
    few, many = (statements.delimited(df, 2024, few_sources=f).orderBy("source_id", "seq").collect()
                 for f in (True, False))
    assert few == many
    assert [(r.source_id, r.seq, r.date, r.description, str(r.amount), r.direction) for r in few] == [
        ("a", 1, "2024-01-02", "x, y", "5.00", "DEBIT"), ("b", 8, "2024-01-03", "rent", "9.00", "DEBIT"),
        ("b", 9, "2024-01-04", "pay", "8.50", "CREDIT")]


@pytest.mark.parametrize("name", ["workpaper_package", "package_fields"])
def test_package_blocks_scan_flagged_rows_written_once(spark, name):
    """each block worked out its rows anew from kept ones, marks and flag rules with them."""
    plan = optimized(catalog.QUERIES[name](spark, FOLDER))
    assert "InMemoryRelation" not in plan and "repeat#" not in plan and "_text#" not in plan


def test_digest_of_fields_reads_them_from_the_json(spark):
    df = spark.sql("SELECT 'b' AS batch_id, 7L AS seq, 'say \"hi\" | é' AS text, CAST(NULL AS string) AS none, "
                   "CAST(1.50 AS decimal(18,2)) AS money, 0.95D AS score, true AS good, array('A', 'q\"') AS flags")
    names = workpapers.field_names(df)
    got = workpapers.fields_digest(workpapers.section(df, "s", ["seq"]), names).collect()
    text = 'flags=["A","q\\""]|good=true|money=1.50|none=~|score=0.95|text=say "hi" | é'
    assert [tuple(r) for r in got] == [
        ("b", "s", "7".zfill(20), spark.range(1).select(F.md5(F.lit(text))).first()[0])]


@pytest.mark.parametrize("name", [
    "issue_capex_as_expense", "categorization_stats", "tax_items", "tax_unmapped", "tax_summary",
    "trial_balance_by_type", "register_search", "issue_uncategorized_remaining", "gate_arithmetic",
    "structural_issues"])
def test_reports_without_marks_keep_no_rows(spark, name):
    """F3 to F9 and F11 to F13: wide rows were marked and kept on disk for them."""
    plan = optimized(catalog.QUERIES[name](spark, FOLDER))
    assert "InMemoryRelation" not in plan and "mismatch#" not in plan
    if name not in ("categorization_stats", "trial_balance_by_type", "gate_arithmetic", "structural_issues"):
        assert "loan_principal" not in plan


def test_entries_add_up_to_the_trial_balance(spark):
    a = catalog._lean(spark, FOLDER)
    told = {r.batch_id: (r.difference, r.is_balanced) for r in checks.batch_figures(a.posted).collect()}
    added = journal.trial_totals(a.trial_balance).collect()
    assert told == {r.batch_id: (r.difference, r.is_balanced) for r in added} and told
