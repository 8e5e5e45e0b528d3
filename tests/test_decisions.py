"""Findings F3 to F23, F32 and F33: rows that are decided alike are decided once, and a report works out
only the columns that it reads."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from bookloom.functions.plan import TEXT
from bookloom.operators import capex, categorize, flows, journal, loans, merchant, texts
from bookloom.plans import catalog
from test_texts import rows

FOLDER = "/root/testdata/sf0.001"


def test_decisions_joined_back_equal_those_by_row(spark):
    dictionary = spark.createDataFrame([(1, 0, "northside", "HOME DEPOT", "6350")],
                                       "client_id long, ordinal int, pattern string, canonical_id string, "
                                       "default_account string")
    more = rows(spark).union(rows(spark).selectExpr(
        "client_id", "batch_id", "seq + 1000", "transaction_id", "date", "description",
        "CASE seq % 3 WHEN 0 THEN amount + 0.5 WHEN 1 THEN CAST(NULL AS decimal(18,2)) ELSE -amount END",
        "direction"))
    split = loans.apply_splits(loans.analyze(more))
    by_row = capex.apply(categorize.categorize(merchant.normalize(flows.classify(split), dictionary)))
    found = texts.decisions(more, dictionary)
    assert found.agg(F.sum("rows")).first()[0] == more.count() > found.count()
    joined = categorize.explain(capex.apply(texts.decided(split, found))).drop(TEXT, categorize.WHY)
    joined = joined.select(*by_row.columns)
    assert by_row.orderBy("seq").collect() == joined.orderBy("seq").collect()


def test_entries_told_from_the_row_equal_their_lines(spark):
    table = [(k, c, s, D("100.00"), p, i, f) for k in ("EXPENSE", "REVENUE", "LIABILITY", "EQUITY", None)
             for c in ("6350", "3100", "3200", "", None) for s in ("DEBIT", "CREDIT", None)
             for p, i, f in ((None, None, None), (D(80), D(20), None), (D(80), D(15), D(5)), (D(80), D(20), D(-5)))]
    df = spark.createDataFrame(table, "account_type string, account_code string, direction string, amount "
                               "decimal(18,2), loan_principal decimal(18,2), loan_interest decimal(18,2), "
                               "loan_fees decimal(18,2)").selectExpr(
        "*", "'n' AS account_name", "'d' AS description", "false AS loan_estimated", "'t' AS transaction_id",
        "CAST(array() AS array<string>) AS flags", "CAST(array() AS array<string>) AS flag_notes")
    got = journal.post(df).collect()
    assert len(got) == len(table)
    for r in got:
        assert r.entry_debits == sum(x.debit for x in r.journal_lines)
        assert r.entry_credits == sum(x.credit for x in r.journal_lines)
        assert (r.debit_account, r.credit_account) == tuple(x.account for x in r.journal_lines[:2])
        assert ("UNBALANCED_ENTRY" in r.flags) == (not r.entry_balanced)


def test_a_report_leaves_out_what_it_does_not_read(spark):
    plan = catalog.QUERIES["batch_totals"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    kept = plan[:plan.index("InMemoryRelation")]
    assert "Matched text" not in kept and "Loan principal" not in kept


def test_a_filter_on_flags_does_not_repeat_their_rules(spark):
    plan = catalog.QUERIES["flag_cash_near_10k"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan[:plan.index("InMemoryRelation")].count("LARGE_EXPENSE_REVIEW") == 1


def test_text_queries_match_each_distinct_text_once(spark):
    """the rules stand behind the distinct texts, not beside every row."""
    for name in ("pattern_match", "declarative_rules", "candidate_loop", "candidate_texts"):
        plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [description" in plan and "Join" in plan, name
