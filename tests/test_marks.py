"""Findings F2 to F23 and F36 to F41: how often inputs are read, and which rows are shuffled."""

from decimal import Decimal

from bookloom.operators import flags, loans, reconcile
from bookloom.plans import catalog
from bookloom.sources import derive

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_flags_do_not_shuffle_marked_rows(spark):
    rows = derive.transactions(spark, FOLDER).limit(300).cache()
    rows = rows.selectExpr("*", "'' AS account_code", "'' AS account_type",
                           "CAST(array() AS array<string>) AS flags", "CAST(array() AS array<string>) AS flag_notes")
    batches, totals = derive.batches(rows), reconcile.totals(rows)
    early = flags.apply(flags.mark(rows, batches, totals), batches, totals)
    late = flags.apply(rows, batches, totals)
    assert "repeat" not in early.columns and "Join" not in plan(
        flags.apply(flags.mark(rows, batches, totals).checkpoint(), batches, totals))
    assert sorted(early.collect()) == sorted(late.collect())
    assert any("BALANCE_MISMATCH" in r.flags for r in early.collect())


def test_reports_keep_marked_rows_only(spark):
    assert "repeat" in catalog.posted(spark, FOLDER).columns
    assert not catalog._flagged(spark, FOLDER).storageLevel.useMemory


def test_schedules_and_rows_are_read_once_each_way(spark):
    rows = spark.createDataFrame(
        [(1, "b", 1, "2024-01-05", "NOTE PAYMENT 1", Decimal("100.00"), "DEBIT"),
         (1, "b", 2, "2024-02-05", "NOTE PAYMENT 1", Decimal("100.40"), "DEBIT"),
         (1, "b", 3, "2024-03-05", "NOTE PAYMENT 1", Decimal("300.00"), "DEBIT")],
        "client_id long, batch_id string, seq long, date string, description string, "
        "amount decimal(18,2), direction string").checkpoint()
    table = spark.createDataFrame(
        [(1, 0, "A", "2000-01-01", Decimal("100.25"), Decimal("80.00"), Decimal("20.00")),
         (1, 0, "A", "2024-02-05", Decimal("100.40"), Decimal("81.00"), Decimal("19.40")),
         (1, 1, "B", "2024-01-05", Decimal("100.00"), Decimal("70.00"), Decimal("30.00"))],
        "client_id long, loan_ordinal int, loan_id string, date string, payment decimal(18,2), "
        "principal decimal(18,2), interest decimal(18,2)").checkpoint()
    out = loans.analyze(rows, None, table)
    got = {r.seq: (r.split.source, r.split.principal) for r in out.collect()}
    assert got == {1: ("amortization", Decimal("80.00")), 2: ("amortization", Decimal("81.00")),
                   3: ("estimated", got[3][1])}
    # closed rows, open rows, wanted rows and the schedules; six readings before
    assert plan(out).count("LogicalRDD") <= 4
