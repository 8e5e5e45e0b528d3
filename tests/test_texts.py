"""Findings F1 to F34: what follows from a description is found out once per distinct text."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from bookloom.functions.plan import TEXT
from bookloom.operators import capex, categorize, corrections, flows, loans, merchant, texts

SCHEMA = ("client_id long, batch_id string, seq long, transaction_id string, date string, "
          "description string, amount decimal(18,2), direction string")
LINES = [("STRIPE PAYOUT 12345", "CREDIT"), ("MISC ITEM", "CREDIT"), ("GEICO CLAIM REFUND", "CREDIT"),
         ("WAL-MART SUPERCENTER 55", "DEBIT"), ("northside hardware #22", "DEBIT"), ("STARBUCKS", "DEBIT"),
         ("FORKLIFT DEALERSHIP", "DEBIT"), ("SBA LOAN PAYMENT", "DEBIT"), ("ACME WIDGETS 5521", "DEBIT"),
         ("", "DEBIT"), (None, "CREDIT"), ("STARBUCKS", None), ("UBER TRIP 8812", "DEBIT")]


def rows(spark):
    out, seq = [], 0
    for client in (1, 2):
        for text, side in LINES:
            for amount in ("12.50", "640.00", "12000.00"):
                seq += 1
                out.append((client, f"b{client}", seq, f"t{seq}", "2024-01-05", text, D(amount), side))
    return spark.createDataFrame(out, SCHEMA)


def test_facts_by_text_equal_those_by_row(spark):
    dictionary = spark.createDataFrame(
        [(1, 0, "northside", "HOME DEPOT", "6350"), (1, 1, "WIDGETS", "STARBUCKS", "5120")],
        "client_id long, ordinal int, pattern string, canonical_id string, default_account string")
    learned = corrections.fold(spark.createDataFrame(
        [(2, "ACME WIDGETS", "5120", "Parts", "COGS", "DEBIT", 1)],
        "client_id long, description string, account_code string, account_name string, "
        "account_type string, direction string, event_seq long").withColumns({
            "kind": F.lit("correct"), "source": F.lit("human_override"), "irs_ref": F.lit(""),
            "deductible": F.lit(True), "category": F.lit(""), "subcategory": F.lit(""),
            "notes": F.lit("")}))

    def chain(df):
        named = merchant.normalize(flows.classify(df), dictionary)
        return capex.apply(categorize.categorize(named, learned)).drop(TEXT)

    split = loans.apply_splits(loans.analyze(rows(spark)))
    by_row, by_text = chain(split), chain(texts.annotate(split, rows(spark)))
    assert by_row.columns == by_text.columns
    assert by_row.orderBy("seq").collect() == by_text.orderBy("seq").collect()


def test_each_pair_of_text_and_side_once_and_dealt_out(spark):
    pairs = texts.distinct(rows(spark))
    assert pairs.count() == len(set(LINES))
    assert len({r[0] for r in pairs.select(F.spark_partition_id()).collect()}) > 1
