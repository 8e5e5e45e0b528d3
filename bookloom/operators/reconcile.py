"""Batch totals and the reconciliation gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.matching import compact
from bookloom.functions.money import MONEY, count_if, total
from bookloom.operators.categorize import is_flagged, needs_review

# The difference still read as rounding, and the text of each finding.
TOLERANCE = "0.10"
NO_BALANCES = ("Statement beginning/ending balances not provided. Cannot verify completeness of "
               "imported transactions.")
ASK_SUMMARY = ("Provide statement summary page with beginning and ending balances for full "
               "reconciliation.")
TOO_HIGH = (". Possible causes: duplicate transactions imported, or credits (deposits) included "
            "that don't belong to this period.")
TOO_LOW = ". Possible causes: missing transactions, debits not captured, or wrong date range."
VERIFY = ("Verify: (1) date range matches statement period exactly, (2) no transactions were "
          "excluded by parsing, (3) no duplicate imports from overlapping files.")
EMPTY = "No transactions found in batch."
DUPLICATE_KEY_CHARS = 20


def totals(rows: DataFrame, by: list[str] = ["batch_id"]) -> DataFrame:
    amount = F.col("amount")
    return (rows.groupBy(*by).agg(
        total(amount, F.col("direction") == "CREDIT").alias("total_credits"),
        total(amount, F.col("direction") == "DEBIT").alias("total_debits"),
        F.count("*").alias("transaction_count"))
        .withColumn("net_change", (F.col("total_credits") - F.col("total_debits")).cast(MONEY)))


def review_totals(rows: DataFrame, by: list[str] = ["batch_id"]) -> DataFrame:
    """Batch totals with the number of flagged rows and of rows waiting for review."""
    counts = rows.groupBy(*by).agg(count_if(is_flagged()).alias("flagged_count"),
                                   count_if(needs_review()).alias("review_queue_count"))
    return totals(rows, by).join(counts, by)


def duplicates(rows: DataFrame) -> DataFrame:
    """Per batch: rows beyond the first with one date, amount, side and description start.

    Groups are counted before they are added up, so no group is held together.
    """
    key = F.substring("description", 1, DUPLICATE_KEY_CHARS)
    groups = rows.groupBy("batch_id", "date", "amount", "direction", key.alias("start")).count()
    return groups.groupBy("batch_id").agg(
        F.sum(F.col("count") - 1).cast("bigint").alias("duplicate_count"))


def status(difference: Column, known: Column, rows: Column) -> Column:
    gap = F.abs(difference)
    return (F.when(~known, "YELLOW").when(rows == 0, "RED").when(gap == 0, "GREEN")
            .when(gap <= F.lit(TOLERANCE).cast(MONEY), "YELLOW").otherwise("RED"))


def with_balances(batches: DataFrame, batch_totals: DataFrame) -> DataFrame:
    """Batches with their totals, computed ending balance, difference and status."""
    known = F.col("beginning_balance").isNotNull() & F.col("ending_balance").isNotNull()
    ending = (F.col("beginning_balance") + F.col("net_change")).cast(MONEY)
    out = batches.join(batch_totals, "batch_id", "left").fillna(
        0, ["transaction_count"])
    for name in ("total_credits", "total_debits", "net_change"):
        out = out.withColumn(name, F.coalesce(name, F.lit(0)).cast(MONEY))
    return (out.withColumn("balances_provided", known)
            .withColumn("computed_ending", F.when(known, ending))
            .withColumn("difference", (F.col("computed_ending") - F.col("ending_balance")).cast(MONEY))
            .withColumn("status", status(F.col("difference"), known, F.col("transaction_count"))))


def reconcile(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """Stoplight per batch, with issues, recommendations and the duplicate count."""
    out = (with_balances(batches, totals(rows)).join(duplicates(rows), "batch_id", "left")
           .withColumn("duplicate_count", F.coalesce("duplicate_count", F.lit(0)).cast("bigint")))
    gap = F.abs("difference").cast("string")
    known, diff = F.col("balances_provided"), F.col("difference")
    over = known & (F.abs(diff) > F.lit(TOLERANCE).cast(MONEY))
    minor = known & (diff != 0) & ~over

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    issues = compact(
        (~known, NO_BALANCES),
        (minor, text("Minor difference of $", gap, f" (within ${TOLERANCE} tolerance). "
                     "Likely rounding or pending transaction.")),
        (over, text("Reconciliation failed: difference of $", gap, ". Computed ending: $",
                    F.col("computed_ending").cast("string"), ", stated ending: $",
                    F.col("ending_balance").cast("string"), ".")),
        (known & (F.col("transaction_count") == 0), EMPTY),
        (known & (F.col("duplicate_count") > 0), text(
            F.col("duplicate_count").cast("string"),
            " possible duplicate transaction(s) detected. This may cause reconciliation mismatch.")))
    advice = compact(
        (~known, ASK_SUMMARY),
        (over & (diff > 0), text("Computed ending exceeds stated by $", gap, TOO_HIGH)),
        (over & (diff < 0), text("Computed ending is less than stated by $", gap, TOO_LOW)),
        (over, VERIFY))
    return out.withColumns({"issues": issues, "recommendations": advice,
                            "can_issue_full": F.col("status").isin("GREEN", "YELLOW")})
