"""Loan payments: find them and split principal, interest and fees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.matching import contains_any, literal
from bookloom.functions.money import MONEY, cents, count_if, total
from bookloom.functions.plan import settle
from bookloom.operators.client_rules import match_client_rules
from bookloom.rules import loans as rules

SPLIT = ("struct<principal:decimal(18,2),interest:decimal(18,2),fees:decimal(18,2),"
         "source:string,evidence:string>")

#: Fixed value: how far the shares of a manual split may be from one.
SHARE_GAP = "0.01"


def is_loan(description: Column, direction: Column) -> Column:
    """Never null: a row without description or direction is no loan."""
    found = (direction == "DEBIT") & contains_any(F.upper(description), rules.KEYWORDS)
    return F.coalesce(found, F.lit(False))


def loan_type(description: Column) -> Column:
    chain = F
    for kind, words in rules.types():
        chain = chain.when(contains_any(F.upper(description), words), F.lit(kind))
    return chain.otherwise(F.lit("GENERIC"))


def _amount_after(description: Column, pattern: str) -> Column:
    """The number the pattern captures; null when the pattern does not occur."""
    found = F.regexp_extract(F.upper(description), pattern, 1)
    return F.nullif(found, F.lit("")).try_cast(MONEY)


def fee(description: Column) -> Column:
    """Fee written into the description; a zero fee counts as none."""
    return F.nullif(_amount_after(description, rules.FEE_PATTERN), F.lit(0).cast(MONEY))


def stated_interest(description: Column) -> Column:
    return _amount_after(description, rules.INTEREST_PATTERN)


def _split(principal, interest, fees, source, evidence) -> Column:
    return F.struct(principal.cast(MONEY).alias("principal"), interest.cast(MONEY).alias("interest"),
                    fees.cast(MONEY).alias("fees"), F.lit(source).alias("source"),
                    evidence.alias("evidence"))


def checked_splits(rules: DataFrame) -> DataFrame:
    """Shares a client hands in, with ``accepted`` and ``error``: they must add up to one, give or
    take ``SHARE_GAP``; a missing share is zero."""
    share = sum((F.coalesce(c, F.lit(0)) for c in ("principal_pct", "interest_pct", "fees_pct")),
                F.lit(0)).cast("decimal(10,4)")
    good = F.abs(share - 1) <= F.lit(SHARE_GAP).cast("decimal(10,4)")
    return rules.withColumns({"accepted": good, "error": F.when(~good, F.concat(
        F.lit("Percentages must sum to 1.0 (got "), F.round(share, 2).cast("decimal(10,2)").cast("string"),
        F.lit(")")))})


def manual_split(net: Column, fees: Column, rule: Column) -> Column:
    """By the client's own shares of the amount net of a stated fee."""
    share = rule["fees_pct"]
    percent = lambda c: F.format_string("%.0f", F.bround(c.cast("double") * 100, 0))
    return _split(
        cents(net * rule["principal_pct"]), cents(net * rule["interest_pct"]),
        F.when(fees.isNull() & (share != 0), cents(net * share)).otherwise(fees), "manual",
        F.concat(F.lit("Manual split applied: "), percent(rule["principal_pct"]),
                 F.lit("% principal, "), percent(rule["interest_pct"]), F.lit("% interest")))


def described_split(net: Column, fees: Column, interest: Column) -> Column:
    return _split(net - interest, interest, fees, "description",
                  F.concat(F.lit("Interest extracted from description: $"), interest.cast("string")))


def estimated_split(net: Column, fees: Column, kind: Column) -> Column:
    """By a typical yearly rate for the loan type; always marked as an estimate."""
    table = literal({k: {"share": s, "pct": p, "rate": r, "rest": str(100 - int(p))}
                     for k, (s, p, r) in rules.estimates().items()},
                    "map<string,struct<share:decimal(4,2),pct:string,rate:string,rest:string>>")
    t = F.element_at(table, kind)
    interest = cents(net * t["share"])
    principal = (net - interest).cast(MONEY)
    return _split(principal, interest, fees, "estimated", F.concat(
        F.lit("Estimated split using "), kind, F.lit(" typical rate ("), t["rate"],
        F.lit("% annual). ~"), t["pct"], F.lit("% interest ($"), interest.cast("string"),
        F.lit("), ~"), t["rest"], F.lit("% principal ($"), principal.cast("string"),
        F.lit("). ESTIMATED — provide lender statement for accurate split.")))


#: What names a row; ``seq`` alone may repeat from client to client.
ROW = ["client_id", "batch_id", "seq"]


def scheduled_split(rows: DataFrame, schedules: DataFrame) -> DataFrame:
    """Add struct ``_entry``: the schedule row that matches, if any.

    Schedules are tried in order; inside one, an exact date with an amount within the
    tolerance goes before amount alone. For amount alone only the first row of each payment
    amount counts, so a schedule of equal payments is one candidate. Both meet in one
    equi-join, on the date or on the whole unit (a payment is copied to its own unit and both
    neighbours), so each side is read once and each pair meets once in either way.
    """
    gap = F.lit(rules.AMOUNT_TOLERANCE).cast(MONEY)

    def key(inexact: int, value: Column) -> Column:
        return F.struct(F.lit(inexact).alias("inexact"), value.cast("string").alias("_key"))

    entry = ["loan_ordinal", "inexact", "_due", "payment", "loan_id", "principal", "interest"]
    unit = F.floor("payment")
    table = schedules.select(
        "client_id", "loan_ordinal", F.col("date").alias("_due"), "payment", "loan_id", "principal",
        "interest", F.inline(F.array(key(0, F.col("date")), *[key(1, unit + d) for d in (-1, 0, 1)])))
    first = (table.groupBy("client_id", "loan_ordinal", "payment", "inexact", "_key")
             .agg(F.min(F.struct("_due", "loan_id", "principal", "interest")).alias("f"))
             .select("client_id", "loan_ordinal", "payment", "inexact", "_key", "f.*"))
    wanted = rows.select(*ROW, "amount", F.inline(F.array(
        key(0, F.col("date")), key(1, F.floor("amount")))))
    hits = (wanted.join(first, ["client_id", "inexact", "_key"])
            .where(F.abs(F.col("payment") - F.col("amount")) <= gap)
            .groupBy(*ROW).agg(F.min(F.struct(*entry)).alias("_entry")))
    return rows.join(hits, ROW, "left")


def analyze(rows: DataFrame, manual: DataFrame | None = None,
            schedules: DataFrame | None = None) -> DataFrame:
    """Add ``is_loan``, ``loan_type`` and struct ``split``.

    Order of trust: the client's manual shares, interest in the description, a payment
    schedule, an estimate. Only loans still open after the first two are shuffled to
    look for a schedule row; that branch reads and matches the input a second time.
    """
    out = (rows.withColumn("is_loan", is_loan(F.col("description"), F.col("direction")))
           .withColumns({
               "loan_type": F.when(F.col("is_loan"), loan_type(F.col("description"))),
               "_fee": F.when(F.col("is_loan"), fee(F.col("description"))),
               "_stated": F.when(F.col("is_loan"), stated_interest(F.col("description")))})
           .withColumn("_net", (F.col("amount") - F.coalesce("_fee", F.lit(0))).cast(MONEY)))
    out = settle(out, {c: F.col(c) for c in ("is_loan", "loan_type", "_fee", "_stated", "_net")})
    no_rule = F.lit(None).cast("struct<principal_pct:decimal(5,4),interest_pct:decimal(5,4),"
                               "fees_pct:decimal(5,4)>")
    if manual is not None:
        keyed = manual.withColumn("pattern", F.trim(F.upper("pattern")))
        out = match_client_rules(out, keyed, F.upper("description"), "pattern", ["ordinal"],
                                 ["principal_pct", "interest_pct", "fees_pct"], "_manual",
                                 only=F.col("is_loan"))
    else:
        out = out.withColumn("_manual", no_rule)
    entry_type = ("struct<loan_ordinal:int,inexact:int,_due:string,payment:decimal(18,2),"
                  "loan_id:string,principal:decimal(18,2),interest:decimal(18,2)>")
    if schedules is not None:
        open_loan = F.col("is_loan") & F.col("_manual").isNull() & F.col("_stated").isNull()
        open_rows = scheduled_split(out.where(open_loan), schedules)
        closed = out.where(~open_loan).withColumn("_entry", F.lit(None).cast(entry_type))
        out = closed.unionByName(open_rows.withColumn("_entry", F.col("_entry").cast(entry_type)))
    else:
        out = out.withColumn("_entry", F.lit(None).cast(entry_type))
    net, fees, entry = F.col("_net"), F.col("_fee"), F.col("_entry")
    split = (F.when(~F.col("is_loan"), F.lit(None).cast(SPLIT))
             .when(F.col("_manual").isNotNull(), manual_split(net, fees, F.col("_manual")))
             .when(F.col("_stated").isNotNull(), described_split(net, fees, F.col("_stated")))
             .when(entry.isNotNull(), _split(
                 entry["principal"], entry["interest"], fees, "amortization",
                 F.concat(F.lit("Matched amortization schedule '"), entry["loan_id"],
                          F.lit("' for "), F.col("date"))))
             .otherwise(estimated_split(net, fees, F.col("loan_type"))))
    return out.withColumn("split", split).drop("_fee", "_stated", "_net", "_manual", "_entry")


def routed(loan: Column) -> dict[str, Column]:
    """Account of the rows where ``loan`` holds; open for the others."""
    return {"account_type": F.when(loan, "LIABILITY").otherwise(""),
            "account_code": F.when(loan, "2300").otherwise(""),
            "account_name": F.when(loan, "Loan Payable").otherwise("")}


def apply_splits(analyzed: DataFrame) -> DataFrame:
    """Route loans to the loan account, keep the split and flag estimates."""
    s, loan = F.col("split"), F.col("is_loan")
    estimated = F.coalesce(s["source"] == "estimated", F.lit(False))
    return analyzed.withColumns({
        "loan_split_source": F.when(loan, s["source"]).otherwise(""),
        "loan_type": F.coalesce("loan_type", F.lit("")),
        "loan_estimated": estimated,
        "loan_principal": s["principal"],
        "loan_interest": s["interest"],
        "loan_fees": F.nullif(s["fees"], F.lit(0).cast(MONEY)),
        **routed(loan),
        "flags": F.when(estimated, F.array(F.lit("LOAN_ESTIMATED_SPLIT")))
        .otherwise(F.array().cast("array<string>")),
        "flag_notes": F.when(estimated, F.array(s["evidence"]))
        .otherwise(F.array().cast("array<string>")),
    }).drop("split", "is_loan")


def report(split_rows: DataFrame) -> DataFrame:
    """Per batch: loans found, how they were split, totals, counts by type and source."""
    loan = F.col("loan_split_source") != ""
    counts = {}
    for kind in rules.RATES:
        counts[f"type_{kind.lower()}"] = count_if(loan & (F.col("loan_type") == kind))
    for source in ("manual", "description", "amortization", "estimated"):
        counts[f"source_{source}"] = count_if(F.col("loan_split_source") == source)
    return split_rows.groupBy("batch_id").agg(
        count_if(loan).alias("loan_payments_found"),
        count_if(loan & ~F.col("loan_estimated")).alias("confirmed_split"),
        count_if(F.col("loan_estimated")).alias("estimated_split"),
        count_if(loan & F.col("loan_principal").isNull()).alias("needs_manual_split"),
        total(F.col("loan_principal")).alias("total_principal"),
        total(F.col("loan_interest")).alias("total_interest_expense"),
        total(F.col("loan_fees")).alias("total_fees"),
        *[c.alias(n) for n, c in counts.items()])
