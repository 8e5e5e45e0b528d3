"""Review flags on posted rows, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.matching import compact, contains_any, literal
from bookloom.functions.money import count_if
from bookloom.functions.plan import settle
from bookloom.operators.skew import join_totals
from bookloom.rules import flags as rules


def row_conditions() -> dict[str, Column]:
    """Condition per flag that needs only the row, in the order flags are raised."""
    text, amount, code = F.upper("description"), F.col("amount"), F.col("account_code")
    debit = F.col("direction") == "DEBIT"
    return {
        "MEALS_OVER_75": (code == "6150") & (amount > 75),
        "LARGE_CASH_WITHDRAWAL": contains_any(text, ["ATM", "CASH"]) & (amount > 500),
        "CASH_NEAR_10K": amount.between(8000, 10000)
        & contains_any(text, ["CASH", "DEPOSIT", "WITHDRAWAL"]),
        "ROUND_NUMBER_SUSPICIOUS": debit & amount.isin([int(a) for a in rules.ROUND_AMOUNTS]),
        "PERSONAL_EXPENSE_MIXED": contains_any(text, rules.PERSONAL),
        "POSSIBLE_CAPITAL_EXPENSE": debit & (amount > 2500) & (F.col("account_type") == "EXPENSE"),
        "LOAN_PAYMENT_DETECTED": code.isin("2300", "2400"),
        "AMBIGUOUS_VENDOR": contains_any(text, rules.BROAD_VENDORS),
    }


def mismatched(batches: DataFrame, batch_totals: DataFrame) -> DataFrame:
    """Batches whose stated balances do not add up, with their row counts."""
    expected = F.col("beginning_balance") + F.col("net_change")
    return (batches.select("batch_id", "beginning_balance", "ending_balance")
            .join(batch_totals, "batch_id")
            .where(expected != F.col("ending_balance"))
            .select("batch_id", F.col("transaction_count").alias("rows"),
                    F.lit(True).alias("mismatch")))


def repeated(rows: DataFrame) -> DataFrame:
    """Keys of a batch that occur at least twice: same date, amount and side."""
    return (rows.groupBy("batch_id", "date", "amount", "direction").agg(F.count("*").alias("rows"))
            .where(F.col("rows") >= 2).withColumn("repeat", F.lit(True)))


def mark(rows: DataFrame, batches: DataFrame, batch_totals: DataFrame,
         facts: DataFrame | None = None) -> DataFrame:
    """Add ``mismatch`` and ``repeat``, which need more than the row. Both follow from the
    transactions, so rows are best marked while they are narrow. ``facts`` may be a cheaper
    table with the same rows."""
    out = join_totals(rows, mismatched(batches, batch_totals), ["batch_id"], "rows", F.col("seq"))
    return join_totals(out, repeated(rows if facts is None else facts),
                       ["batch_id", "date", "amount", "direction"], "rows", F.col("seq"))


def apply(posted: DataFrame, batches: DataFrame, batch_totals: DataFrame) -> DataFrame:
    """Append the engine's flags, each once, with its message."""
    out = posted if "repeat" in posted.columns else mark(posted, batches, batch_totals)
    out = settle(out, {"flags": F.col("flags")})  # read once per flag below
    found = {"BALANCE_MISMATCH": F.coalesce("mismatch", F.lit(False)), **row_conditions(),
             "DUPLICATE_TRANSACTION": F.coalesce("repeat", F.lit(False))}
    message = {r["flag"]: r["message"] for r in rules.rules()}
    new = out.withColumn("_new", compact(*[
        (cond & ~F.array_contains("flags", flag), flag) for flag, cond in found.items()]))
    table = literal(message, "map<string,string>")
    new = settle(new, {"_new": F.col("_new")})
    return new.withColumns({
        "flag_notes": F.concat("flag_notes", F.transform("_new", lambda f: F.element_at(table, f))),
        "flags": F.concat("flags", "_new"),
    }).drop("_new", "mismatch", "repeat")


def _severity(flag: Column, table: dict[str, str]) -> Column:
    known = literal(table, "map<string,string>")
    return F.coalesce(F.try_element_at(known, flag), F.lit("LOW"))


def engine_severity(flag: Column) -> Column:
    return _severity(flag, {r["flag"]: r["severity"] for r in rules.rules()})


def dashboard_severity(flag: Column) -> Column:
    table = {r["flag"]: r["severity"] for r in rules.rules()}
    return _severity(flag, {**table, **rules.DASHBOARD_EXTRA})


def worst_severity(flags: Column) -> Column:
    """Most severe engine severity in the array; LOW when it is empty."""
    order = F.array(*[F.lit(s) for s in rules.SEVERITIES])
    ranks = F.transform(flags, lambda f: F.array_position(order, engine_severity(f)))
    return F.element_at(order, F.coalesce(F.array_min(ranks), F.lit(len(rules.SEVERITIES))).cast("int"))


def counts(flagged: DataFrame) -> DataFrame:
    """Occurrences per batch and flag, with both severities."""
    return (flagged.select("batch_id", F.explode("flags").alias("flag"))
            .groupBy("batch_id", "flag").agg(F.count("*").alias("occurrences"))
            .withColumn("severity", engine_severity(F.col("flag")))
            .withColumn("dashboard_severity", dashboard_severity(F.col("flag"))))


def summary(flagged: DataFrame) -> DataFrame:
    """Per batch: flags raised, rows flagged, rows by their worst severity."""
    any_flag = F.size("flags") > 0
    worst = worst_severity(F.col("flags"))
    return flagged.groupBy("batch_id").agg(
        F.sum(F.size("flags")).cast("bigint").alias("total_flags"),
        count_if(any_flag).alias("flagged_transactions"),
        *[count_if(any_flag & (worst == s)).alias(s.lower()) for s in rules.SEVERITIES])
