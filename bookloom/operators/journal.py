"""Double-entry journal lines and the trial balance they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.money import MONEY, total
from bookloom.operators.categorize import chart_map

CASH = "1000"
CASH_NAME = "Checking Account"
LINE = ("struct<line:int,account:string,account_name:string,debit:decimal(18,2),"
        "credit:decimal(18,2),memo:string,flag:string>")


def _line(n: int, account, name, debit=None, credit=None, memo=None, flag="") -> Column:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    zero = F.lit(0).cast(MONEY)
    return F.struct(F.lit(n).alias("line"), col(account).alias("account"),
                    col(name).alias("account_name"),
                    (zero if debit is None else debit.cast(MONEY)).alias("debit"),
                    (zero if credit is None else credit.cast(MONEY)).alias("credit"),
                    col(memo).alias("memo"), col(flag).alias("flag")).cast(LINE)


def lines(cash: str = CASH) -> Column:
    """Journal lines of a categorised row, as an array."""
    code = F.coalesce(F.nullif(F.col("account_code"), F.lit("")), F.lit("6900"))
    name = F.coalesce(F.nullif(F.col("account_name"), F.lit("")), F.lit("Miscellaneous"))
    kind, debit = F.col("account_type"), F.col("direction") == "DEBIT"
    amount, text = F.col("amount").cast(MONEY), F.col("description")

    def out(memo=text, flag="", account=code, label=name):
        return F.array(_line(1, account, label, debit=amount, memo=memo, flag=flag),
                       _line(2, cash, CASH_NAME, credit=amount, memo=memo))

    def into(memo=text, account=code, label=name):
        return F.array(_line(1, cash, CASH_NAME, debit=amount, memo=memo),
                       _line(2, account, label, credit=amount, memo=memo))

    tag = F.when(F.col("loan_estimated"), " (ESTIMATED)").otherwise("")
    fees = F.coalesce("loan_fees", F.lit(0)).cast(MONEY)

    def split(with_fee: bool) -> Column:
        parts = [
            _line(1, code, name, debit=F.col("loan_principal"),
                  memo=F.concat(F.lit("Loan principal"), tag, F.lit(" - "), text)),
            _line(2, "6700", "Interest Expense", debit=F.col("loan_interest"),
                  memo=F.concat(F.lit("Loan interest"), tag, F.lit(" - "), text))]
        if with_fee:
            parts.append(_line(3, "6300", "Bank Service Charges", debit=fees,
                               memo=F.concat(F.lit("Loan fee - "), text)))
        parts.append(_line(len(parts) + 1, cash, CASH_NAME, credit=amount, memo=text))
        return F.array(*parts)

    has_split = F.col("loan_interest").isNotNull() & F.col("loan_principal").isNotNull()
    repay = (kind == "LIABILITY") & debit
    unsplit = ("Unsplit loan payment — principal/interest unknown. Full amount to liability. "
               "Interest portion NOT on P&L.")
    return (F.when(kind.isin("EXPENSE", "COGS") & debit, out())
            .when((kind == "REVENUE") & ~debit, into())
            .when(repay & has_split & (fees > 0), split(True))
            .when(repay & has_split, split(False))
            .when(repay, out(flag=unsplit))
            .when(code == "3100", out("Owner distribution", "NOT TAX DEDUCTIBLE — reduces equity",
                                      F.lit("3100"), F.lit("Owner's Draw")))
            .when(code == "3200", into("Owner contribution", F.lit("3200"),
                                       F.lit("Owner's Contributions")))
            .when(debit, out())
            .otherwise(into()))


def post(rows: DataFrame, cash: str = CASH) -> DataFrame:
    """Add the entry: id, lines, totals, balance check; flag what does not balance.

    Totals and sides follow `lines`, but are told from the row: one debit and one credit of the
    amount, or the parts of a loan payment against it."""
    code = F.coalesce(F.nullif(F.col("account_code"), F.lit("")), F.lit("6900"))
    kind, debit, amount = F.col("account_type"), F.col("direction") == "DEBIT", F.col("amount").cast(MONEY)
    fees = F.coalesce("loan_fees", F.lit(0)).cast(MONEY)
    parts = (F.col("loan_principal").cast(MONEY) + F.col("loan_interest").cast(MONEY)
             + F.greatest(fees, F.lit(0).cast(MONEY)))
    repay = F.coalesce((kind == "LIABILITY") & debit, F.lit(False))
    split = repay & F.col("loan_interest").isNotNull() & F.col("loan_principal").isNotNull()
    cost, income = kind.isin("EXPENSE", "COGS") & debit, (kind == "REVENUE") & ~debit
    # whether the account is debited: the order of `lines`
    out = F.when(cost, True).when(income, False).when(repay, True).when(code == "3100", True) \
        .when(code == "3200", False).otherwise(F.coalesce(debit, F.lit(False)))
    done = rows.withColumns({
        "journal_lines": lines(cash), "entry_id": F.substring(F.md5("transaction_id"), 1, 8),
        "entry_debits": F.when(split, parts).otherwise(amount).cast(MONEY), "entry_credits": amount,
        "debit_account": F.when(out, code).otherwise(cash),
        "credit_account": F.when(split, "6700").when(out, cash).otherwise(code)})
    done = done.withColumn("entry_balanced", F.col("entry_debits") == F.col("entry_credits"))
    off = ~F.col("entry_balanced")
    note = F.concat(F.lit("JE "), F.col("entry_id"), F.lit(" debits="),
                    F.col("entry_debits").cast("string"), F.lit(" credits="),
                    F.col("entry_credits").cast("string"))
    return done.withColumns({
        "flags": F.when(off, F.array_append("flags", F.lit("UNBALANCED_ENTRY")))
        .otherwise(F.col("flags")),
        "flag_notes": F.when(off, F.array_append("flag_notes", note))
        .otherwise(F.col("flag_notes"))})


def journal(posted: DataFrame) -> DataFrame:
    """One row per journal line."""
    return (posted.select("batch_id", "seq", "transaction_id", "entry_id", "date",
                          F.explode("journal_lines").alias("l"))
            .select("*", "l.*").drop("l"))


def trial_balance(journal_lines: DataFrame, by: list[str] = ["batch_id"]) -> DataFrame:
    """Debit, credit and net per account. The name is that of the account's first line.

    Lines are summed per account and name with numbers only, so the large aggregation hashes;
    the first name is picked from those few rows."""
    net = (F.col("total_debit") - F.col("total_credit")).cast(MONEY)
    entry = F.try_element_at(chart_map(), F.col("account"))
    zero = F.lit(0).cast(MONEY)
    place = F.col("seq").cast("decimal(38,0)") * 8 + F.col("line")  # an entry has four lines at most
    named = journal_lines.groupBy(*by, "account", "account_name").agg(
        F.min(place).alias("place"), total(F.col("debit")).alias("debit"),
        total(F.col("credit")).alias("credit"))
    return (named.groupBy(*by, "account").agg(
        F.min_by("account_name", "place").alias("name"),
        total(F.col("debit")).alias("total_debit"), total(F.col("credit")).alias("total_credit"))
        .withColumns({"type": F.coalesce(entry["type"], F.lit("UNKNOWN")),
                      "normal_balance": F.coalesce(entry["side"], F.lit("DEBIT")),
                      "net_balance": net})
        .withColumns({
            "balance_debit": F.greatest("net_balance", zero).cast(MONEY),
            "balance_credit": F.greatest(-F.col("net_balance"), zero).cast(MONEY)})
        .withColumnRenamed("account", "code"))


#: Levels of `rollup`, from one account of one batch to everything.
LEVELS = [("client_id", "batch_id", "type", "code"), ("client_id", "batch_id", "type"),
          ("client_id", "batch_id"), ("client_id", "type", "code"), ("client_id", "type"),
          ("client_id",), ("type", "code"), ("type",), ()]


def rollup(balance: DataFrame, batches: DataFrame) -> DataFrame:
    """Trial balances added up on every level in one pass; ``level`` has a bit for each of client,
    batch, type and account that is not told apart, the account's the lowest."""
    rows = balance.join(batches.select("batch_id", "client_id"), "batch_id")
    return rows.groupingSets(LEVELS, *LEVELS[0]).agg(
        F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("balances"),
        total(F.col("total_debit")).alias("total_debit"), total(F.col("total_credit")).alias("total_credit"),
        total(F.col("net_balance")).alias("net_balance"))


def trial_totals(balance: DataFrame, by: list[str] = ["batch_id"]) -> DataFrame:
    return (balance.groupBy(*by).agg(
        total(F.col("total_debit")).alias("total_debits"),
        total(F.col("total_credit")).alias("total_credits"),
        F.count("*").alias("account_count"))
        .withColumn("difference", (F.col("total_debits") - F.col("total_credits")).cast(MONEY))
        .withColumn("is_balanced", F.col("difference") == 0))


def by_type(balance: DataFrame, by: list[str] = ["batch_id"]) -> DataFrame:
    return balance.groupBy(*by, "type").agg(
        F.count("*").alias("accounts"), total(F.col("total_debit")).alias("total_debit"),
        total(F.col("total_credit")).alias("total_credit"),
        total(F.col("net_balance")).alias("net_balance"))


def out_of_balance(balance: DataFrame, by: list[str] = ["batch_id"]) -> DataFrame:
    return trial_totals(balance, by).where(~F.col("is_balanced"))
