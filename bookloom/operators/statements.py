"""Profit and loss, tax-form lines and cost of goods, all as per-batch aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.money import MONEY, count_if, total
from bookloom.rules import accounts

PROXY_WARNING = ("Bank-proxy COGS does not reflect inventory changes. If business holds inventory, "
                 "provide beginning/ending inventory values for accurate COGS.")
NEGATIVE_WARNING = ("Computed COGS is negative. Verify inventory values and purchase amounts. "
                    "Ending inventory may be overstated.")
EXCESS_WARNING = ("Ending inventory exceeds beginning + purchases. Verify no inventory was received "
                  "without a bank transaction.")
SPIKE_ALERT = ("Inventory purchases significantly exceed revenue. Possible stock build-up or "
               "timing difference.")


def pnl_lines(balance: DataFrame) -> DataFrame:
    """One row per profit-and-loss account with its section and absolute amount."""
    section = (F.when(F.col("type") == "REVENUE", "revenue").when(F.col("type") == "COGS", "cogs")
               .when((F.col("type") == "EXPENSE") & (F.col("code") == "6700"), "interest")
               .when(F.col("type") == "EXPENSE", "operating_expenses"))
    return (balance.withColumn("section", section).where(F.col("section").isNotNull())
            .withColumn("amount", F.abs("net_balance").cast(MONEY)))


def profit_and_loss(balance: DataFrame, by: list[str] = ["batch_id"]) -> DataFrame:
    """Totals by section. Every account adds its absolute net, whatever its sign."""
    amount = F.col("amount")

    def part(section: str) -> Column:
        return total(amount, F.col("section") == section)

    gross = F.col("revenue") - F.col("cogs")
    margin = F.when(F.col("revenue") != 0, F.bround(
        F.col("gross_profit") / F.col("revenue") * 100, 1)).otherwise(0)
    return (pnl_lines(balance).groupBy(*by).agg(
        part("revenue").alias("revenue"), part("cogs").alias("cogs"),
        part("operating_expenses").alias("operating_expenses"),
        part("interest").alias("interest_expense"), F.count("*").alias("line_items"))
        .withColumn("gross_profit", gross.cast(MONEY))
        .withColumn("gross_margin_pct", margin.cast("decimal(18,1)"))
        .withColumn("net_income", (F.col("gross_profit") - F.col("operating_expenses")
                                   - F.col("interest_expense")).cast(MONEY)))


def tax_line_map(code: Column) -> Column:
    chain = F
    grouped: dict[str, list[str]] = {}
    for row in accounts.tax_lines():
        grouped.setdefault(row["line"], []).append(row["code"])
    for line, codes in grouped.items():
        chain = chain.when(code.isin(codes), F.lit(line))
    return chain


def tax_lines(rows: DataFrame, by: list[str] = ["batch_id"]) -> DataFrame:
    """Total and count per tax-form line; amounts add up whatever their direction."""
    return (rows.withColumn("tax_line", tax_line_map(F.col("account_code")))
            .where(F.col("tax_line").isNotNull())
            .groupBy(*by, "tax_line")
            .agg(total(F.col("amount")).alias("total"), F.count("*").alias("transaction_count")))


def tax_items(rows: DataFrame) -> DataFrame:
    """The transactions behind each tax-form line."""
    return (rows.withColumn("tax_line", tax_line_map(F.col("account_code")))
            .where(F.col("tax_line").isNotNull())
            .select("batch_id", "seq", "tax_line", "date", "description", "amount", "account_code"))


def tax_unmapped(rows: DataFrame) -> DataFrame:
    """Transactions whose account is on no tax-form line."""
    return rows.where(tax_line_map(F.col("account_code")).isNull()).select(
        "batch_id", "seq", "date", "description", "amount", "account_code")


def tax_summary(rows: DataFrame, by: list[str] = ["batch_id"]) -> DataFrame:
    line = F.col("tax_line")
    gross, cogs, other = accounts.INCOME_LINES
    return (rows.withColumn("tax_line", tax_line_map(F.col("account_code"))).groupBy(*by).agg(
        total(F.col("amount"), line == gross).alias("gross_receipts"),
        total(F.col("amount"), line == cogs).alias("cogs"),
        total(F.col("amount"), line == other).alias("other_income"),
        total(F.col("amount"), line.isNotNull() & ~line.isin(*accounts.INCOME_LINES))
        .alias("total_expenses"),
        count_if(line.isNull()).alias("unmapped_count"))
        .withColumn("gross_profit", (F.col("gross_receipts") - F.col("cogs")).cast(MONEY))
        .withColumn("total_income", (F.col("gross_profit") + F.col("other_income")).cast(MONEY))
        .withColumn("net_profit", (F.col("total_income") - F.col("total_expenses")).cast(MONEY)))


def _purchase() -> Column:
    return (F.col("direction") == "DEBIT") & F.col("account_code").isin(accounts.COGS_CODES)


def cogs_proxy(rows: DataFrame, by: list[str] = ["batch_id"]) -> DataFrame:
    """Cost of goods from bank activity alone."""
    code = F.col("account_code")
    material, sub = code.isin(accounts.MATERIAL_CODES), code.isin(accounts.SUBCONTRACT_CODES)
    return rows.groupBy(*by).agg(
        total(F.col("amount"), _purchase() & ~material & ~sub).alias("purchases_total"),
        total(F.col("amount"), _purchase() & material).alias("direct_materials"),
        total(F.col("amount"), _purchase() & sub).alias("subcontractor_costs"),
        total(F.col("amount"), _purchase()).alias("cogs_total")) \
        .withColumn("warning", F.when(F.col("cogs_total") > 0, PROXY_WARNING))


def cogs_inventory(rows: DataFrame, inventory: DataFrame, by: list[str] = ["batch_id"]) -> DataFrame:
    """Beginning inventory + purchases + labor + materials + other - ending inventory."""
    bought = rows.groupBy(*by).agg(total(F.col("amount"), _purchase()).alias("purchases"))
    start, end = F.col("beginning_inventory"), F.col("ending_inventory")
    goods = (start + F.col("purchases") + F.col("labor") + F.col("materials") + F.col("other")
             - end).cast(MONEY)
    return (inventory.join(bought, by, "left")
            .withColumn("purchases", F.coalesce("purchases", F.lit(0)).cast(MONEY))
            .withColumn("cogs_total", goods)
            .withColumn("warnings", F.array_compact(F.array(
                F.when(F.col("cogs_total") < 0, NEGATIVE_WARNING),
                F.when(end > start + F.col("purchases"), EXCESS_WARNING)))))


def inventory_spikes(rows: DataFrame) -> DataFrame:
    """Client months whose purchases have no revenue, or more than twice it, against them."""
    month = F.when(F.col("date") != "", F.substring("date", 1, 7)).otherwise("unknown")
    income = (F.col("direction") == "CREDIT") & (F.col("account_type") == "REVENUE")
    return (rows.groupBy("client_id", month.alias("month")).agg(
        total(F.col("amount"), _purchase()).alias("purchases"),
        total(F.col("amount"), income).alias("revenue"))
        .where((F.col("purchases") > 0)
               & ((F.col("revenue") == 0) | (F.col("purchases") > F.col("revenue") * 2)))
        .withColumn("alert", F.lit(SPIKE_ALERT)))
