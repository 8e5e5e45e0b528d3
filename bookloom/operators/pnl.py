"""The simple profit-and-loss path: keyword buckets, measures, checks and scorecard.

Rows carry a signed ``amount`` and a ``kind`` of credit or debit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.functions.matching import compact, first_word, pick
from bookloom.functions.money import MONEY, count_if, total
from bookloom.functions.plan import settle
from bookloom.operators.texts import distinct, meet
from bookloom.rules import keywords as rules

BUCKETS = ["gross_revenue", "refunds", "inventory_costs", "direct_labor", "rent", "utilities",
           "insurance", "marketing", "software", "bank_fees", "other_opex", "interest_expense",
           "taxes", "uncategorized_income", "uncategorized_expense"]
PCT = "decimal(18,2)"


def keyword_hit(description: Column) -> Column:
    table = rules.rules()
    return pick([{k: r[k] for k in ("category", "subcategory")} for r in table],
                "category:string,subcategory:string",
                first_word(F.lower(description), [r["keyword"] for r in table]))


def categorize(rows: DataFrame) -> DataFrame:
    """First keyword in scan order decides; otherwise the sign does, and the row is flagged. Keywords are
    looked for once in each distinct description."""
    found = settle(distinct(rows, ["description"]), {"_hit": keyword_hit(F.col("description"))})
    out = meet(rows, found, ["description"])
    hit, credit = F.col("_hit"), F.col("kind") == "credit"
    return out.withColumns({
        "category": F.coalesce(hit["category"], F.when(credit, "revenue").otherwise("opex")),
        "subcategory": F.coalesce(hit["subcategory"], F.when(
            credit, "uncategorized_income").otherwise("other_opex")),
        "confidence": F.when(hit.isNotNull(), "auto").otherwise("flagged")}).drop("_hit")


def batch_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    flagged, moved = F.col("confidence") == "flagged", F.col("category") == "transfer"
    return rows.groupBy(*by).agg(
        count_if(~flagged & ~moved).alias("auto_categorized"),
        count_if(flagged).alias("needs_review"), count_if(moved).alias("transfers_skipped"),
        F.count("*").alias("total"))


def breakdown(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "category", "subcategory").agg(
        total(F.abs("amount")).alias("total"), F.count("*").alias("rows"))


def rollup(rows: DataFrame) -> DataFrame:
    """Breakdown on every level from a subcategory of one client's period to everything, in one pass
    over the finest sums; ``level`` has a bit for each column that is not told apart."""
    by = ["client_id", "period", "category", "subcategory"]
    levels = [by, by[:3], by[:2], ["client_id", *by[2:]], ["client_id", "category"], ["client_id"],
              by[2:], ["category"], []]
    return breakdown(rows, by[:2]).groupingSets([tuple(x) for x in levels], *by).agg(
        F.grouping_id().cast("bigint").alias("level"), total(F.col("total")).alias("total"),
        F.sum("rows").alias("rows"))


def build(rows: DataFrame, by: list[str]) -> DataFrame:
    """One statement per key: money buckets, uncategorised amounts and counts."""
    cat, sub = F.col("category"), F.col("subcategory")
    opex = cat == "opex"
    listed = ["revenue", "refund_out", "cogs", "opex", "debt", "transfer"]
    unknown = ~cat.isin(listed)
    labor = (cat == "cogs") & (sub == "direct_labor")
    when = {
        "gross_revenue": cat == "revenue", "refunds": cat == "refund_out",
        "inventory_costs": (cat == "cogs") & ~labor, "direct_labor": labor,
        **{b: opex & (sub == b) for b in rules.OPEX_BUCKETS},
        "other_opex": (opex & ~sub.isin(rules.OPEX_BUCKETS)) | unknown,
        "interest_expense": cat == "debt", "taxes": F.lit(False),
        "uncategorized_income": (cat == "revenue") & (sub == "uncategorized_income"),
        "uncategorized_expense": (opex & ~sub.isin(rules.OPEX_BUCKETS + rules.OPEX_KNOWN)) | unknown,
    }
    # summed per subcategory first, so that rows are added up once and not for every bucket
    parts = rows.groupBy(*by, "category", "subcategory", "confidence").agg(
        F.sum(F.abs("amount")).alias("amount"), F.count("*").alias("rows"))
    flagged = F.when(F.col("confidence") == "flagged", F.col("rows")).otherwise(0)
    return parts.groupBy(*by).agg(
        *[total(F.col("amount"), when[b]).alias(b) for b in BUCKETS],
        F.sum("rows").alias("transaction_count"), F.sum(flagged).alias("flagged_count"))


# What a statement always assumes, and what it assumes with interest in it.
ASSUMED = ["P&L derived from bank-statement categorization (cash basis).",
           "COGS is bank-proxy only; no inventory adjustments applied."]
ASSUMED_INTEREST = "Loan interest routed to expense; principal excluded from P&L."


def assumptions() -> Column:
    """The disclosure lines of a built statement."""
    more = F.when(F.col("interest_expense") > 0, F.lit(ASSUMED_INTEREST))
    return F.array_compact(F.array(*[F.lit(a) for a in ASSUMED], more))


def pct(part: Column, whole: Column) -> Column:
    """Percent to two digits, half up; zero when the whole is not positive."""
    return F.when(whole > 0, F.round(part / whole * 100, 2)).otherwise(0).cast(PCT)


def pct_nonzero(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(part / whole * 100, 2)).otherwise(0).cast(PCT)


def measures(pl: DataFrame) -> DataFrame:
    """Derived amounts and margins."""
    c = F.col
    opex = sum((c(b) for b in rules.OPEX_BUCKETS), c("other_opex"))
    out = (pl.withColumn("net_revenue", (c("gross_revenue") - c("refunds")).cast(MONEY))
           .withColumn("total_cogs", (c("inventory_costs") + c("direct_labor")).cast(MONEY))
           .withColumn("total_opex", opex.cast(MONEY))
           .withColumn("gross_profit", (c("net_revenue") - c("total_cogs")).cast(MONEY))
           .withColumn("operating_income", (c("gross_profit") - c("total_opex")).cast(MONEY))
           .withColumn("net_profit", (c("operating_income") - c("interest_expense")
                                      - c("taxes")).cast(MONEY)))
    net = c("net_revenue")
    return out.withColumns({
        "gross_margin_pct": pct(c("gross_profit"), net),
        "operating_margin_pct": pct(c("operating_income"), net),
        "net_margin_pct": pct(c("net_profit"), net),
        "cogs_pct": pct_nonzero(c("total_cogs"), net),
        "opex_pct": pct_nonzero(c("total_opex"), net),
        "rent_pct": pct_nonzero(c("rent"), net)})


def compare(pl: DataFrame, key: str, period: str) -> DataFrame:
    """Each period against the one before it, per key."""
    w = W.partitionBy(key).orderBy(period)
    names = ["net_revenue", "net_profit", "total_cogs", "total_opex", "net_margin_pct"]
    prev = {f"_{n}": F.lag(n).over(w) for n in names}
    change = lambda n: F.when(F.col(f"_{n}") == 0, 0).otherwise(
        F.round((F.col(n) - F.col(f"_{n}")) / F.col(f"_{n}") * 100, 2)).cast(PCT)
    return (pl.withColumns({**prev, "from_period": F.lag(period).over(w)})
            .where(F.col("from_period").isNotNull())
            .select(key, "from_period", F.col(period).alias("to_period"),
                    change("net_revenue").alias("revenue_change_pct"),
                    change("net_profit").alias("profit_change_pct"),
                    (F.col("net_margin_pct") - F.col("_net_margin_pct")).cast(PCT)
                    .alias("margin_change"),
                    change("total_cogs").alias("cogs_change_pct"),
                    change("total_opex").alias("opex_change_pct")))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def flagged_share(pl_count: Column, flagged: Column) -> Column:
    return F.bround((flagged * 100).cast("decimal(20,0)") / F.greatest(pl_count, F.lit(1)), 0) \
        .cast("bigint")


def warnings(pl: DataFrame) -> Column:
    """Statement warnings in their usual order."""
    c = F.col
    again = (c("net_revenue") - c("total_cogs") - c("total_opex") - c("interest_expense")
             - c("taxes")).cast(MONEY)
    share = flagged_share(c("transaction_count"), c("flagged_count"))
    return compact(
        (again != c("net_profit"), _text("MATH_ERROR: recomputed net_profit ", again.cast("string"),
                                         " != ", _s("net_profit"))),
        ((c("refunds") > c("gross_revenue")) & (c("gross_revenue") > 0),
         "SEMANTIC: refunds exceed gross revenue; check refund classification."),
        ((c("net_revenue") <= 0) & ((c("total_opex") > 0) | (c("total_cogs") > 0)),
         "DISCLOSURE: net revenue <= 0; margins suppressed to 0%. Review deposits/refunds."),
        ((c("net_revenue") > 0) & (c("gross_margin_pct") > 90),
         "SEMANTIC: gross margin unusually high; verify COGS categorization."),
        (c("gross_profit") > c("net_revenue"), _text(
            "WARNING: Gross profit $", _s("gross_profit"), " exceeds net revenue $",
            _s("net_revenue"), " — check COGS")),
        (c("net_profit") < 0, _text("ALERT: Business operating at a loss of $",
                                    F.abs("net_profit").cast("string"))),
        (c("flagged_count") > 0, _text(
            "REVIEW: ", _s("flagged_count"), " of ", _s("transaction_count"), " transactions (",
            share.cast("string"), "%) need manual review")),
        (c("uncategorized_income") > 0, _text(
            "UNCATEGORIZED: $", _s("uncategorized_income"),
            " income could not be auto-classified")),
        (c("uncategorized_expense") > 0, _text(
            "UNCATEGORIZED: $", _s("uncategorized_expense"),
            " expenses could not be auto-classified")))


CHECKS = ["Accounting Equation", "Revenue Sign", "Margin Bounds", "COGS Ratio", "Rent Ratio",
          "Uncategorized", "Flagged Ratio", "Zero Revenue"]


def checks(pl: DataFrame, by: list[str]) -> DataFrame:
    """The eight statement checks, one row each, with status and detail."""
    c = F.col
    net, margin = c("net_revenue"), c("gross_margin_pct")
    again = (net - c("total_cogs") - c("total_opex") - c("interest_expense") - c("taxes")).cast(MONEY)
    open_amount = (c("uncategorized_income") + c("uncategorized_expense")).cast(MONEY)
    open_pct = pct(open_amount, net)
    share = flagged_share(c("transaction_count"), c("flagged_count"))
    skipped = _text("No revenue — skipped")

    def row(name: str, *cases, otherwise) -> Column:
        chain = F
        for cond, status, detail in cases:
            chain = chain.when(cond, F.struct(F.lit(status).alias("status"), detail.alias("detail")))
        last = F.struct(F.lit(otherwise[0]).alias("status"), otherwise[1].alias("detail"))
        return F.struct(F.lit(name).alias("name"), chain.otherwise(last).alias("r"))

    listed = F.array(
        row("Accounting Equation", (again == c("net_profit"), "pass", _text("Equation balances")),
            otherwise=("fail", _text("Recalculated $", again.cast("string"), " ≠ reported $",
                                     _s("net_profit")))),
        row("Revenue Sign", (c("gross_revenue") >= 0, "pass", _text("Revenue is non-negative")),
            otherwise=("fail", _text("Negative revenue $", _s("gross_revenue"),
                                     " — likely misclassified debits"))),
        row("Margin Bounds", (net == 0, "pass", skipped),
            (margin > 95, "warn", _text("Gross margin ", margin.cast("string"),
                                        "% is unusually high — verify COGS")),
            (margin < -50, "warn", _text(
                "Gross margin ", margin.cast("string"),
                "% is deeply negative — verify revenue classification")),
            otherwise=("pass", _text("Gross margin ", margin.cast("string"), "% within range"))),
        row("COGS Ratio", (net == 0, "pass", skipped),
            (c("cogs_pct") > 100, "warn", _text(
                "COGS is ", _s("cogs_pct"), "% of revenue — business is losing money on production")),
            otherwise=("pass", _text("COGS ", _s("cogs_pct"), "% of revenue"))),
        row("Rent Ratio", (net == 0, "pass", skipped),
            (c("rent_pct") > 15, "warn", _text("Rent is ", _s("rent_pct"),
                                               "% of revenue — above 15% threshold")),
            otherwise=("pass", _text("Rent ", _s("rent_pct"), "% of revenue"))),
        row("Uncategorized", (open_amount == 0, "pass", _text("All transactions categorized")),
            ((net > 0) & (open_pct > 10), "warn", _text(
                "$", open_amount.cast("string"), " uncategorized (", open_pct.cast("string"),
                "% of revenue) — needs review")),
            otherwise=("pass", _text("$", open_amount.cast("string"), " uncategorized — minor"))),
        row("Flagged Ratio", (c("transaction_count") == 0, "pass", _text("No transactions")),
            (share > 20, "warn", _text(share.cast("string"),
                                       "% of transactions flagged — consider tuning categories.json")),
            otherwise=("pass", _text(share.cast("string"), "% flagged — acceptable"))),
        row("Zero Revenue", ((net == 0) & (c("total_opex") > 0), "warn", _text(
            "Zero revenue but $", _s("total_opex"),
            " in expenses — check if income deposits were misclassified")),
            otherwise=("pass", _text("Revenue present"))))
    return (pl.select(*by, F.posexplode(listed).alias("position", "_c"))
            .select(*by, "position", F.col("_c.name").alias("name"),
                    F.col("_c.r.status").alias("status"), F.col("_c.r.detail").alias("detail")))


def check_summary(check_rows: DataFrame, by: list[str]) -> DataFrame:
    status = F.col("status")
    return (check_rows.groupBy(*by).agg(
        F.count("*").alias("total_checks"), count_if(status == "pass").alias("passed"),
        count_if(status == "warn").alias("warnings"), count_if(status == "fail").alias("failures"))
        .withColumn("overall", F.when(F.col("failures") > 0, "FAIL")
                    .when(F.col("warnings") > 0, "REVIEW").otherwise("PASS")))


METRICS = ["gross_margin", "net_margin", "rent", "cogs"]


def score(pl: DataFrame, industry: str = "general") -> DataFrame:
    """Add one struct per metric (status, value, flag, action, benchmark), and ``overall``. The
    benchmark is named for the gross margin only.

    Rent and cost of goods are scored only when there are any.
    """
    bench, label = rules.benchmarks()[industry], rules.INDUSTRY_NAMES[industry]
    c = F.col

    def grade(value: str, steps, otherwise) -> Column:
        def out(status, flag, action=None, benchmark=None):
            a = action if isinstance(action, Column) else F.lit(action)
            return F.struct(F.lit(status).alias("status"), c(value).alias("value"),
                            F.lit(flag).alias("flag"), a.cast("string").alias("action"),
                            F.lit(benchmark).cast("double").alias("benchmark"))
        chain = F
        for cond, *rest in steps:
            chain = chain.when(cond, out(*rest))
        return chain.otherwise(out(*otherwise))

    one_digit = lambda col: F.round(col, 1).cast("decimal(18,1)").cast("string")
    gm, nm = bench["gross_margin_pct"], bench["net_margin_pct"]
    rent, cogs = bench["rent_pct_of_revenue"], bench["cogs_pct"]
    m, n, r, g = c("gross_margin_pct"), c("net_margin_pct"), c("rent_pct"), c("cogs_pct")
    metrics = {
        "gross_margin": grade("gross_margin_pct", [
            (m >= gm["excellent"], "EXCELLENT", "green", None, gm["excellent"]),
            (m >= gm["healthy"], "HEALTHY", "green", None, gm["healthy"]),
            (m >= gm["low"], "BELOW AVERAGE", "yellow", _text(
                "Gross margin is ", one_digit(F.lit(gm["healthy"]) - m),
                f"% below target. Review {label} COGS."), gm["healthy"])],
            ("CRITICAL", "red", "Immediate cost review needed", gm["low"])),
        "net_margin": grade("net_margin_pct", [
            (n >= nm["excellent"], "EXCELLENT", "green"), (n >= nm["healthy"], "HEALTHY", "green"),
            (n >= nm["average"], "AVERAGE", "yellow",
             "Look for OPEX savings to improve bottom line")],
            ("STRUGGLING", "red", "Business profitability needs immediate attention")),
        "rent": F.when(r > 0, grade("rent_pct", [
            (r <= rent["ideal"], "IDEAL", "green"),
            (r <= rent["warning"], "ACCEPTABLE", "yellow", "Rent approaching warning threshold")],
            ("TOO HIGH", "red", _text("Rent is ", one_digit(r),
                                      "% of revenue — negotiate or relocate")))),
        "cogs": F.when(g > 0, grade("cogs_pct", [
            (g <= cogs["low"], "LOW", "green", "Verify all direct costs are captured in COGS"),
            (g <= cogs["healthy"], "HEALTHY", "green"),
            (g <= cogs["high"], "ELEVATED", "yellow", "Review supplier pricing and waste")],
            ("CRITICAL", "red", "Direct costs consuming too much revenue")))}
    out = pl.withColumns(metrics)
    flags = F.array(*[c(f"{name}.flag") for name in METRICS])
    return out.withColumn("industry", F.lit(label)).withColumn(
        "overall", F.when(F.array_contains(F.array_compact(flags), "red"), "NEEDS ATTENTION")
        .when(F.array_contains(F.array_compact(flags), "yellow"), "ROOM FOR IMPROVEMENT")
        .otherwise("HEALTHY"))


def scorecard(scored: DataFrame, by: list[str]) -> DataFrame:
    """Scored statements as one row per metric."""
    listed = F.array(*[F.when(F.col(n).isNotNull(), F.struct(
        F.lit(i).alias("position"), F.lit(n).alias("metric"), F.col(n).alias("m")))
        for i, n in enumerate(METRICS)])
    return (scored.select(*by, "industry", "overall", F.explode(F.array_compact(listed)).alias("x"))
            .select(*by, "industry", "overall", "x.position", "x.metric", "x.m.*"))


def recommendations(limit: int = 5) -> Column:
    """Actions of the red and yellow metrics, in metric order."""
    acts = compact(*[(F.col(f"{n}.flag").isin("red", "yellow"), F.col(f"{n}.action"))
                     for n in METRICS])
    return F.slice(acts, 1, limit)


def snapshot(scored: DataFrame, by: list[str]) -> DataFrame:
    whole = lambda n: F.col(n).cast("bigint").alias(n.replace("_pct", ""))
    return scored.select(
        *by, "net_revenue", "gross_profit", "net_profit", whole("gross_margin_pct"),
        whole("net_margin_pct"), "operating_margin_pct", "cogs_pct", "rent_pct", "total_opex",
        "transaction_count", "flagged_count", F.col("overall").alias("business_health"),
        recommendations(3).alias("top_actions"))


# Rows of the percent-of-revenue table, as label|amount|percent.
LINE_ITEMS = """
Gross Revenue|gross_revenue|
Less: Refunds|refunds|
NET REVENUE|net_revenue|100
Inventory / Materials|inventory_costs|
Direct Labor|direct_labor|
TOTAL COGS|total_cogs|cogs_pct
GROSS PROFIT|gross_profit|gross_margin_pct
Rent|rent|rent_pct
Utilities|utilities|
Insurance|insurance|
Marketing|marketing|
Software / Subscriptions|software|
Bank Fees|bank_fees|
Other Operating|other_opex|
TOTAL OPERATING EXPENSES|total_opex|opex_pct
OPERATING INCOME|operating_income|operating_margin_pct
Loan / Debt Payments|interest_expense|
NET PROFIT (BOTTOM LINE)|net_profit|net_margin_pct
"""


def line_items() -> list[tuple[str, str, str]]:
    return [tuple(x.split("|")) for x in LINE_ITEMS.strip().splitlines()]


def revenue_table(pl: DataFrame, by: list[str]) -> DataFrame:
    def share(p: str) -> Column:
        if not p:
            return F.lit(None).cast(PCT)
        return (F.lit(100) if p == "100" else F.col(p)).cast(PCT)

    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"),
                              F.col(amount).alias("amount"), share(p).alias("pct_of_revenue"))
                     for i, (label, amount, p) in enumerate(line_items())])
    return pl.select(*by, F.explode(rows).alias("x")).select(*by, "x.*")
