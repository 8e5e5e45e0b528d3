"""Validation issues and acceptance gates per batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.matching import any_of, compact, contains_any
from bookloom.functions.money import MONEY, count_if, total

GATES = ["arithmetic", "structural", "disclosure", "review"]
ISSUE = ["batch_id", "transaction_id", "category", "severity", "code", "message"]
# Words that mark a loan, an owner draw and an asset.
LOAN_WORDS = ["LOAN", "SBA", "NOTE PAYMENT"]
DRAW_WORDS = ["OWNER DRAW", "OWNER DISTRIBUTION", "PERSONAL"]
ASSET_WORDS = ["VEHICLE", "EQUIPMENT", "MACHINERY", "COMPUTER", "LAPTOP"]


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def row_checks() -> dict[str, tuple[str, str, Column, Column]]:
    """code -> (category, severity, condition, message), in the order checks run."""
    text, said, amount = F.upper("description"), F.col("description"), F.col("amount")
    kind, credit = F.col("account_type"), F.col("direction") == "CREDIT"
    dollars = amount.cast("string")
    expense = kind == "EXPENSE"
    return {
        "UNBALANCED_JE": ("structural", "CRITICAL", ~F.col("entry_balanced"), _text(
            "Journal entry ", F.col("entry_id"), " is unbalanced: debits=",
            F.col("entry_debits").cast("string"), " credits=", F.col("entry_credits").cast("string"))),
        "ZERO_AMOUNT": ("structural", "MEDIUM", amount == 0, _text(
            "Transaction has zero amount: '", said, "'")),
        "CREDIT_TO_EXPENSE": ("semantic", "HIGH", credit & expense, _text(
            "Credit (deposit) posted to expense account ", F.col("account_code"), ". '", said,
            "' — likely should be revenue or refund.")),
        "LOAN_AS_EXPENSE": ("semantic", "HIGH", expense & contains_any(text, LOAN_WORDS), _text(
            "Loan payment '", said, "' posted as expense. Principal portion should reduce "
            "liability, not hit P&L.")),
        "LARGE_UNVERIFIED_REVENUE": (
            "semantic", "MEDIUM", credit & (amount >= 5000) & (kind == "REVENUE")
            & F.col("inflow_type").isin("UNKNOWN", ""), _text(
                "Large deposit $", dollars, " classified as revenue without inflow verification. '",
                said, "'")),
        "DRAW_AS_EXPENSE": ("semantic", "HIGH", expense & contains_any(text, DRAW_WORDS), _text(
            "Possible owner draw '", said, "' classified as expense. Owner draws are equity "
            "reductions, NOT deductible expenses.")),
        "MEALS_FULL_DEDUCTION": (
            "semantic", "MEDIUM", (F.col("account_code") == "6150") & (F.col("deductible_pct") == 1),
            _text("Meals expense '", said, "' at 100% deduction. IRS limits most business meals to "
                  "50% deductible.")),
        "CAPEX_AS_EXPENSE": (
            "semantic", "HIGH", expense & (amount > 2500) & ~F.col("is_capex")
            & contains_any(text, ASSET_WORDS), _text(
                "$", dollars, " purchase '", said, "' may be a capital expenditure that should be "
                "depreciated, not immediately expensed.")),
    }


def row_issues(posted: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """One row per issue of a transaction: all checks in one pass, then exploded. For some ``codes``, rows
    without an issue go first: what a check asks of the row itself is then asked before rows meet decisions."""
    wanted = {code: check for code, check in row_checks().items() if codes is None or code in codes}
    found = compact(*[
        (cond, F.struct(F.lit(cat).alias("category"), F.lit(sev).alias("severity"),
                        F.lit(code).alias("code"), msg.alias("message")))
        for code, (cat, sev, cond, msg) in wanted.items()])
    if codes is not None:
        posted = posted.where(any_of([check[2] for check in wanted.values()]))
    return (posted.select("batch_id", "transaction_id", F.explode(found).alias("i"))
            .select("batch_id", "transaction_id", "i.*"))


def structural_codes() -> list[str]:
    """Codes of the row checks that are structural."""
    return [code for code, (category, *_) in row_checks().items() if category == "structural"]


STRUCTURAL_BATCH = ["TB_UNBALANCED", "RECONCILIATION_FAILED", "RECONCILIATION_WARN", "COUNT_MISMATCH"]


def batch_issues(reconciled: DataFrame, figures: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Issues of a whole batch, or those of ``codes``. ``figures`` are `batch_figures`, or as many of them
    as the codes need; for UNCATEGORIZED_REMAINING alone ``reconciled`` may be the bare batches."""
    issues = F.array_join("issues", "; ")
    seen = ["status", F.col("difference").alias("recon_diff"), "issues"]
    r = reconciled.select("batch_id", *(seen if "status" in reconciled.columns else [])).join(
        figures, "batch_id", "left")

    def issue(category, severity, code, *message) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"),
                        F.lit(code).alias("code"), _text(*message).alias("message"))

    checks = {
        "TB_UNBALANCED": (~F.col("is_balanced"), issue(
            "structural", "CRITICAL", "TB_UNBALANCED", "Trial balance out of balance by $",
            F.col("difference").cast("string"), ". Total debits != total credits.")),
        "RECONCILIATION_FAILED": (F.col("status") == "RED", issue(
            "structural", "CRITICAL", "RECONCILIATION_FAILED",
            "Bank reconciliation failed. Difference: $",
            F.coalesce(F.col("recon_diff").cast("string"), F.lit("None")), ". Issues: ", issues)),
        "RECONCILIATION_WARN": ((F.col("status") == "YELLOW") & (F.size("issues") > 0), issue(
            "structural", "MEDIUM", "RECONCILIATION_WARN",
            "Bank reconciliation has warnings: ", issues)),
        "COUNT_MISMATCH": (F.col("entries") != F.col("rows"), issue(
            "structural", "HIGH", "COUNT_MISMATCH", "Transaction count (",
            F.col("rows").cast("string"), ") != journal entry count (",
            F.col("entries").cast("string"), ").")),
        "UNCATEGORIZED_REMAINING": (F.col("uncategorized") > 0, issue(
            "semantic", "MEDIUM", "UNCATEGORIZED_REMAINING", F.col("uncategorized").cast("string"),
            " transaction(s) remain uncategorized. These require manual review before the analysis "
            "is complete."))}
    found = compact(*[check for code, check in checks.items() if codes is None or code in codes])
    return (r.select("batch_id", F.lit("").alias("transaction_id"), F.explode(found).alias("i"))
            .select("batch_id", "transaction_id", "i.*"))


#: Below this confidence a row counts as uncertain.
LOW_CONFIDENCE = 70


def uncategorized(rows: DataFrame) -> DataFrame:
    """Rows of each batch that no layer decided."""
    return rows.groupBy("batch_id").agg(_uncategorized())


def _uncategorized() -> Column:
    return count_if(F.col("categorization_layer") == "uncategorized").alias("uncategorized")


def batch_figures(posted: DataFrame, threshold: int = LOW_CONFIDENCE) -> DataFrame:
    """What the batch-level checks and gates need, in one aggregation. Debits and credits of a trial balance
    are those of its entries.

    ``threshold`` is in percent."""
    return posted.groupBy("batch_id").agg(
        F.count("*").alias("rows"), F.count("entry_id").alias("entries"), _uncategorized(),
        count_if(~F.col("entry_balanced")).alias("unbalanced"),
        count_if(F.col("account_type") == "COGS").alias("cogs_rows"),
        count_if(F.col("loan_split_source") == "unsplit").alias("unsplit"),
        count_if(F.col("confidence_score") < threshold / 100).alias("low_confidence"),
        count_if(F.col("required_review")).alias("must_review"),
        (total(F.col("entry_debits")) - total(F.col("entry_credits"))).cast(MONEY).alias("difference")) \
        .withColumn("is_balanced", F.col("difference") == 0)


def rollup(issues: DataFrame, batches: DataFrame) -> DataFrame:
    """Counts and pass marks per batch; a batch without issues passes."""
    structural, critical = F.col("category") == "structural", F.col("severity") == "CRITICAL"
    counted = issues.groupBy("batch_id").agg(
        count_if(structural).alias("structural_issues"),
        count_if(~structural).alias("semantic_issues"),
        count_if(critical).alias("critical_count"),
        count_if(structural & critical).alias("structural_critical"),
        count_if(~structural & critical).alias("semantic_critical"))
    out = batches.select("batch_id").join(counted, "batch_id", "left").fillna(0)
    return (out.withColumn("structural_pass", F.col("structural_critical") == 0)
            .withColumn("semantic_pass", F.col("semantic_critical") == 0)
            .withColumn("all_pass", F.col("structural_pass") & F.col("semantic_pass")))


def gates(figures: DataFrame, reconciled: DataFrame, validation: DataFrame | None,
          threshold: int = LOW_CONFIDENCE, method: str = "cash", only: list[str] | None = None) -> DataFrame:
    """The four gates, or those of ``only``, as columns: name -> struct(passed, details, blocker).

    Every reconciled batch has its gates, also one without transactions. ``threshold`` is the
    one that ``figures`` were made with. The structural gate reads ``validation`` and what is
    reconciled; for the others the bare batches do."""
    wanted = GATES if only is None else only
    number = [f.name for f in figures.schema if f.name not in ("batch_id", "is_balanced", "difference")]
    if "structural" in wanted:
        g = (reconciled.select("batch_id", "status", F.col("difference").alias("recon_diff"))
             .join(validation.select("batch_id", "structural_critical"), "batch_id", "left")
             .fillna(0, ["structural_critical"]))
    else:
        g = reconciled.select("batch_id")
    if wanted != ["structural"]:
        g = g.join(figures, "batch_id", "left").fillna(0, number).fillna(True, ["is_balanced"])

    def n(c: str) -> Column:
        return F.col(c).cast("string")

    findings = {
        "arithmetic": (True, "All totals, margins, and rollups exact.", [
            (F.col("unbalanced") > 0, _text(n("unbalanced"), " unbalanced journal entries")),
            (~F.col("is_balanced"), _text("Trial balance out of balance by $", n("difference")))]),
        "structural": (True, "All structural integrity checks pass.", [
            (F.col("status") == "RED", _text("Bank reconciliation RED: diff=$", F.coalesce(
                n("recon_diff"), F.lit("None")))),
            (F.col("structural_critical") > 0, _text(
                n("structural_critical"), " critical structural validation failure(s)"))]),
        "disclosure": (False, "All methods and limitations properly disclosed.", [
            (F.lit(not method), F.lit("Accounting method not declared")),
            (F.col("cogs_rows") > 0, F.lit(
                "COGS present — labeled as bank-proxy unless inventory values provided")),
            (F.col("unsplit") > 0, _text(
                n("unsplit"), " loan payment(s) without principal/interest split"))]),
        "review": (False, "All items above confidence threshold and reviewed.", [
            (F.col("low_confidence") > 0, _text(
                n("low_confidence"), f" transaction(s) below {threshold}% confidence")),
            (F.col("uncategorized") > 0, _text(n("uncategorized"), " uncategorized transaction(s)")),
            (F.col("must_review") > 0, _text(
                n("must_review"), " transaction(s) require human review"))]),
    }
    columns = {}
    for name in wanted:
        blocker, fine, issues = findings[name]
        found = compact(*issues)
        columns[name] = F.struct(
            (F.size(found) == 0).alias("passed"),
            F.when(F.size(found) == 0, fine).otherwise(F.array_join(found, "; ")).alias("details"),
            F.lit(blocker).alias("blocker"))
    return g.withColumns(columns).select("batch_id", *columns)


def verdict(gate_rows: DataFrame) -> DataFrame:
    failed = {name: ~F.col(f"{name}.passed") for name in GATES}
    blocked = failed["arithmetic"] | failed["structural"]
    warned = failed["disclosure"] | failed["review"]
    names = lambda some: F.array_join(
        compact(*[(failed[g], g.upper()) for g in some]), ", ")
    return gate_rows.withColumns({
        "can_issue_full": ~blocked,
        "overall_status": F.when(blocked, "BLOCKED").when(warned, "PASS_WITH_WARNINGS")
        .otherwise("PASS"),
        "summary": F.when(blocked, _text(
            "Full Analysis CANNOT be issued. Blocking gates failed: ", names(GATES[:2]),
            ". Resolve these before issuing."))
        .when(warned, _text(
            "Full Analysis can be issued WITH WARNINGS. Non-blocking items need attention: ",
            names(GATES[2:]), ". Report will include disclosure notes."))
        .otherwise("All acceptance gates pass. Full Analysis is cleared for issuance. Arithmetic "
                   "exact, structural integrity verified, disclosures complete, all items above "
                   "confidence threshold.")})


def grade(stats: DataFrame, unsplit: Column | None = None) -> DataFrame:
    """How far the analysis can be relied on, from uncategorised and review shares."""
    unsplit = F.lit(0) if unsplit is None else unsplit
    rows, uncat, queue = F.col("total"), F.col("uncategorized"), F.col("review_queue")
    over = lambda part, pct: part * 100 > rows * pct
    share = lambda part: F.format_string(
        "%s", F.bround((part * 100).cast("decimal(20,0)") / rows, 0).cast("bigint"))
    poor = over(uncat, 30) | over(queue, 50)
    fair = over(uncat, 15) | (unsplit > 5)
    return stats.withColumns({
        "analysis_grade": F.when(poor, "PRELIMINARY").when(fair, "DRAFT").otherwise("FULL"),
        "analysis_grade_reason": F.when(poor, _text(
            uncat.cast("string"), " uncategorized (", share(uncat), "%), ", queue.cast("string"),
            " in review queue (", share(queue), "%). Too many unresolved items for full analysis."))
        .when(fair, _text(
            uncat.cast("string"), " uncategorized (", share(uncat), "%), ", unsplit.cast("string"),
            " unsplit loan payments. Review recommended before relying on P&L."))
        .otherwise("Categorization coverage sufficient for full analysis.")})


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
