"""The full analysis as a chain of DataFrame stages.

Stages are lazy. Each names what it needs, so a caller that wants only the trial balance
never plans flags or checks. Everything up to ``posted`` is narrow but for the loans that
look for a schedule row; ledgers and reports aggregate from there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.functions.plan import TEXT
from bookloom.operators import (capex, categorize, checks, flags, journal, loans, reconcile,
                                statements, texts, workpapers)
from bookloom.sources import derive


@dataclass
class Inputs:
    """Rows and statements, and the optional per-client tables."""

    transactions: DataFrame
    batches: DataFrame | None = None
    learned: DataFrame | None = None
    dictionary: DataFrame | None = None
    manual_splits: DataFrame | None = None
    schedules: DataFrame | None = None
    inventory: DataFrame | None = None


def derived_inputs(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> Inputs:
    """Inputs derived from the order tables; ``rows`` are their transactions if stored already."""
    rows = derive.transactions(spark, folder) if rows is None else rows
    statement_batches = derive.batches(rows)
    return Inputs(rows, statement_batches, derive.learned_rules(spark, folder),
                  derive.dictionary(spark, folder), derive.manual_splits(spark, folder),
                  derive.schedules(rows), derive.inventory(statement_batches))


class Analysis:
    """Stages of one analysis. ``mode`` is ``full`` or ``categorize`` (stricter review)."""

    def __init__(self, inputs: Inputs, mode: str = "full"):
        self.inputs, self.mode = inputs, mode

    @cached_property
    def loans(self) -> DataFrame:
        i = self.inputs
        return loans.apply_splits(loans.analyze(
            i.transactions, i.manual_splits, i.schedules))

    @cached_property
    def decisions(self) -> DataFrame:
        """What is decided, once for all rows that are decided alike."""
        i = self.inputs
        return texts.decisions(i.transactions, i.dictionary, i.learned, self.mode)

    @cached_property
    def decided(self) -> DataFrame:
        """Transactions with their decisions. Loan splits don't bear on these, so none are made."""
        return texts.decided(self.inputs.transactions, self.decisions).drop(TEXT, categorize.WHY)

    @cached_property
    def purchased(self) -> DataFrame:
        """Decided rows with their capital purchases, and what is known of their texts. Loan splits, marks and
        entries bear on none of these columns, so reports that read no others wait for none of them."""
        return capex.apply(texts.decided(self.inputs.transactions, self.decisions)).drop(categorize.WHY)

    @cached_property
    def entries(self) -> DataFrame:
        """Posted rows without the marks that only flags need, and from no store."""
        return journal.post(self.capitalized)

    @cached_property
    def _categorized(self) -> DataFrame:
        return texts.decided(self.loans, self.decisions)

    @cached_property
    def categorized(self) -> DataFrame:
        return categorize.explain(self._categorized).drop(TEXT, categorize.WHY)

    @cached_property
    def capitalized(self) -> DataFrame:
        return self._capitalize(self._categorized)

    @staticmethod
    def _capitalize(rows: DataFrame) -> DataFrame:
        return categorize.explain(capex.apply(rows)).drop(TEXT, categorize.WHY)

    @cached_property
    def posted(self) -> DataFrame:
        return journal.post(self.capitalized)

    @cached_property
    def marked(self) -> DataFrame:
        """Decided rows with the marks that flags need, made while the rows are narrow."""
        i = self.inputs
        return texts.decided(flags.mark(self.loans, i.batches, self.totals, i.transactions), self.decisions)

    def use_marked(self, rows: DataFrame) -> "Analysis":
        """Continue from stored `marked` rows. What comes behind them is told from the row alone, so each
        report works out only the columns that it reads."""
        return self.use_stored(journal.post(self._capitalize(rows)))

    def use_stored(self, posted: DataFrame) -> "Analysis":
        """Continue from a stored ``posted`` table instead of recomputing it per report."""
        self.__dict__["posted"] = posted
        return self

    def use_flagged(self, flagged: DataFrame) -> "Analysis":
        """Continue from stored `flagged` rows with the columns of `workpapers.STORED`. Every block of the
        package is then a scan of the columns it names; journal lines are told from the row."""
        self.__dict__["flagged"] = flagged
        return self.use_stored(flagged.withColumn("journal_lines", journal.lines()))

    @cached_property
    def journal(self) -> DataFrame:
        return journal.journal(self.posted)

    @cached_property
    def trial_balance(self) -> DataFrame:
        return journal.trial_balance(self.journal)

    @cached_property
    def trial_totals(self) -> DataFrame:
        return journal.trial_totals(self.trial_balance)

    @cached_property
    def profit_and_loss(self) -> DataFrame:
        return statements.profit_and_loss(self.trial_balance)

    @cached_property
    def totals(self) -> DataFrame:
        return reconcile.totals(self.inputs.transactions)

    @cached_property
    def flagged(self) -> DataFrame:
        return flags.apply(self.posted, self.inputs.batches, self.totals)

    @cached_property
    def flag_summary(self) -> DataFrame:
        return flags.summary(self.flagged)

    @cached_property
    def reconciled(self) -> DataFrame:
        return reconcile.reconcile(self.inputs.batches, self.inputs.transactions)

    @cached_property
    def batch_figures(self) -> DataFrame:
        return checks.batch_figures(self.posted)

    @cached_property
    def issues(self) -> DataFrame:
        return checks.row_issues(self.posted).unionByName(
            checks.batch_issues(self.reconciled, self.batch_figures))

    @cached_property
    def structural(self) -> DataFrame:
        """The structural ones of `issues`, without working out the others."""
        return checks.row_issues(self.posted, checks.structural_codes()).unionByName(
            checks.batch_issues(self.reconciled, self.batch_figures, checks.STRUCTURAL_BATCH))

    @cached_property
    def uncategorized(self) -> DataFrame:
        """Issues of batches with undecided rows, from decided rows alone."""
        return checks.batch_issues(self.inputs.batches, checks.uncategorized(self.decided),
                                   ["UNCATEGORIZED_REMAINING"])

    @cached_property
    def validation(self) -> DataFrame:
        return checks.rollup(self.issues, self.inputs.batches)

    @cached_property
    def gates(self) -> DataFrame:
        return checks.gates(self.batch_figures, self.reconciled, self.validation)

    def gate(self, name: str) -> DataFrame:
        """One of `gates`, from no more than it reads."""
        structural = name == "structural"
        return checks.gates(self.batch_figures, self.reconciled if structural else self.inputs.batches,
                            checks.rollup(self.structural, self.inputs.batches) if structural else None,
                            only=[name])

    @cached_property
    def verdict(self) -> DataFrame:
        return checks.verdict(self.gates)

    @cached_property
    def cover(self) -> DataFrame:
        return workpapers.cover_sheet(self.inputs.batches, self.totals, self.trial_totals,
                                      self.flag_summary)

    @cached_property
    def blocks(self) -> list[tuple[DataFrame, str, list[str]]]:
        """Every workpaper block: its rows, name and the columns of its order."""
        balanced = reconcile.with_balances(self.inputs.batches, self.totals)
        return [
            (self.cover, "cover_sheet", []),
            (workpapers.bank_reconciliation(balanced), "bank_reconciliation", []),
            (workpapers.register(self.flagged), "transaction_register", ["seq"]),
            (self.trial_balance, "trial_balance", ["code"]),
            (self.profit_and_loss, "profit_and_loss", []),
            (statements.pnl_lines(self.trial_balance).select(
                "batch_id", "section", "code", "name", "amount"), "profit_and_loss_lines", ["code"]),
            (statements.tax_lines(self.posted), "schedule_c_map", ["tax_line"]),
            (statements.tax_items(self.posted), "schedule_c_transactions", ["seq"]),
            (statements.tax_unmapped(self.posted), "schedule_c_unmapped", ["seq"]),
            (statements.tax_summary(self.posted), "schedule_c_summary", []),
            (workpapers.journal_totals(self.posted), "journal_totals", []),
            (capex.items(self.posted), "capital_purchases", ["seq"]),
            (flags.counts(self.flagged), "flag_counts", ["flag"]),
            (workpapers.flagged_rows(self.flagged), "flagged_items", ["seq"]),
            (self.flag_summary, "flagged_items_report", []),
            (workpapers.category_summary(self.posted), "category_summary", ["position"]),
            (workpapers.audit_trail(self.flagged), "audit_trail", ["seq"])]

    @cached_property
    def package(self) -> DataFrame:
        """Every workpaper block of every batch in one long table."""
        return workpapers.package([workpapers.section(*b) for b in self.blocks])


def client_month_pnl(spark: SparkSession, folder: str) -> DataFrame:
    """Profit and loss per client month, from order tables to statement."""
    analysis = Analysis(derived_inputs(spark, folder))
    return analysis.profit_and_loss.orderBy(F.col("batch_id"))
