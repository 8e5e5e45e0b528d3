"""Inflow and outflow classification ahead of categorisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.matching import any_regex
from bookloom.functions.plan import known
from bookloom.rules import flows as rules


def _outcome(kind: str, confidence: float, evidence: str, review: bool) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"),
                    F.lit(evidence).alias("evidence"), F.lit(review).alias("review"))


def _ordered(text: Column, table: list[dict]) -> Column:
    chain = F
    for rule in table:
        chain = chain.when(any_regex(text, rule["patterns"]), _outcome(
            rule["type"], rule["confidence"], rule["evidence"],
            rule["confidence"] < rules.REVIEW_BELOW))
    return chain


def inflow(description: Column, amount: Column) -> Column:
    """Struct (type, confidence, evidence, review) for a credit."""
    return by_amount(inflow_text(description), amount)


def inflow_text(description: Column) -> Column:
    """What the text of a credit says, or null."""
    text = F.trim(description)
    return _ordered(text, rules.inflow()).when(
        F.upper(text).contains("DEPOSIT"), _outcome("UNKNOWN", *rules.GENERIC_DEPOSIT, True))


def large_round(amount: Column) -> Column:
    return (amount >= 10000) & (amount % 1000 == 0)


def by_amount(found: Column, amount: Column) -> Column:
    """``found``, else what the amount of the credit says."""
    rest = F.when(large_round(amount), _outcome("UNKNOWN", *rules.LARGE_ROUND, True)).otherwise(
        _outcome("UNKNOWN", *rules.NO_PATTERN, True))
    return F.coalesce(found, rest)


def from_text(description: Column, direction: Column) -> Column:
    """The flow as far as text and side settle it; null for a credit without a known text."""
    return F.when(direction == "CREDIT", inflow_text(description)).otherwise(outflow(description))


def outflow(description: Column) -> Column:
    text = F.upper(F.trim(description))
    return _ordered(text, rules.outflow()).otherwise(
        _outcome("OUTFLOW", *rules.PLAIN_OUTFLOW, False))


def classify(rows: DataFrame) -> DataFrame:
    """Add ``inflow_type`` and ``inflow_evidence``; unclear credits get a flag and review.

    ``flags``, ``flag_notes`` and ``required_review`` are carried if present.
    """
    have = set(rows.columns)
    flags = F.col("flags") if "flags" in have else F.array().cast("array<string>")
    notes = F.col("flag_notes") if "flag_notes" in have else F.array().cast("array<string>")
    review = F.col("required_review") if "required_review" in have else F.lit(False)
    told = known(rows, "flow", from_text(F.col("description"), F.col("direction")))
    flow = by_amount(told, F.col("amount"))
    unclear = F.col("_flow.review")
    return (rows.withColumn("_flow", flow)
            .withColumns({
                "inflow_type": F.col("_flow.type"),
                "inflow_confidence": F.col("_flow.confidence"),
                "inflow_evidence": F.col("_flow.evidence"),
                "required_review": review | unclear,
                "flags": F.when(unclear, F.array_append(flags, F.lit("INFLOW_UNCLASSIFIED")))
                .otherwise(flags),
                "flag_notes": F.when(unclear, F.array_append(notes, F.col("_flow.evidence")))
                .otherwise(notes)})
            .drop("_flow"))
