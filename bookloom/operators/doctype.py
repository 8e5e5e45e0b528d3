"""What kind of document a text is, from the phrases it contains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.rules import detectors as rules


def classify(rows: DataFrame, text: str = "text", fallback: bool = True) -> DataFrame:
    """Add document_type, confidence, matched_identifiers and a score per type.

    Ties go to the earlier type. ``fallback`` reads an unknown text with enough dated
    amounts as a bank statement.
    """
    table = rules.signatures()
    out = rows.withColumn("_lower", F.lower(text))
    out = out.withColumns({f"_m_{s['type']}": F.array_compact(F.array(*[
        F.when(F.col("_lower").contains(w), F.lit(w)) for w in s["words"]])) for s in table})
    raw: dict[str, Column] = {
        s["type"]: F.size(f"_m_{s['type']}") / F.lit(float(len(s["words"]))) * F.lit(s["weight"])
        for s in table}
    out = out.withColumns({f"_s_{k}": v for k, v in raw.items()})
    out = out.withColumn("_best", F.greatest(*[F.col(f"_s_{k}") for k in raw]))
    known = F.col("_best") >= rules.UNKNOWN_BELOW
    kind, words = F, F
    for k in raw:
        top = known & (F.col(f"_s_{k}") == F.col("_best"))
        kind, words = kind.when(top, F.lit(k)), words.when(top, F.col(f"_m_{k}"))
    empty = F.array().cast("array<string>")
    out = out.withColumns({
        "document_type": kind.otherwise("unknown"), "confidence": F.round("_best", 3),
        "matched_identifiers": words.otherwise(empty),
        **{f"score_{k}": F.round(f"_s_{k}", 3) for k in raw}})
    if fallback:
        dated = F.when(F.col("document_type") == "unknown", F.size(F.regexp_extract_all(
            F.col(text), F.lit("(?d)" + rules.DATED_AMOUNT), F.lit(0))))
        as_bank = F.coalesce(F.col("_dated") >= rules.DATED_AMOUNT_LINES, F.lit(False))
        out = out.withColumn("_dated", dated).withColumns({
            "document_type": F.when(as_bank, "bank_statement").otherwise(F.col("document_type")),
            "confidence": F.when(as_bank, rules.DATED_AMOUNT_CONFIDENCE)
            .otherwise(F.col("confidence")),
            "matched_identifiers": F.when(as_bank, F.array(F.lit(rules.DATED_AMOUNT_EVIDENCE)))
            .otherwise(F.col("matched_identifiers"))}).drop("_dated")
    return out.drop("_lower", "_best", *[f"_m_{k}" for k in raw], *[f"_s_{k}" for k in raw])
