"""Capital purchases: keep them out of the period's expenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.matching import contains_any, first_word, pick
from bookloom.functions.money import count_if, total
from bookloom.functions.plan import known
from bookloom.rules import capex as rules


def excluded(description: Column) -> Column:
    return contains_any(F.upper(description), rules.exclusions())


def asset_class(description: Column) -> Column:
    """Struct (name, keyword, life, property_class, ref): first class, first keyword."""
    return asset_row(asset_place(description))


def _keywords() -> list[dict]:
    return [{"keyword": w, "name": c["name"], "life": c["life"],
              "property_class": c["property_class"], "ref": c["ref"]}
            for c in rules.classes() for w in c["words"]]


def asset_place(description: Column) -> Column:
    """1-based place of that keyword, or null."""
    return first_word(F.upper(description), [r["keyword"] for r in _keywords()]).cast("int")


def asset_row(place: Column) -> Column:
    return pick(_keywords(), "keyword:string,name:string,life:string,property_class:string,ref:string",
                place)


def candidate(barred: Column) -> Column:
    """Debits on expense, cost-of-goods or open accounts without an excluded word."""
    return ((F.col("direction") == "DEBIT") & F.col("account_type").isin("EXPENSE", "COGS", "")
            & ~barred)


def outcome(c: Column, tried: Column, threshold: str = rules.DE_MINIMIS) -> Column:
    """Struct (kind, evidence, recommendation) from asset class ``c``; null when nothing
    applies. Kind is capex, de_minimis or large."""
    amount, money = F.col("amount"), F.col("amount").cast("string")
    large = (tried & c.isNull() & (amount > rules.LARGE_EXPENSE)
             & ~F.col("account_code").isin(rules.KNOWN_CODES))
    small = c.isNotNull() & (amount <= threshold)
    kind = F.when(large, "large").when(small, "de_minimis").when(c.isNotNull(), "capex")
    evidence = (
        F.when(large, "Large expense without asset keyword match (passed exclusion gate)")
        .when(small, F.concat(
            F.lit("Matches asset class '"), c["name"], F.lit("' but $"), money,
            F.lit(f" is at or below de minimis safe harbor (${threshold}). "
                  "May expense immediately.")))
        .when(c.isNotNull(), F.concat(
            F.lit("Matches asset class '"), c["name"], F.lit("' (keywords: ['"), c["keyword"],
            F.lit("']). Amount $"), money,
            F.lit(f" exceeds de minimis threshold (${threshold})."))))
    advice = (
        F.when(large, F.concat(F.lit("Expense of $"), money, F.lit(
            " exceeds $10,000 and is not a routine category. Verify this is not a capital "
            "expenditure that should be depreciated.")))
        .when(small, "Eligible for de minimis safe harbor expensing.")
        .when(c.isNotNull(), F.concat(
            F.lit("Route to Fixed Assets ("), c["property_class"], F.lit(
                "). CPA to evaluate: Section 179 election, Bonus Depreciation (168(k)), or "
                "standard MACRS over "), c["life"], F.lit(" years. Ref: "), c["ref"])))
    return F.struct(kind.alias("kind"), evidence.alias("evidence"),
                    advice.alias("recommendation"))


def classify(categorized: DataFrame, threshold: str = rules.DE_MINIMIS) -> DataFrame:
    """Add structs ``asset`` (the class found) and ``capex`` (what follows from it)."""
    text = F.col("description")
    out = categorized.withColumn("_tried", candidate(known(categorized, "no_capex", excluded(text))))
    out = out.withColumn("asset", F.when(F.col("_tried"), asset_row(known(categorized, "asset", asset_place(text)))))
    return out.withColumn(
        "capex", outcome(F.col("asset"), F.col("_tried"), threshold)).drop("_tried")


def apply(categorized: DataFrame, threshold: str = rules.DE_MINIMIS) -> DataFrame:
    """Re-route capital purchases to the fixed-asset account and flag what needs a look."""
    out = classify(categorized, threshold)
    kind, name = F.col("capex.kind"), F.col("asset.name")
    capex = F.coalesce(kind == "capex", F.lit(False))
    flag = F.when(kind == "capex", "CAPEX_DETECTED").when(kind == "large", "LARGE_EXPENSE_REVIEW")
    return out.withColumns({
        "is_capex": capex, "depreciation_eligible": capex,
        "de_minimis": F.coalesce(kind == "de_minimis", F.lit(False)),
        "capex_asset_class": F.when(capex, name).otherwise(""),
        "account_type": F.when(capex, "ASSET").otherwise(F.col("account_type")),
        "account_code": F.when(capex, "1500").otherwise(F.col("account_code")),
        "account_name": F.when(capex, F.concat(F.lit("Fixed Assets - "), F.initcap(name)))
        .otherwise(F.col("account_name")),
        "flags": F.when(flag.isNotNull(), F.array_append("flags", flag)).otherwise(F.col("flags")),
        "flag_notes": F.when(flag.isNotNull(), F.array_append(
            "flag_notes", F.col("capex.recommendation"))).otherwise(F.col("flag_notes")),
    }).drop("capex", "asset")


def items(applied: DataFrame, threshold: str = rules.DE_MINIMIS) -> DataFrame:
    """Capital purchases with what is recommended, and those under the threshold, a row each.

    Where rows don't carry what is known of their texts, classes are looked up again for these few."""
    found = applied.where(F.col("is_capex") | F.col("de_minimis")).withColumn(
        "asset", asset_row(known(applied, "asset", asset_place(F.col("description")))))
    advice = outcome(F.col("asset"), F.lit(False), threshold)["recommendation"]
    return found.select(
        "batch_id", "seq", F.when(F.col("is_capex"), "capex").otherwise("de_minimis").alias("kind"),
        "date", "description", "amount", F.col("asset.name").alias("asset_class"),
        F.when(F.col("is_capex"), advice).alias("recommendation"))


def report(applied: DataFrame) -> DataFrame:
    return applied.groupBy("batch_id").agg(
        count_if(F.col("is_capex")).alias("capex_count"),
        total(F.col("amount"), F.col("is_capex")).alias("total_capex"),
        count_if(F.col("de_minimis")).alias("de_minimis_count"))
