"""Workpaper tables. Everything stays long; nesting happens per item at the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.functions.money import total

#: Columns of flagged rows that the blocks of a package read.
STORED = ["batch_id", "seq", "transaction_id", "date", "description", "amount", "direction", "account_code",
          "account_name", "account_type", "confidence_score", "categorization_layer", "is_capex", "de_minimis",
          "loan_principal", "loan_interest", "loan_fees", "loan_estimated", "entry_id", "entry_balanced",
          "flags", "flag_notes"]


def cover_sheet(batches: DataFrame, batch_totals: DataFrame, trial_totals: DataFrame,
                flag_summary: DataFrame, business_name: str = "Client",
                ruleset_version: str = "2.4.0", prepared_by: str = "") -> DataFrame:
    """One sheet per batch; a batch without transactions shows zeros."""
    source_hash = F.coalesce("source_hash", F.lit("")) if "source_hash" in batches.columns else F.lit("")
    none = F.lit(0).cast("decimal(18,2)")
    period = F.concat(F.col("period_start").cast("string"), F.lit(" to "),
                      F.col("period_end").cast("string"))
    return (batches.join(batch_totals, "batch_id", "left")
            .join(trial_totals.select("batch_id", "is_balanced"), "batch_id", "left")
            .join(flag_summary.select("batch_id", "flagged_transactions", "critical"), "batch_id",
                  "left")
            .fillna(0, ["transaction_count", "flagged_transactions", "critical"])
            .fillna(True, ["is_balanced"])
            .select("batch_id", F.lit(business_name).alias("business_name"), period.alias("period"),
                    F.lit(prepared_by).alias("prepared_by"), "source_document",
                    source_hash.alias("source_hash"), "document_type", F.lit("cash").alias("accounting_method"),
                    "transaction_count", F.coalesce("total_debits", none).alias("total_debits"),
                    F.coalesce("total_credits", none).alias("total_credits"),
                    F.when(F.col("is_balanced"), "BALANCED").otherwise("OUT OF BALANCE")
                    .alias("trial_balance_status"),
                    F.col("flagged_transactions").alias("flagged_items"),
                    F.col("critical").alias("critical_flags"),
                    F.lit(ruleset_version).alias("ruleset_version"),
                    F.lit("").alias("reviewer_id"), F.lit("").alias("review_timestamp"),
                    F.lit("PENDING").alias("review_status")))


def register(rows: DataFrame) -> DataFrame:
    return rows.select("batch_id", "seq", "date", "description", "amount", "direction",
                       "account_code", "account_name",
                       F.col("confidence_score").alias("confidence"),
                       (F.size("flags") > 0).alias("flagged"), "flags")


def category_summary(rows: DataFrame) -> DataFrame:
    """Count, total and last-used account per account name; ranked by total per batch."""
    name = F.coalesce(F.nullif(F.col("account_name"), F.lit("")), F.lit("Uncategorized"))
    # summed per account with numbers only, so the large aggregation hashes
    parts = rows.groupBy("batch_id", name.alias("category_name"), "account_code").agg(
        F.count("*").alias("n"), total(F.col("amount")).alias("part"),
        F.max("seq").alias("last_seq"), F.min("seq").alias("first_seq"))
    sums = parts.groupBy("batch_id", "category_name").agg(
        F.sum("n").alias("count"), total(F.col("part")).alias("total"),
        F.max_by("account_code", "last_seq").alias("account"), F.min("first_seq").alias("first_seq"))
    order = W.partitionBy("batch_id").orderBy(F.desc("total"), "first_seq")
    return sums.withColumn("position", F.row_number().over(order)).drop("first_seq")


def audit_trail(posted: DataFrame) -> DataFrame:
    """Each transaction with its journal entry, which sits on the same row."""
    return posted.select(
        "batch_id", "seq", "transaction_id", "date", "description", "amount",
        "categorization_layer", "account_code", "account_name",
        F.col("confidence_score").alias("confidence"), F.col("entry_id").alias("journal_entry_id"),
        F.col("entry_balanced").alias("je_balanced"), "flags", "flag_notes")


def bank_reconciliation(balanced: DataFrame) -> DataFrame:
    """The reconciliation block; a zero balance shows as missing, as the block always did."""
    shown = lambda c: F.when(F.col(c) != 0, F.col(c)).alias(c)
    reconciles = ~F.col("balances_provided") | (F.coalesce("difference", F.lit(0)) == 0)
    return balanced.select(
        "batch_id", shown("beginning_balance"), "total_credits", "total_debits", "net_change",
        shown("ending_balance"), reconciles.alias("reconciles"),
        (F.col("beginning_balance") + F.col("net_change")).cast("decimal(18,2)")
        .alias("calculated_ending"))


def flagged_list(flagged: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` flagged rows of each batch. The rank filter is pushed below the
    shuffle, so a batch with most of the rows does not gather in one task."""
    order = W.partitionBy("batch_id").orderBy("seq")
    return (flagged.where(F.size("flags") > 0)
            .select("batch_id", "seq", "date", "description", "amount", "flags")
            .withColumn("position", F.row_number().over(order))
            .where(F.col("position") <= limit))


def flagged_rows(flagged: DataFrame) -> DataFrame:
    """Every flagged row with its flags and their messages."""
    return flagged.where(F.size("flags") > 0).select(
        "batch_id", "seq", "date", "description", "amount", "flags", "flag_notes")


def journal_totals(posted: DataFrame) -> DataFrame:
    """Entries of each batch, and whether all of them balance."""
    return posted.groupBy("batch_id").agg(
        F.count("*").alias("journal_entry_count"),
        F.min("entry_balanced").alias("journal_entries_balanced"))


def fields_digest(package_rows: DataFrame, names: list[str]) -> DataFrame:
    """Package rows of one block with the digest of its fields ``names``, by name, in place of the JSON
    that they are read from."""
    ordered = sorted(names)
    read = F.from_json("payload", ", ".join(f"`{n}` string" for n in ordered))
    text = F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.coalesce(F.col("_read")[n], F.lit("~")))
                              for n in ordered])
    return package_rows.withColumn("_read", read).select(
        "batch_id", "section", "sort_key", F.md5(text).alias("fields_md5"))


def search(register_rows: DataFrame, needle: str, order_by: str = "date",
           ascending: bool = True) -> DataFrame:
    """Register rows whose description, account name or code holds ``needle``, sorted."""
    low = F.lit(needle.lower())
    hit = (F.lower("description").contains(low) | F.lower("account_name").contains(low)
           | F.col("account_code").contains(needle))
    key = F.col(order_by)
    return register_rows.where(hit).orderBy(key.asc() if ascending else key.desc(), "seq")


def transaction_json(rows: DataFrame) -> DataFrame:
    """Each row as JSON with money as text."""
    plain = ["transaction_id", "date", "description", "merchant_clean", "canonical_merchant_id",
             "amount", "direction", "inflow_type", "account_code", "account_name", "account_type",
             "category", "subcategory", "categorization_layer", "matched_rule_id",
             "required_review", "confidence_score", "flags", "deductible", "deductible_pct",
             "irs_ref", "schedule_c_line", "is_capex", "loan_principal", "loan_interest",
             "loan_fees", "loan_type", "loan_split_source", "loan_estimated", "debit_account",
             "credit_account"]
    as_text = {"amount", "deductible_pct", "loan_principal", "loan_interest", "loan_fees"}
    fields = [F.col(c).cast("string").alias(c) if c in as_text else F.col(c) for c in plain]
    return rows.select("batch_id", "seq", F.to_json(
        F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def field_names(df: DataFrame) -> list[str]:
    """Columns of a block that are fields of its JSON."""
    return [c for c in df.columns if c not in ("batch_id", "seq")]


def section(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Rows of one workpaper block as (batch, section, sort key, JSON)."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    fields = [F.col(c).cast("string").alias(c) if kinds[c] == "decimal" else F.col(c)
              for c in field_names(df)]
    key = F.concat_ws("|", *[F.lpad(F.col(c).cast("string"), 20, "0") for c in order])
    return df.select("batch_id", F.lit(name).alias("section"), key.alias("sort_key"),
                     F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def package(sections: list[DataFrame]) -> DataFrame:
    """All blocks of all batches in one long table, ready for a partitioned write."""
    out = sections[0]
    for part in sections[1:]:
        out = out.unionByName(part)
    return out
