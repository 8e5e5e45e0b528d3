"""Learned corrections: an append-only event log folded into per-client rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.money import count_if
from bookloom.functions.plan import known
from bookloom.operators.client_rules import match_client_rules
from bookloom.operators.skew import join_totals, running_index

# What is stripped before a description is compared, in order.
STRIP = [r"#\d+", r"\b\d{2}/\d{2}(/\d{2,4})?\b", r"\bCARD\s*\d{4}\b", r"\bXX+\d{4}\b",
         r"\b\d{6,}\b"]
# Base confidence, gain and its cap, loss and its cap, floor, ceiling.
BASE, GAIN, GAIN_CAP, LOSS, LOSS_CAP, FLOOR, CEILING = 0.90, 0.01, 0.09, 0.10, 0.30, 0.50, 0.99
HIGH_TRUST, LOW_TRUST = 0.90, 0.70
LEARNED = ("struct<rule_id:string,canonical_pattern:string,account_code:string,"
           "account_name:string,account_type:string,category:string,subcategory:string,"
           "deductible:boolean,irs_ref:string,direction:string,confidence:double,"
           "times_applied:bigint,times_confirmed:bigint,source:string>")
REQUIRED = ["description", "account_code", "account_name", "account_type"]


def match_text(description: Column) -> Column:
    bare = reduce(lambda t, p: F.regexp_replace(t, p, ""), STRIP, F.upper(F.trim(description)))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def rule_id(pattern: Column) -> Column:
    return F.substring(F.sha2(F.upper(F.trim(pattern)), 256), 1, 16)


def confidence(confirmed: Column, overridden: Column) -> Column:
    gain = F.least(F.lit(GAIN_CAP), confirmed * F.lit(GAIN))
    loss = F.least(F.lit(LOSS_CAP), overridden * F.lit(LOSS))
    return F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), F.lit(BASE) + gain - loss))


def from_import(rows: DataFrame) -> DataFrame:
    """Bulk rows as correction events; rows without a required field are left out."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in REQUIRED])
    return rows.where(complete).withColumns({
        "kind": F.lit("correct"), "source": F.lit("bulk_import"), "irs_ref": F.lit(""),
        "deductible": F.coalesce("deductible", F.lit(True)),
        "category": F.coalesce("category", F.lit("")),
        "subcategory": F.coalesce("subcategory", F.lit("")),
        "direction": F.coalesce("direction", F.lit("")),
        "notes": F.coalesce("notes", F.lit(""))})


def keyed(events: DataFrame) -> DataFrame:
    return (events.withColumn("canonical_pattern", match_text(F.col("description")))
            .withColumn("rule_id", rule_id(F.col("canonical_pattern"))))


def fold(events: DataFrame) -> DataFrame:
    """Rules after the whole log, one row per (client, rule).

    The first correction creates a rule; later ones replace the account and confirm it,
    keeping optional fields they leave blank. Overrides count once the rule exists.
    """
    keys = ["client_id", "rule_id"]
    log = keyed(events)
    made = F.col("kind") == "correct"

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(made, F.col("event_seq"))).alias(name)

    def latest_filled(name: str) -> Column:
        filled = made & (F.col(name) != "")
        return F.coalesce(F.max_by(name, F.when(filled, F.col("event_seq"))), F.lit("")).alias(name)

    def first(name: str) -> Column:
        return F.min_by(name, F.when(made, F.col("event_seq"))).alias(name)

    rules = (log.groupBy(*keys).agg(
        F.min(F.when(made, F.col("event_seq"))).alias("created_seq"),
        F.count("*").alias("rows"),
        first("canonical_pattern"), latest("account_code"), latest("account_name"),
        latest("account_type"), latest("deductible"), latest_filled("category"),
        latest_filled("subcategory"), latest_filled("irs_ref"), latest_filled("notes"),
        first("direction"), first("source"),
        (count_if(made) - 1).alias("times_confirmed"))
        .where(F.col("created_seq").isNotNull()))
    overrides = (join_totals(log.where(~made).select(*keys, "event_seq"),
                             rules.select(*keys, "created_seq", "rows"), keys, "rows",
                             F.col("event_seq"), how="inner")
                 .where(F.col("event_seq") > F.col("created_seq"))
                 .groupBy(*keys).agg(F.count("*").alias("times_overridden")))
    return (rules.drop("rows").join(overrides, keys, "left")
            .withColumn("times_overridden", F.coalesce("times_overridden", F.lit(0)))
            .withColumn("times_applied", F.lit(0).cast("bigint"))
            .withColumn("confidence", confidence(F.col("times_confirmed"), F.col("times_overridden"))))


def delete(rules: DataFrame, deletions: DataFrame) -> DataFrame:
    return rules.join(deletions.select("client_id", "rule_id").distinct(),
                      ["client_id", "rule_id"], "left_anti")


def listing(rules: DataFrame) -> DataFrame:
    """The rules of every client with their standing, for display."""
    score = confidence(F.col("times_confirmed"), F.col("times_overridden"))
    return rules.select(
        "client_id", "rule_id", "canonical_pattern", "account_code", "account_name", "account_type",
        score.alias("confidence"), "times_applied", "times_confirmed", "times_overridden", "created_seq",
        "source")


def match(rows: DataFrame, rules: DataFrame, only: Column | None = None) -> DataFrame:
    """Add struct ``learned``: the longest pattern of the client contained in the
    description whose side fits; ties go to the older rule."""
    table = rules.withColumns({
        "_len": -F.length("canonical_pattern"),
        "confidence": confidence(F.col("times_confirmed"), F.col("times_overridden"))})
    if only is None:
        only = F.lit(True)
    keep = ["rule_id", "canonical_pattern", "account_code", "account_name", "account_type",
            "category", "subcategory", "deductible", "irs_ref", "direction", "confidence",
            "times_applied", "times_confirmed", "source"]
    return match_client_rules(
        rows, table, known(rows, "lesson", match_text(F.col("description"))), "canonical_pattern",
        ["_len", "created_seq"], keep, "learned", side=F.col("direction"),
        rule_side="direction", only=only)


def evidence(rule: Column, applied: Column | None = None) -> Column:
    """Evidence text; the running application count appears once it has been numbered."""
    count = [] if applied is None else [F.lit("applied "), applied.cast("string"), F.lit("x, ")]
    return F.concat(
        F.lit("Learned match: '"), rule["canonical_pattern"], F.lit("' → "), rule["account_code"],
        F.lit(" "), rule["account_name"], F.lit(" ("), *count, F.lit("confirmed "),
        rule["times_confirmed"].cast("string"), F.lit("x, source: "), rule["source"], F.lit(")"))


def number_applications(matched: DataFrame, width: int) -> DataFrame:
    """For rows with a ``learned`` hit: the rule's application count at that row and the
    evidence that quotes it. ``width`` is the slice width of ``seq``."""
    hits = (matched.where(F.col("learned").isNotNull())
            .withColumn("rule_id", F.col("learned.rule_id")))
    numbered = running_index(hits, ["client_id", "rule_id"], "seq", width)
    applied = F.col("learned.times_applied") + F.col("nth")
    return (numbered.withColumn("times_applied", applied.cast("bigint"))
            .withColumn("evidence", evidence(F.col("learned"), F.col("times_applied")))
            .drop("nth"))


def add_applications(rules: DataFrame, matched: DataFrame) -> DataFrame:
    """Rules with ``times_applied`` raised by the batch's hits."""
    hits = (matched.where(F.col("learned").isNotNull())
            .groupBy("client_id", F.col("learned.rule_id").alias("rule_id"))
            .agg(F.count("*").alias("_hits")))
    return (rules.join(hits, ["client_id", "rule_id"], "left")
            .withColumn("times_applied", (F.col("times_applied")
                                          + F.coalesce("_hits", F.lit(0))).cast("bigint"))
            .drop("_hits"))


def stats(rules: DataFrame) -> DataFrame:
    score = confidence(F.col("times_confirmed"), F.col("times_overridden"))
    exact = score.cast("decimal(10,4)")
    return rules.groupBy("client_id").agg(
        F.count("*").alias("total_rules"),
        F.sum("times_applied").cast("bigint").alias("total_applied"),
        F.bround(F.sum(exact) / F.count("*"), 3).cast("double").alias("avg_confidence"),
        count_if(score >= HIGH_TRUST).alias("high_confidence_rules"),
        count_if(score < LOW_TRUST).alias("low_trust_rules"))
