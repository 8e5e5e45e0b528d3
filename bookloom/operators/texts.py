"""Work on descriptions, done once per distinct description and side.

Statements repeat their texts, so `annotate` joins what follows from a text alone back to the
rows, as struct ``_text``. The operators read it from there (`plan.known`) and work it out per
row where it is missing; both ways give the same results.

What is decided about a row follows from its client, text, side and class of amount, so `decisions`
decides once for each of these and `decided` joins the decisions back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.plan import TEXT, settle
from bookloom.operators import capex, categorize, corrections, flows, loans, merchant

KEYS = ["description", "direction"]


def distinct(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The pairs of ``keys``, dealt out by number: they are small, and a size-driven merge of
    partitions would leave the matching to a few tasks. They are dealt by a hash of the keys, as a
    deal by the keys themselves is taken for the one that found them and left out."""
    session = rows.sparkSession
    parts = max(session.sparkContext.defaultParallelism,
                int(session.conf.get("spark.sql.shuffle.partitions")))
    return rows.select(*keys).distinct().repartition(parts, F.xxhash64(*keys))


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add ``columns``, which read only KEYS, by way of the distinct texts."""
    return meet(rows, settle(distinct(rows), columns))


def meet(rows: DataFrame, found: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``rows`` with the columns of ``found``, which has each set of keys once, nulls included."""
    right = found.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [rows[k].eqNullSafe(right[f"_{k}"]) for k in keys]
    return rows.join(right, same, "left").drop(*[f"_{k}" for k in keys])


def facts(texts: DataFrame, only: list[str] | None = None) -> DataFrame:
    """``texts`` (KEYS, each pair once) with struct ``_text``: names, and all facts or those of ``only``."""
    text, side = F.col("description"), F.col("direction")
    upper = F.upper(text)
    out = settle(texts, {"merchant_clean": merchant.clean(text)})
    out = settle(out, {"tokens": merchant.tokens(F.col("merchant_clean")),
                       "alias": merchant.alias(F.col("merchant_clean"))})
    out = out.withColumn("canonical_merchant_id", F.coalesce(
        "alias", merchant.provisional(F.col("merchant_clean"), F.col("tokens"))))
    rules = {
        "exact": categorize.first_candidate(lambda t: categorize.exact_place(t, side), ["given", "clean"]),
        "exact_name": categorize.first_candidate(lambda t: categorize.exact_place(t, side), ["name"]),
        "patterns": F.array(*[categorize.pattern_parts(t, side) for t in categorize.candidates()]),
        "flow": flows.from_text(text, side), "lesson": corrections.match_text(text),
        "insurer": categorize.names_insurer(upper), "fallback": categorize.fallback_place(upper),
        "no_capex": capex.excluded(text), "asset": capex.asset_place(text), "loan": loans.is_loan(text, side)}
    rules = {name: rule for name, rule in rules.items() if only is None or name in only}
    if rules:
        out = settle(out, rules)
    return out.select(*KEYS, F.struct(
        F.col("merchant_clean").alias("clean"), F.col("canonical_merchant_id").alias("name"),
        "tokens", "alias", *rules).alias(TEXT))


def annotate(rows: DataFrame, texts: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """Add ``_text``. ``texts`` may be a cheaper table with every pair of KEYS that is in ``rows``."""
    return meet(rows, facts(distinct(rows if texts is None else texts), only))


ALIKE = ["client_id", *KEYS, "amount_class"]


def classed(rows: DataFrame) -> DataFrame:
    """Add ``amount_class``: amounts of one class are decided alike."""
    amount = F.col("amount")
    return rows.withColumn("amount_class", categorize.amount_band(amount) * 2
                           + F.when(flows.large_round(amount), 1).otherwise(0))


def decisions(rows: DataFrame, dictionary: DataFrame | None = None,
              learned: DataFrame | None = None, mode: str = "full") -> DataFrame:
    """Per ALIKE: ``rows`` of the kind, and what `categorize.decide` finds for one of them."""
    kinds = classed(rows).groupBy(*ALIKE).agg(F.count("*").alias("rows"), F.min("amount").alias("amount"))
    told = annotate(kinds, rows)
    fact = F.col(TEXT)
    told = told.withColumns({**loans.routed(fact["loan"]),
                             "loan_split_source": F.when(fact["loan"], "split").otherwise("")})
    named = merchant.normalize(flows.classify(told), dictionary)
    return (categorize.decide(named, learned, mode)
            .withColumn(TEXT, F.struct(fact["no_capex"].alias("no_capex"), fact["asset"].alias("asset")))
            .drop("amount", "loan_split_source"))


def decided(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with their `decisions`. Flags that rows have come first; evidence is not told yet."""
    mine = [c for c in ("flags", "flag_notes") if c in rows.columns]
    base = rows.drop("account_type", "account_code", "account_name").withColumnsRenamed(
        {c: f"_{c}" for c in mine})
    out = meet(classed(base), found.drop("rows"), ALIKE).drop("amount_class")
    return out.withColumns({c: F.concat(f"_{c}", c) for c in mine}).drop(*[f"_{c}" for c in mine])
