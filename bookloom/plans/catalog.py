"""Registered queries: one callable (spark, folder) -> DataFrame per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.functions import money
from bookloom.functions.dates import iso_date
from bookloom.functions.plan import settle, widen
from bookloom.operators import (capex, categorize, checks, corrections, doctype, flags, flows,
                                journal, loans, merchant, pnl, reconcile, scrub, statements,
                                texts, workpapers)
from bookloom.plans.analysis import Analysis, Inputs, derived_inputs
from bookloom.rules import detectors, labelled
from bookloom.sources import derive, sinks
from bookloom.sources import statements as readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TERMS = ["old oak", "first example bank", "queque"]


def edge(df: DataFrame) -> DataFrame:
    """Plain output types: money and dates as text, lists joined, whole numbers as bigint."""
    def plain(field: T.StructField) -> Column:
        c, kind = F.col(field.name), field.dataType
        if isinstance(kind, (T.DecimalType, T.DateType)):
            return c.cast("string")
        if isinstance(kind, T.ArrayType):
            return F.array_join(c.cast("array<string>"), " | ")
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint")
        return c

    return df.select(*[plain(f).alias(f.name) for f in df.schema])


def query(name: str):
    def register(fn):
        QUERIES[name] = lambda spark, folder: edge(fn(spark, folder))
        return fn
    return register


@lru_cache(maxsize=4)
def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """The derived transactions, written once where a query reads them several times. Their ids follow
    from their numbers and are left out, as texts that don't compress."""
    rows = derive.transactions(spark, folder)
    kept = sinks.materialize(rows.drop("transaction_id"), sinks.scratch(spark, "transactions"))
    return kept.withColumn("transaction_id", derive.transaction_id()).select(*rows.columns)


@lru_cache(maxsize=4)
def _analysis(spark: SparkSession, folder: str, mode: str = "full") -> Analysis:
    """One analysis per session and folder. The posted rows serve some eighty reports, so
    they are kept; a lost block is recomputed from the tables."""
    a = Analysis(derived_inputs(spark, folder, _stored(spark, folder)), mode)
    return a.use_marked(a.marked.persist(StorageLevel.MEMORY_AND_DISK))


@lru_cache(maxsize=4)
def _lean(spark: SparkSession, folder: str) -> Analysis:
    """An analysis for reports that read no marks: its rows are neither marked nor kept, so each report
    moves only the columns that it reads."""
    return Analysis(derived_inputs(spark, folder, _stored(spark, folder)))


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    """Flags are narrow on rows that are marked, so they are not kept a second time."""
    return _analysis(spark, folder).flagged


@lru_cache(maxsize=4)
def _packaged(spark: SparkSession, folder: str) -> Analysis:
    """An analysis whose flagged rows are written once, with the columns that the package reads: its
    seventeen blocks would each work them out anew."""
    a = Analysis(derived_inputs(spark, folder, _stored(spark, folder)))
    rows = a.use_marked(a.marked).flagged.select(*workpapers.STORED)
    return Analysis(a.inputs).use_flagged(sinks.materialize(rows, sinks.scratch(spark, "flagged")))


def posted(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that the reports share."""
    return _analysis(spark, folder).posted


def detected(spark: SparkSession, folder: str) -> DataFrame:
    """The spans that the scrubbing queries share."""
    return _detected(spark, folder)


def _tx(spark, folder) -> DataFrame:
    return derive.transactions(spark, folder)


def _texts(spark, folder) -> DataFrame:
    return widen(derive.texts(spark, folder), "source_id")


# --- sources ----------------------------------------------------------------

@query("delimited_scan")
def _(s, d):
    # a source is a month of one of derive.CLIENTS clients, however large the tables are
    return readers.delimited(derive.delimited_lines(_stored(s, d)), derive.DEFAULT_YEAR, few_sources=True)


@query("text_scan")
def _(s, d):
    return readers.free_text(derive.statement_texts(s, d), derive.DEFAULT_YEAR)


@query("table_scan")
def _(s, d):
    return readers.tables(derive.statement_tables(s, d), derive.DEFAULT_YEAR)


@query("statement_metadata")
def _(s, d):
    return readers.metadata(derive.statement_texts(s, d)).drop("text")


@query("source_fingerprint")
def _(s, d):
    return derive.statement_texts(s, d).select(
        "source_id", readers.fingerprint(F.col("text")).alias("source_hash"))


@query("parse_amount")
def _(s, d):
    raw = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("($"), F.col("amount").cast("string"), F.lit(")"))) \
        .when(F.col("seq") % 5 == 1, F.concat(F.lit(" $ "), F.col("amount").cast("string"))) \
        .when(F.col("seq") % 5 == 2, F.concat(F.lit("1,"), F.lpad(F.col("amount").cast("string"), 6, "0"))) \
        .when(F.col("seq") % 5 == 3, F.concat(F.lit("-"), F.col("amount").cast("string"))) \
        .otherwise(F.lit("n/a"))
    return _tx(s, d).select("seq", raw.alias("raw")).withColumn("parsed", money.parse_amount(F.col("raw")))


@query("parse_date")
def _(s, d):
    day = F.to_date("date")
    shapes = ["MM/dd/yyyy", "M-d-yy", "MM/dd", " yyyy-MM-dd", "'not a date'", "MMMM d, yyyy",
              "d MMM yyyy", "yyyy-MM-dd'T'HH:mm:ss", "MM.dd.yyyy", "yyyyMMdd"]
    raw = F.when(F.dayofmonth(day) > 12, F.date_format(day, "dd/MM/yyyy")) \
        .otherwise(F.date_format(day, "MM/dd/yyyy"))
    for k, shape in enumerate(shapes):
        raw = F.when(F.col("seq") % 11 == k, F.date_format(day, shape)).otherwise(raw)
    return _tx(s, d).select("seq", raw.alias("raw")).withColumn(
        "iso", iso_date(F.col("raw"), derive.DEFAULT_YEAR))


@query("light_merchant")
def _(s, d):
    return _tx(s, d).select("seq", merchant.light_clean(F.col("description")).alias("merchant"))


@query("cents_round")
def _(s, d):
    third = F.col("amount") / 8
    return _tx(s, d).select("seq", money.cents(third).alias("eighth"))


@query("money_guard")
def _(s, d):
    text = F.when(F.col("seq") % 3 == 0, F.col("amount").cast("string")) \
        .when(F.col("seq") % 3 == 1, F.col("amount").cast("int").cast("string")) \
        .otherwise(F.concat(F.lit("-"), F.col("amount").cast("string")))
    rows = money.require_exact_money(_tx(s, d), ["amount"])
    return rows.select("seq", text.alias("value")).withColumn("valid", money.is_money_text(F.col("value")))


@query("batch_totals")
def _(s, d):
    return reconcile.review_totals(_analysis(s, d).posted)


# --- documents --------------------------------------------------------------

def _doc_input(s, d):
    return _texts(s, d).select("source_id", "text").unionByName(derive.statement_texts(s, d))


@query("document_type")
def _(s, d):
    return doctype.classify(_doc_input(s, d), fallback=False).drop("text")


@query("document_type_fallback")
def _(s, d):
    return doctype.classify(_doc_input(s, d)).select(
        "source_id", "document_type", "confidence", "matched_identifiers")


def _detector_query(det: dict):
    @query(f"detect_{det['code'].lower()}")
    def _(s, d):
        return _texts(s, d).select("source_id", F.posexplode(
            scrub.values(F.col("text"), det)).alias("position", "value"))


for _det in detectors.detectors():
    _detector_query(_det)


@lru_cache(maxsize=4)
def _detected(spark, folder):
    return scrub.detect(_texts(spark, folder), terms=TERMS).persist(StorageLevel.MEMORY_AND_DISK)


@query("detect_custom_terms")
def _(s, d):
    return scrub.detect(_texts(s, d), terms=TERMS, only=["CUSTOM"]).select(
        "source_id", F.explode("detections").alias("x")).select(
        "source_id", "x.start", "x.stop", "x.value")


@query("detect_spans")
def _(s, d):
    return _detected(s, d).select("source_id", F.posexplode("detections").alias("position", "x")) \
        .select("source_id", "position", "x.start", "x.stop", "x.code", "x.value", "x.confidence",
                "x.context")


@query("detection_counts")
def _(s, d):
    return scrub.counts(_detected(s, d), ["source"])


@query("overlap_resolution")
def _(s, d):
    return _detected(s, d).select("source_id", F.explode(scrub.resolve()).alias("x")).select(
        "source_id", "x.start", "x.stop", "x.code")


@query("replacement_tokens")
def _(s, d):
    x = F.col("x")
    return _detected(s, d).select("source_id", F.explode("detections").alias("x")).select(
        "source_id", x["start"].alias("start"), x["code"].alias("code"),
        scrub.replacement(x).alias("token"), scrub.replacement(x, False).alias("token_hidden"))


def _redacted(s, d):
    return scrub.redact(_detected(s, d))


@query("redact_text")
def _(s, d):
    return _redacted(s, d).select("source_id", F.md5("redacted").alias("redacted_md5"),
                                  F.length("redacted").alias("chars"))


@query("redaction_report")
def _(s, d):
    return scrub.report(_redacted(s, d)).select("source_id", "original_chars", "redacted_chars",
                                                "items", "by_type")


@query("masked_examples")
def _(s, d):
    return scrub.examples(_detected(s, d), ["source_id"])


@query("folder_totals")
def _(s, d):
    done = _detected(s, d).select("source", (F.length("text") > 0).alias("success"),
                                  F.size("detections").alias("items"))
    return scrub.folder_totals(done, ["source"])


# --- merchants and flows ----------------------------------------------------

def _normalized(s, d, only=()):
    """Rows with their merchants, and the facts in ``only``, each found out once per distinct text."""
    return merchant.normalize(texts.annotate(_tx(s, d), only=list(only)), derive.dictionary(s, d))


@query("clean_description")
def _(s, d):
    return _tx(s, d).select("seq", merchant.clean(F.col("description")).alias("cleaned"))


@query("merchant_tokens")
def _(s, d):
    return _tx(s, d).select("seq", merchant.clean(F.col("description")).alias("c")).select(
        "seq", merchant.tokens(F.col("c")).alias("tokens"))


@query("client_dictionary")
def _(s, d):
    return _normalized(s, d).where("client_matched").select("seq", "client_id", "canonical_merchant_id")


@query("alias_lookup")
def _(s, d):
    return _tx(s, d).select("seq", merchant.clean(F.col("description")).alias("c")).select(
        "seq", merchant.alias(F.col("c")).alias("canonical"))


@query("provisional_merchant")
def _(s, d):
    return _tx(s, d).select("seq", merchant.clean(F.col("description")).alias("c")).select(
        "seq", merchant.provisional(F.col("c"), merchant.tokens(F.col("c"))).alias("provisional"))


@query("normalize_merchant")
def _(s, d):
    return _normalized(s, d).select("seq", "merchant_clean", "canonical_merchant_id",
                                    "merchant_tokens", "alias_matched", "client_matched")


def _inflow(s, d):
    return _tx(s, d).where("direction = 'CREDIT'").select("seq", flows.inflow(
        F.col("description"), F.col("amount")).alias("f")).select("seq", "f.*")


query("classify_inflow")(_inflow)


@query("inflow_fallback")
def _(s, d):
    return _inflow(s, d).where("type = 'UNKNOWN'").groupBy("confidence", "evidence").agg(
        F.count("*").alias("rows"))


@query("classify_outflow")
def _(s, d):
    return _tx(s, d).where("direction = 'DEBIT'").select("seq", flows.outflow(
        F.col("description")).alias("f")).select("seq", "f.type", "f.confidence", "f.evidence")


@query("classify_flows")
def _(s, d):
    return flows.classify(_tx(s, d)).select("seq", "inflow_type", "inflow_evidence",
                                            "required_review", "flags")


# --- loans ------------------------------------------------------------------

def _loan_rows(s, d, with_schedules=True):
    rows = _stored(s, d)
    return loans.analyze(rows, derive.manual_splits(s, d),
                         derive.schedules(rows) if with_schedules else None)


@query("detect_loan")
def _(s, d):
    return _tx(s, d).select("seq", loans.is_loan(F.col("description"), F.col("direction")).alias("is_loan"))


@query("loan_type")
def _(s, d):
    return _tx(s, d).where(loans.is_loan(F.col("description"), F.col("direction"))).select(
        "seq", loans.loan_type(F.col("description")).alias("loan_type"))


@query("loan_fee")
def _(s, d):
    return _tx(s, d).select("seq", loans.fee(F.col("description")).alias("fee")).where("fee IS NOT NULL")


@query("described_interest")
def _(s, d):
    return _tx(s, d).select("seq", loans.stated_interest(F.col("description")).alias("interest")) \
        .where("interest IS NOT NULL")


def _loan_source(name: str, source: str):
    @query(name)
    def _(s, d):
        return _loan_rows(s, d).where(F.col("split.source") == source).select(
            "seq", "split.principal", "split.interest", "split.fees", "split.evidence")


_loan_source("manual_split", "manual")
_loan_source("amortization_lookup", "amortization")
_loan_source("estimated_split", "estimated")


@query("split_shares")
def _(s, d):
    # every third client is off by 0.006, every third by 0.012
    off = (F.pmod("client_id", F.lit(3)) * F.lit("0.0060").cast("decimal(5,4)")).cast("decimal(5,4)")
    rules = derive.manual_splits(s, d).withColumn(
        "interest_pct", (F.col("interest_pct") + off).cast("decimal(5,4)"))
    return loans.checked_splits(rules).select("client_id", "pattern", "interest_pct", "accepted", "error")


@query("loan_split")
def _(s, d):
    return _loan_rows(s, d).where("is_loan").select("seq", "loan_type", "split.source", "split.principal",
                                                    "split.interest", "split.fees")


@query("apply_loans")
def _(s, d):
    return loans.apply_splits(_loan_rows(s, d)).select(
        "seq", "account_type", "account_code", "account_name", "loan_estimated", "flags")


@query("loan_report")
def _(s, d):
    return loans.report(_analysis(s, d).posted)


# --- categorisation ---------------------------------------------------------

def _pre(s, d):
    return merchant.normalize(flows.classify(loans.apply_splits(loans.analyze(
        _tx(s, d)))), derive.dictionary(s, d))


@query("candidate_texts")
def _(s, d):
    return _normalized(s, d).select("seq", F.array_compact(F.array(*categorize.candidates())).alias("candidates"))


@query("pre_class_gate")
def _(s, d):
    return _analysis(s, d).posted.where("categorization_layer = 'pre_classifier'").select(
        "seq", "inflow_type", "direction", "confidence_score", "categorization_evidence")


@query("loan_gate")
def _(s, d):
    return _analysis(s, d).posted.where("categorization_layer = 'loan_splitter'").select(
        "seq", "account_code", "confidence_score", "categorization_evidence")


@query("exact_match")
def _(s, d):
    return _tx(s, d).select("seq", categorize.exact_match(
        F.col("description"), F.col("direction")).alias("m")).where("m IS NOT NULL").select("seq", "m.*")


@query("learned_match")
def _(s, d):
    return corrections.match(_tx(s, d), derive.learned_rules(s, d)).where(
        "learned IS NOT NULL").select("seq", "learned.rule_id", "learned.canonical_pattern",
                                      "learned.account_code", "learned.confidence")


@query("pattern_match")
def _(s, d):
    best = categorize.keyword_best(F.col("description"), F.col("direction"))
    return texts.once(_tx(s, d), {"best": best}).where("best IS NOT NULL").select(
        "seq", categorize.keyword_row(F.col("best.rule"), F.col("best.confidence")).alias("m")).select("seq", "m.*")


@query("vendor_tier")
def _(s, d):
    return _tx(s, d).select("seq", categorize.vendor_tier(F.col("description"), F.col("amount")).alias("m")) \
        .where("m IS NOT NULL").select("seq", "m.rule_id", "m.account", "m.name", "m.confidence", "m.note")


@query("candidate_loop")
def _(s, d):
    rows = _normalized(s, d, ["exact", "exact_name"])
    hits = settle(rows, {"m": categorize.exact_candidate(rows)}).where("m IS NOT NULL")
    return hits.select("seq", categorize.exact_row(F.col("m.hit"))["keyword"].alias("keyword"), "m.text")


def _fallback(name: str, side: str):
    @query(name)
    def _(s, d):
        return _tx(s, d).where(F.col("direction") == side).select("seq", categorize.fallback_step(
            F.upper("description")).alias("f")).select("seq", "f.code", "f.name", "f.confidence")


_fallback("credit_fallback", "CREDIT")
_fallback("debit_fallback", "DEBIT")


@query("fallback_review")
def _(s, d):
    return _analysis(s, d).purchased.where("categorization_layer = 'uncategorized'").select(
        "seq", "account_code", "required_review",
        F.array_contains("flags", "LOW_CONFIDENCE_CATEGORY").alias("flagged"))


@query("chart_enrichment")
def _(s, d):
    return _analysis(s, d).decided.select("seq", "account_code", "schedule_c_line")


@query("deductibility")
def _(s, d):
    return _analysis(s, d).decisions.groupBy("account_code", "deductible_pct").agg(
        F.sum("rows").alias("rows"))


@query("confidence_boost")
def _(s, d):
    return _analysis(s, d).decided.select("seq", "categorization_layer", "confidence_score")


@query("precision_gate")
def _(s, d):
    return _analysis(s, d, "categorize").decided.select(
        "seq", F.array_contains("flags", "BELOW_THRESHOLD").alias("below"), "required_review")


@query("categorize")
def _(s, d):
    return _analysis(s, d).categorized.select(
        "seq", "account_code", "account_name", "account_type", "categorization_layer",
        "matched_rule_id", "confidence_score", "categorization_evidence", "matched_tokens",
        "deductible", "deduction_limit", "deductible_pct", "irs_ref", "schedule_c_line",
        "required_review", "flags", "flag_notes")


@query("categorization_stats")
def _(s, d):
    return categorize.batch_stats(_lean(s, d).posted)


@query("review_queue")
def _(s, d):
    return categorize.review_queue(_lean(s, d).posted).select("batch_id", "seq", "confidence_score")


@query("labelled_accuracy")
def _(s, d):
    labels = s.createDataFrame([(t, side, code) for t, side, _, code in labelled.ROWS],
                               "description string, direction string, expected_account_code string")
    return categorize.accuracy(_analysis(s, d).posted, labels, ["description", "direction"])


@query("declarative_rules")
def _(s, d):
    place = categorize.declarative_place(F.col("description"), F.col("direction"))
    return texts.once(_tx(s, d), {"place": place}).where("place IS NOT NULL").select(
        "seq", categorize.declarative_row(F.col("place"), F.col("amount")).alias("m")).select("seq", "m.rule_id", "m.account", "m.category", "m.subcategory",
                                "m.confidence", "m.deductible_pct", "m.flag", "m.requires_review")


# --- learned corrections ----------------------------------------------------

def _events(s, d):
    log = derive.correction_events(s, d)
    rest = log.where("kind <> 'import'")
    return rest.unionByName(corrections.from_import(log.where("kind = 'import'")).select(*rest.columns))


@query("correction_text")
def _(s, d):
    return _tx(s, d).select("seq", corrections.match_text(F.col("description")).alias("pattern"))


@query("correction_rule_id")
def _(s, d):
    return corrections.keyed(_tx(s, d)).select("seq", "rule_id")


@query("correction_upsert")
def _(s, d):
    return corrections.fold(_events(s, d)).drop("times_applied", "times_overridden", "confidence")


@query("correction_overrides")
def _(s, d):
    return corrections.fold(_events(s, d)).select("client_id", "rule_id", "times_overridden")


@query("correction_confidence")
def _(s, d):
    return corrections.fold(_events(s, d)).select("client_id", "rule_id", "confidence")


@query("correction_applications")
def _(s, d):
    hits = corrections.match(_tx(s, d), derive.learned_rules(s, d))
    return corrections.number_applications(hits, derive.SEQ_SLICE).select(
        "seq", "rule_id", "times_applied", "evidence")


@query("correction_import")
def _(s, d):
    return corrections.from_import(derive.correction_events(s, d).where("kind = 'import'")).groupBy(
        "client_id").agg(F.count("*").alias("imported"))


@query("correction_delete")
def _(s, d):
    rules = derive.learned_rules(s, d)
    gone = rules.where((F.col("client_id") + F.col("created_seq")) % 5 == 0)
    return corrections.delete(rules, gone).select("client_id", "rule_id", "canonical_pattern")


@query("correction_list")
def _(s, d):
    return corrections.listing(derive.learned_rules(s, d))


@query("correction_stats")
def _(s, d):
    return corrections.stats(derive.learned_rules(s, d))


# --- capital purchases ------------------------------------------------------

@query("capex_exclusion")
def _(s, d):
    return _tx(s, d).select("seq", capex.excluded(F.col("description")).alias("excluded"))


@query("asset_class")
def _(s, d):
    return _tx(s, d).select("seq", capex.asset_class(F.col("description")).alias("a")).where(
        "a IS NOT NULL").select("seq", "a.name", "a.keyword", "a.life", "a.property_class")


@query("capex_apply")
def _(s, d):
    return _analysis(s, d).purchased.where("is_capex OR de_minimis").select(
        "seq", "is_capex", "de_minimis", "capex_asset_class", "account_code", "account_name")


@query("large_expense_review")
def _(s, d):
    return _lean(s, d).purchased.where(F.array_contains("flags", "LARGE_EXPENSE_REVIEW")).select(
        "seq", "amount", "account_code")


@query("capex_items")
def _(s, d):
    return capex.items(_analysis(s, d).purchased)


@query("capex_report")
def _(s, d):
    return capex.report(_lean(s, d).purchased)


# --- ledger -----------------------------------------------------------------

@query("journal_entries")
def _(s, d):
    return _lean(s, d).journal


@query("entry_balance")
def _(s, d):
    return _analysis(s, d).entries.select("seq", "entry_id", "entry_debits", "entry_credits",
                                         "entry_balanced", "debit_account", "credit_account")


@query("trial_balance")
def _(s, d):
    return _lean(s, d).trial_balance


@query("trial_balance_totals")
def _(s, d):
    return _lean(s, d).trial_totals


@query("trial_balance_by_type")
def _(s, d):
    return journal.by_type(_lean(s, d).trial_balance)


@query("ledger_rollup")
def _(s, d):
    a = _lean(s, d)
    return journal.rollup(a.trial_balance, a.inputs.batches)


@query("out_of_balance")
def _(s, d):
    return journal.out_of_balance(_lean(s, d).trial_balance)


@query("profit_and_loss")
def _(s, d):
    return _lean(s, d).profit_and_loss


@query("tax_lines")
def _(s, d):
    return statements.tax_lines(_lean(s, d).purchased)


@query("tax_items")
def _(s, d):
    return statements.tax_items(_lean(s, d).purchased)


@query("tax_unmapped")
def _(s, d):
    return statements.tax_unmapped(_lean(s, d).purchased)


@query("tax_summary")
def _(s, d):
    return statements.tax_summary(_lean(s, d).purchased)


@query("cogs_bank_proxy")
def _(s, d):
    return statements.cogs_proxy(_analysis(s, d).purchased)


@query("cogs_inventory")
def _(s, d):
    a = _analysis(s, d)
    return statements.cogs_inventory(a.purchased, a.inputs.inventory)


@query("inventory_spikes")
def _(s, d):
    return statements.inventory_spikes(_analysis(s, d).purchased)


# --- flags ------------------------------------------------------------------

def _flag_query(flag: str):
    @query(f"flag_{flag.lower()}")
    def _(s, d):
        return _flagged(s, d).where(F.array_contains("flags", flag)).select("batch_id", "seq")


FLAG_NAMES = ["BALANCE_MISMATCH", "DUPLICATE_TRANSACTION", "MEALS_OVER_75", "LARGE_CASH_WITHDRAWAL",
              "CASH_NEAR_10K", "ROUND_NUMBER_SUSPICIOUS", "PERSONAL_EXPENSE_MIXED",
              "POSSIBLE_CAPITAL_EXPENSE", "LOAN_PAYMENT_DETECTED", "AMBIGUOUS_VENDOR"]
for _flag in FLAG_NAMES:
    _flag_query(_flag)


@query("flag_rows")
def _(s, d):
    return _flagged(s, d).select("seq", "flags", "flag_notes")


@query("flag_summary")
def _(s, d):
    return flags.summary(_flagged(s, d))


@query("flag_severity")
def _(s, d):
    return flags.counts(_flagged(s, d))


# --- reconciliation and checks ----------------------------------------------

@query("reconcile")
def _(s, d):
    a = _analysis(s, d)
    return a.reconciled.select("batch_id", "beginning_balance", "ending_balance", "total_credits",
                               "total_debits", "net_change", "computed_ending", "difference", "status")


@query("duplicate_count")
def _(s, d):
    return reconcile.duplicates(_tx(s, d))


@query("reconcile_diagnosis")
def _(s, d):
    return _analysis(s, d).reconciled.select("batch_id", "issues", "recommendations", "can_issue_full")


@query("structural_issues")
def _(s, d):
    return _lean(s, d).structural.drop("category")


SEMANTIC = ["CREDIT_TO_EXPENSE", "LOAN_AS_EXPENSE", "LARGE_UNVERIFIED_REVENUE", "DRAW_AS_EXPENSE",
            "MEALS_FULL_DEDUCTION", "CAPEX_AS_EXPENSE"]


def _issue_query(code: str):
    @query(f"issue_{code.lower()}")
    def _(s, d):
        return checks.row_issues(_lean(s, d).purchased, [code]).select(
            "batch_id", "transaction_id", "severity", "message")


for _code in SEMANTIC:
    _issue_query(_code)


@query("issue_uncategorized_remaining")
def _(s, d):
    return _lean(s, d).uncategorized.select(
        "batch_id", "severity", "message")


@query("validation_rollup")
def _(s, d):
    return _lean(s, d).validation


def _gate_query(name: str):
    @query(f"gate_{name}")
    def _(s, d):
        return _lean(s, d).gate(name).select("batch_id", f"{name}.passed", f"{name}.details",
                                            f"{name}.blocker")


for _gate in checks.GATES:
    _gate_query(_gate)


@query("acceptance_verdict")
def _(s, d):
    return _lean(s, d).verdict.select("batch_id", "can_issue_full", "overall_status", "summary")


@query("analysis_grade")
def _(s, d):
    return checks.grade(categorize.batch_stats(_lean(s, d).posted)).select(
        "batch_id", "total", "uncategorized", "review_queue", "analysis_grade",
        "analysis_grade_reason")


# --- workpapers -------------------------------------------------------------

@query("cover_sheet")
def _(s, d):
    _flagged(s, d)
    return _analysis(s, d).cover


@query("transaction_register")
def _(s, d):
    return workpapers.register(_flagged(s, d))


@query("category_summary")
def _(s, d):
    return workpapers.category_summary(_analysis(s, d).purchased)


@query("audit_trail")
def _(s, d):
    return workpapers.audit_trail(_flagged(s, d)).drop("flag_notes")


@query("bank_reconciliation")
def _(s, d):
    a = _analysis(s, d)
    return workpapers.bank_reconciliation(reconcile.with_balances(a.inputs.batches, a.totals))


@query("flagged_list")
def _(s, d):
    return workpapers.flagged_list(_flagged(s, d), 50)


@query("register_search")
def _(s, d):
    return workpapers.search(workpapers.register(_lean(s, d).purchased), "food", "amount", False).select(
        "seq", "description", "amount", "account_code")


@query("workpaper_json")
def _(s, d):
    return workpapers.transaction_json(_flagged(s, d)).select("seq", F.length("json").alias("chars"),
                                                              F.md5("json").alias("json_md5"))


@query("workpaper_package")
def _(s, d):
    return _packaged(s, d).package.groupBy("section").agg(
        F.count("*").alias("rows"), F.countDistinct("batch_id").alias("batches"))


@query("package_fields")
def _(s, d):
    return workpapers.package([workpapers.fields_digest(
        workpapers.section(rows, name, order), workpapers.field_names(rows))
        for rows, name, order in _packaged(s, d).blocks])


# --- simple profit and loss -------------------------------------------------

BY = ["client_id", "period"]


def _simple(s, d):
    credit = F.col("direction") == "CREDIT"
    return _tx(s, d).select(
        "client_id", F.substring("date", 1, 7).alias("period"), "seq", "description",
        F.when(credit, F.col("amount")).otherwise(-F.col("amount")).cast("decimal(18,2)").alias("amount"),
        F.lower("direction").alias("kind"))


def _pl(s, d):
    return pnl.measures(pnl.build(pnl.categorize(_simple(s, d)), BY))


@query("keyword_categorize")
def _(s, d):
    return pnl.categorize(_simple(s, d)).select("seq", "category", "subcategory", "confidence")


@query("keyword_counts")
def _(s, d):
    return pnl.batch_counts(pnl.categorize(_simple(s, d)), BY)


@query("keyword_breakdown")
def _(s, d):
    return pnl.breakdown(pnl.categorize(_simple(s, d)), ["client_id"])


@query("keyword_rollup")
def _(s, d):
    return pnl.rollup(pnl.categorize(_simple(s, d)))


@query("pnl_build")
def _(s, d):
    return pnl.build(pnl.categorize(_simple(s, d)), ["client_id"])


@query("pnl_multi_period")
def _(s, d):
    return pnl.build(pnl.categorize(_simple(s, d)), BY)


@query("pnl_assumptions")
def _(s, d):
    return _pl(s, d).select(*BY, pnl.assumptions().alias("assumptions"))


@query("pnl_measures")
def _(s, d):
    return _pl(s, d).select(*BY, "net_revenue", "total_cogs", "gross_profit", "total_opex",
                            "operating_income", "net_profit")


@query("pnl_margins")
def _(s, d):
    return _pl(s, d).select(*BY, "gross_margin_pct", "operating_margin_pct", "net_margin_pct",
                            "cogs_pct", "opex_pct", "rent_pct")


@query("pnl_comparison")
def _(s, d):
    return pnl.compare(_pl(s, d), "client_id", "period")


@query("pnl_warnings")
def _(s, d):
    pl = _pl(s, d)
    return pl.select(*BY, pnl.warnings(pl).alias("warnings"))


@query("pnl_checks")
def _(s, d):
    return pnl.checks(_pl(s, d), BY)


@query("pnl_check_summary")
def _(s, d):
    return pnl.check_summary(pnl.checks(_pl(s, d), BY), BY)


@query("industry_scorecard")
def _(s, d):
    pl = _pl(s, d)
    parts = [pnl.scorecard(pnl.score(pl, i), BY) for i in ("general", "bakery", "mechanic")]
    return checks.union_all(parts)


@query("recommendations")
def _(s, d):
    return pnl.score(_pl(s, d)).select(*BY, "overall", pnl.recommendations(5).alias("actions"))


@query("snapshot_metrics")
def _(s, d):
    return pnl.snapshot(pnl.score(_pl(s, d)), BY)


@query("revenue_share_table")
def _(s, d):
    return pnl.revenue_table(_pl(s, d), BY)
