"""Layered categorisation: gates, exact keywords, learned rules, patterns, fallback.

Each layer is a struct column that is null when the layer does not apply, computed in its
own projection so that later layers run only for rows still open. No layer shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.matching import (compact, contains_any, first_word, found_words, let,
                                         literal, pick)
from bookloom.functions.money import count_if
from bookloom.functions.plan import TEXT, known, settle
from bookloom.operators import corrections
from bookloom.rules import accounts, declarative, exact, patterns

THRESHOLDS = {"full": 0.70, "categorize": 0.90}
REVIEW_BELOW = 0.70
#: Struct of what decided, kept until the evidence is told.
WHY = "_why"

FIELDS = ("code", "name", "type", "confidence", "layer", "rule_id", "deductible", "limit", "ref",
          "flag", "note", "category", "subcategory")
DECISION = ("struct<code:string,name:string,type:string,confidence:double,layer:string,"
            "rule_id:string,deductible:boolean,limit:double,ref:string,flag:string,note:string,"
            "category:string,subcategory:string>")

# What a settled money flow becomes, as
# flow|side|code|name|type|confidence|label|second evidence line.
PRE_CLASSES = """
TRANSFER|CREDIT|1000|Transfer In - Operating|ASSET|0.92|internal transfer|Balance sheet item — excluded from P&L
TRANSFER|DEBIT|1020|Transfer Out - Savings|ASSET|0.92|internal transfer|Balance sheet item — excluded from P&L
FINANCING|CREDIT|2300|Loan Proceeds|LIABILITY|0.90|financing|Balance sheet item — excluded from P&L
FINANCING|DEBIT|2300|Loan Payable|LIABILITY|0.90|financing|Balance sheet item — excluded from P&L
EQUITY|CREDIT|3200|Owner's Contributions|EQUITY|0.92|equity|Balance sheet item — excluded from P&L
EQUITY|DEBIT|3100|Owner's Draw|EQUITY|0.92|equity|Balance sheet item — excluded from P&L
TAX_LIABILITY|DEBIT|2120|Sales Tax Payable|LIABILITY|0.90|tax liability|Balance sheet item — liability reduction, not expense
INSURER REFUND|CREDIT|4500|Insurance Reimbursement|REVENUE|0.88|refund/reimbursement|Contra-expense — nets against related expense, not operating revenue
REFUND|CREDIT|4510|Vendor Refunds & Credits|REVENUE|0.88|refund/reimbursement|Contra-expense — nets against related expense, not operating revenue
"""
# Words the refund gate and the credit fallback read as insurance.
INSURER_WORDS = ["INSURANCE", "CLAIM", "GEICO", "STATE FARM", "PROGRESSIVE", "ALLSTATE",
                 "LIBERTY", "NATIONWIDE", "USAA"]
# Fallback steps, as side|code|name|confidence|words|evidence lines.
FALLBACK = """
CREDIT|4500|Insurance Reimbursement|0.65|INSURANCE; CLAIM; GEICO; STATE FARM; PROGRESSIVE; ALLSTATE; LIBERTY; NATIONWIDE; USAA|Fallback: insurance keyword detected on CREDIT side; Routed to 4500 Insurance Reimbursement (contra-expense)
CREDIT|4510|Vendor Refunds & Credits|0.60|REFUND; CREDIT MEMO; RETURN; REVERSAL|Fallback: refund/credit keyword detected; Routed to 4510 Vendor Refunds (contra-expense)
CREDIT|4520|Other Reimbursements|0.55|REIMBURSE; REIMBURSEMENT|Fallback: reimbursement keyword detected; Routed to 4520 Other Reimbursements
CREDIT|4000|Sales Revenue|0.45|DEPOSIT; PAYMENT; PMT; RECEIVED; SALE; REVENUE; CUSTOMER; CLIENT; INVOICE; CHECK; ZELLE; VENMO|Fallback: revenue-like keywords on CREDIT side; Low confidence — needs CPA review
CREDIT|4900|Other Income / Miscellaneous|0.0||No matching pattern — routed to Other Income
DEBIT|6200|Insurance - General Business|0.65|INSURANCE; PREMIUM; GEICO; STATE FARM; PROGRESSIVE; ALLSTATE; LIBERTY; NATIONWIDE|Fallback: insurance keyword detected on DEBIT side; Routed to 6200 Insurance Expense
DEBIT|6100|Rent & Lease Expense|0.60|RENT; LEASE; PROPERTY|Fallback: rent/lease keyword detected
DEBIT|6110|Utilities|0.65|ELECTRIC; WATER; GAS BILL; UTILITY; POWER; COMCAST; SPECTRUM; AT&T; VERIZON; T-MOBILE|Fallback: utility keyword detected
DEBIT|6000|Salaries & Wages|0.60|PAYROLL; SALARY; WAGES; ADP; GUSTO; PAYCHEX|Fallback: payroll keyword detected
DEBIT|6900|Miscellaneous Expense|0.0||No matching pattern — routed to Miscellaneous Expense
"""


def fallback_steps() -> list[dict]:
    out = []
    for line in FALLBACK.strip().splitlines():
        side, code, name, conf, words, lines = line.split("|")
        out.append(dict(side=side, code=code, name=name, confidence=float(conf),
                        words=words.split("; ") if words else [], evidence=lines.split("; ")))
    return out


def pre_classes() -> list[dict]:
    keys = ("flow", "side", "code", "name", "type", "confidence", "label", "second")
    rows = [dict(zip(keys, x.split("|"))) for x in PRE_CLASSES.strip().splitlines()]
    return [dict(r, confidence=float(r["confidence"])) for r in rows]


def _decision(**values) -> Column:
    """A decision struct; fields not named take their neutral value."""
    plain = dict(rule_id="", deductible=False, limit=None, ref="", flag=None, note=None,
                 category="", subcategory="")
    types = {"confidence": "double", "limit": "double", "deductible": "boolean"}

    def field(name: str) -> Column:
        v = values.get(name, plain.get(name))
        return (v if isinstance(v, Column) else F.lit(v)).cast(types.get(name, "string")).alias(name)

    return F.struct(*[field(n) for n in FIELDS])


def quoted_list(items: Column) -> Column:
    """The list as ``['A', 'B']``, quoting with ``"`` what holds an apostrophe."""
    quoted = F.transform(items, lambda t: F.when(
        t.contains("'"), F.concat(F.lit('"'), t, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), t, F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


# --- layers over one text ---------------------------------------------------

def exact_match(text: Column, direction: Column) -> Column:
    """Struct of the longest contained keyword whose side fits, or null."""
    return exact_row(exact_place(text, direction))


def exact_row(place: Column) -> Column:
    keys = ("keyword", "account", "name", "type", "deductible", "ref", "note")
    return pick([{k: r[k] for k in keys} for r in exact.rules()],
                "keyword:string,account:string,name:string,type:string,deductible:boolean,"
                "ref:string,note:string", place)


def exact_place(text: Column, direction: Column) -> Column:
    """1-based place of the longest contained keyword whose side fits, or null.

    Each side has its own word list, so a keyword of the other side cannot hide a shorter
    one that fits.
    """
    table = exact.rules()
    upper, places = F.upper(F.trim(text)), literal([r["keyword"] for r in table], "array<string>")

    def found(side: str) -> Column:
        words = [r["keyword"] for r in table if not side or r["direction"] in ("", side)]
        return found_words(upper, words, longest_only=True)

    hits = F.when(direction == "DEBIT", found("DEBIT")).when(
        direction == "CREDIT", found("CREDIT")).otherwise(found(""))
    return F.array_min(F.transform(hits, lambda w: F.array_position(places, w))).cast("int")


def keyword_score(hits: Column, shift: Column) -> Column:
    base, step = F.lit(patterns.BASE), F.lit(patterns.STEP)
    raw = F.least(F.lit(patterns.SOFT_CAP), base + (hits - 1) * step) + shift
    return F.greatest(F.lit(patterns.FLOOR), F.least(F.lit(patterns.CEILING), raw))


PATTERN_DDL = ("rule_id:string,account:string,name:string,type:string,confidence:double,"
               "deductible:boolean,limit:double,ref:string,note:string")


def keyword_match(text: Column, direction: Column) -> Column:
    """Struct of the best-scoring keyword rule; equal scores go to the earlier rule."""
    return let(keyword_best(text, direction), lambda b: F.when(
        b.isNotNull(), keyword_row(b["rule"], b["confidence"])))


def keyword_row(rule: Column, confidence: Column) -> Column:
    """Struct of the rule at place ``rule`` (from zero)."""
    keys = ("rule_id", "account", "name", "type", "deductible", "limit", "ref", "note")
    row = F.get(literal([{**{k: r[k] for k in keys}, "confidence": None} for r in patterns.rules()],
                        f"array<struct<{PATTERN_DDL}>>"), rule)
    return row.withField("confidence", confidence)


def keyword_best(text: Column, direction: Column) -> Column:
    """Struct (rule, confidence) of the best-scoring keyword rule, or null."""
    rules = patterns.rules()
    table = [(w, r["ordinal"], r["direction"], r["shift"]) for r in rules for w in r["words"]]
    words = [t[0] for t in table]
    places = literal(words, "array<string>")
    meaning = literal([{"r": r, "d": d, "s": s} for _, r, d, s in table],
                      "array<struct<r:int,d:string,s:double>>")

    def best(hits: Column) -> Column:
        scored = F.transform(hits, lambda h: F.struct(
            keyword_score(F.size(F.filter(hits, lambda x: x["r"] == h["r"])), h["s"])
            .alias("score"), (-h["r"]).alias("rank")))
        return let(F.array_max(scored), lambda b: F.struct(
            (-b["rank"]).alias("rule"), F.round(b["score"], 3).alias("confidence")))

    found = F.transform(found_words(F.upper(F.trim(text)), words), lambda w: F.get(
        meaning, (F.array_position(places, w) - 1).cast("int")))
    fits = F.filter(found, lambda h: (h["d"] == "") | (direction == "") | (h["d"] == direction))
    return let(fits, lambda hits: F.when(F.size(hits) > 0, best(hits)))


def broad_vendor(text: Column) -> Column:
    aliases = patterns.vendor_aliases()
    return pick([{"v": v} for _, v in aliases], "v:string",
                first_word(F.upper(F.trim(text)), [a for a, _ in aliases]))["v"]


def vendor_tier(text: Column, amount: Column) -> Column:
    """Struct for a broad vendor by amount band; null above the last bound."""
    return tier(broad_vendor(text), amount)


def tier(vendor: Column, amount: Column) -> Column:
    tiers = literal(patterns.vendor_tiers(), "array<struct<vendor:string,bound:int,account:string,"
                                             "name:string,confidence:double,note:string>>")
    found = let(vendor, lambda v: F.get(F.filter(
        tiers, lambda t: (t["vendor"] == v) & (amount <= t["bound"])), 0))
    return let(found, lambda t: F.when(t.isNotNull() & (amount > 0), F.struct(
        F.concat(F.lit("HEURISTIC_"), t["vendor"]).alias("rule_id"), t["account"].alias("account"),
        t["name"].alias("name"), F.lit("EXPENSE").alias("type"),
        t["confidence"].alias("confidence"), F.lit(True).alias("deductible"),
        F.lit(None).cast("double").alias("limit"), F.lit("").alias("ref"),
        t["note"].alias("note"))))


def amount_band(amount: Column) -> Column:
    """Number of the band an amount is in: amounts of one band meet the same vendor tiers."""
    bounds = sorted({0, *(t["bound"] for t in patterns.vendor_tiers())})
    return sum((F.when(amount > b, 1).otherwise(0) for b in bounds), F.lit(0))


PATTERN = f"struct<{PATTERN_DDL}>"


def pattern_match(text: Column, amount: Column, direction: Column) -> Column:
    return F.coalesce(keyword_match(text, direction).cast(PATTERN),
                      vendor_tier(text, amount).cast(PATTERN))


def pattern_parts(text: Column, direction: Column) -> Column:
    """Struct (rule, confidence, vendor) of a candidate text: all of `pattern_match` but the amount."""
    return let(F.when(text.isNotNull(), F.struct(
        keyword_best(text, direction).alias("k"), broad_vendor(text).alias("vendor"))),
        lambda p: F.when(p.isNotNull(), F.struct(
            p["k"]["rule"].alias("rule"), p["k"]["confidence"].alias("confidence"),
            p["vendor"].alias("vendor"))))


def priced(part: Column, amount: Column, text: Column) -> Column:
    """Struct (hit, text) as `first_candidate` gives it, from the parts and the amount."""
    by_rule = keyword_row(part["rule"], part["confidence"]).cast(PATTERN)
    return F.when(part["rule"].isNotNull(), F.struct(by_rule.alias("hit"), text.alias("text"))).when(
        part["vendor"].isNotNull(), let(tier(part["vendor"], amount).cast(PATTERN), lambda h: F.when(
            h.isNotNull(), F.struct(h.alias("hit"), text.alias("text")))))


def candidates() -> list[Column]:
    """Texts to try in order; a repeated or empty text is not tried again."""
    raw, cleaned, canon = (F.col(c) for c in
                           ("description", "merchant_clean", "canonical_merchant_id"))
    return [F.nullif(raw, F.lit("")),
            F.when((cleaned != "") & (cleaned != raw), cleaned),
            F.when((canon != "") & (canon != raw) & (canon != cleaned), canon)]


CANDIDATES = ["given", "clean", "name"]
#: The columns that they are read from.
CANDIDATE_TEXTS = ["description", "merchant_clean", "canonical_merchant_id"]


def first_candidate(match, only: list[str] = CANDIDATES) -> Column:
    """Struct (hit, text) of the first candidate text with a hit."""
    def attempt(text: Column) -> Column:
        return let(F.when(text.isNotNull(), match(text)), lambda h: F.when(
            h.isNotNull(), F.struct(h.alias("hit"), text.alias("text"))))

    texts = dict(zip(CANDIDATES, candidates()))
    return F.coalesce(*[attempt(texts[c]) for c in only])


def exact_candidate(rows: DataFrame) -> Column:
    """Struct (hit: place in the exact rules, text) of the first candidate. The merchant of a client's
    own dictionary doesn't follow from the text, so it is tried by itself."""
    def match(text: Column) -> Column:
        return exact_place(text, F.col("direction"))

    if TEXT not in rows.columns:
        return first_candidate(match)
    fact = F.col(TEXT)
    return F.coalesce(fact["exact"], F.when(
        F.col("client_matched"), first_candidate(match, ["name"])).otherwise(fact["exact_name"]))


def pattern_candidate(rows: DataFrame) -> Column:
    amount = F.col("amount")

    def match(text: Column) -> Column:
        return pattern_match(text, amount, F.col("direction"))

    if TEXT not in rows.columns:
        return first_candidate(match)
    given, cleaned, name = (priced(F.get(F.col(TEXT)["patterns"], i), amount, F.col(text))
                            for i, text in enumerate(CANDIDATE_TEXTS))
    return F.coalesce(given, cleaned, F.when(
        F.col("client_matched"), first_candidate(match, ["name"])).otherwise(name))


# --- layers over rows -------------------------------------------------------

def names_insurer(upper: Column) -> Column:
    return contains_any(upper, INSURER_WORDS)


def pre_class(insurer: Column) -> Column:
    """1-based place in the pre-class table for a settled money flow, or null."""
    credit_refund = (F.col("inflow_type") == "REFUND") & (F.col("direction") == "CREDIT")
    flow = F.when(credit_refund & insurer, "INSURER REFUND") \
        .otherwise(F.col("inflow_type"))
    places = {f"{r['flow']}|{r['side']}": i for i, r in enumerate(pre_classes(), 1)}
    return F.try_element_at(literal(places, "map<string,int>"), F.concat(
        flow, F.lit("|"), F.col("direction")))


def pre_row(place: Column) -> Column:
    return pick(pre_classes(), "flow:string,side:string,code:string,name:string,type:string,"
                               "confidence:double,label:string,second:string", place)


def loan_gated() -> Column:
    """Rows the loan stage already routed keep its account."""
    return (F.col("account_type") == "LIABILITY") & (F.col("loan_split_source") != "")


def matched_tokens(upper: Column) -> Column:
    return let(upper, lambda d: F.filter("merchant_tokens", lambda t: d.contains(F.upper(t))))


def fallback_step(upper: Column) -> Column:
    """Row of the fallback table: the first step of the row's side with a word in the text."""
    return fallback_row(fallback_place(upper))


def fallback_place(upper: Column) -> Column:
    """1-based place of that step."""
    steps, chain = fallback_steps(), F
    for place, step in enumerate(steps, 1):
        side = F.col("direction") == step["side"]
        chain = chain.when(side & contains_any(upper, step["words"]) if step["words"] else side,
                           F.lit(place))
    return chain


def fallback_row(place: Column) -> Column:
    keys = ("side", "code", "name", "confidence", "words")
    return pick([{**{k: s[k] for k in keys}, "lines": s["evidence"]} for s in fallback_steps()],
                "side:string,code:string,name:string,confidence:double,words:array<string>,"
                "lines:array<string>", place)


def _decide() -> Column:
    loan, e, r, p = (F.col(c) for c in ("_loan", "_exact", "learned", "_pattern"))
    pre, f = pre_row(F.col("_pre")), fallback_row(F.col("_fallback"))
    x, k = exact_row(e["hit"]), p["hit"]
    return (
        F.when(F.col("_pre").isNotNull(), _decision(code=pre["code"], name=pre["name"], type=pre["type"],
                                          confidence=pre["confidence"], layer="pre_classifier"))
        .when(loan, _decision(code=F.col("account_code"), name=F.col("account_name"),
                              type=F.col("account_type"), confidence=0.95, layer="loan_splitter"))
        .when(e.isNotNull(), _decision(
            code=x["account"], name=x["name"], type=x["type"], confidence=exact.CONFIDENCE,
            layer="exact_match", rule_id=x["keyword"], deductible=x["deductible"], ref=x["ref"],
            flag=F.when(x["note"] != "", "EXACT_MATCH_NOTE"), note=F.nullif(x["note"], F.lit(""))))
        .when(r.isNotNull(), _decision(
            code=r["account_code"], name=r["account_name"], type=r["account_type"],
            confidence=r["confidence"], layer="learned_match", rule_id=r["rule_id"],
            deductible=r["deductible"], ref=r["irs_ref"], category=r["category"],
            subcategory=r["subcategory"]))
        .when(p.isNotNull(), _decision(
            code=k["account"], name=k["name"], type=k["type"], confidence=k["confidence"],
            layer="pattern_match", rule_id=k["rule_id"], deductible=k["deductible"],
            limit=k["limit"], ref=k["ref"], flag=F.when(k["note"] != "", "PATTERN_NOTE"),
            note=F.nullif(k["note"], F.lit(""))))
        .otherwise(_decision(
            code=f["code"], name=f["name"],
            type=F.when(f["side"] == "CREDIT", "REVENUE").otherwise("EXPENSE"),
            confidence=f["confidence"], layer="uncategorized", flag="LOW_CONFIDENCE_CATEGORY",
            note=F.concat(F.lit("Fallback classification to "), f["code"], F.lit(" "), f["name"],
                          F.lit(". CPA review required.")))))


def _found() -> Column:
    """Struct of what the evidence names, in places and short texts."""
    p, x = F.col("_pattern"), F.col("_exact")
    return F.struct(
        F.col("_pre").alias("pre"), F.col("_loan").alias("loan"), x["hit"].alias("exact"),
        F.coalesce(x["text"], p["text"]).alias("text"),
        F.when(F.col("learned").isNotNull(), corrections.evidence(F.col("learned"))).alias("learned"),
        p["hit"]["rule_id"].alias("pattern"), p["hit"]["confidence"].alias("score"),
        F.col("_fallback").alias("fallback"))


def _explain() -> Column:
    """Evidence lines of the layer that decided."""
    w = F.col(WHY)
    pre, f = pre_row(w["pre"]), fallback_row(w["fallback"])
    merchant = F.concat(F.lit("Merchant: "), F.col("canonical_merchant_id"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))

    def line(*parts) -> Column:
        return F.concat(*[q if isinstance(q, Column) else F.lit(q) for q in parts])

    return (
        F.when(w["pre"].isNotNull(), F.array(
            line("Pre-classified as ", pre["label"], " (", F.col("inflow_evidence"), ")"),
            pre["second"]))
        .when(w["loan"], F.array(
            line("Loan payment routed by LoanSplitter (source: ", F.col("loan_split_source"), ")"),
            line("Principal: ", text("loan_principal"), ", Interest: ", text("loan_interest"))))
        .when(w["exact"].isNotNull(), F.array(
            line("Exact match rule '", exact_row(w["exact"])["keyword"], "'"),
            line("Matched text: ", w["text"]), merchant, F.lit(f"Confidence: {exact.CONFIDENCE}")))
        .when(w["learned"].isNotNull(), F.array(w["learned"], merchant))
        .when(w["pattern"].isNotNull(), F.array(
            line("Pattern match rule '", w["pattern"], "'"),
            line("Matched text: ", w["text"]),
            line("Matched tokens: ", quoted_list(F.col("matched_tokens"))), merchant,
            line("Confidence: ", w["score"].cast("string"))))
        .when(F.size(f["words"]) > 0, F.concat(f["lines"], F.array(merchant)))
        .otherwise(F.concat(f["lines"], F.array(
            merchant, line("Tokens: ", quoted_list(F.col("merchant_tokens")))))))


# --- after the decision -----------------------------------------------------

def chart_map() -> Column:
    return literal({a["code"]: {"name": a["name"], "type": a["type"], "side": a["normal_balance"],
                                "tax_line": a["tax_line"]} for a in accounts.chart()},
                   "map<string,struct<name:string,type:string,side:string,tax_line:string>>")


def tax_line(code: Column) -> Column:
    return F.coalesce(F.try_element_at(chart_map(), code)["tax_line"], F.lit(""))


def boost(layer_type: Column) -> Column:
    """Struct (amount, signals): what agreeing signals add to the confidence."""
    credit, flow = F.col("direction") == "CREDIT", F.col("inflow_type")
    revenue, cost = layer_type == "REVENUE", layer_type.isin("EXPENSE", "COGS")
    known = F.col("alias_matched") | F.col("client_matched")
    agree_in, agree_out = (flow == "REVENUE") & revenue, (flow == "OUTFLOW") & cost
    side_in, side_out = credit & revenue, (F.col("direction") == "DEBIT") & cost
    amount = (F.lit(0.0) + F.when(known, 0.05).otherwise(0.0)
              + F.when(agree_in, 0.05).when(agree_out, 0.03).otherwise(0.0)
              + F.when(side_in | side_out, 0.03).otherwise(0.0))
    signals = compact(
        (known, F.concat(F.lit("known_vendor:"), F.col("canonical_merchant_id"))),
        (agree_in, "inflow_confirms_revenue"), (agree_out, "outflow_confirms_expense"),
        (side_in, "direction_confirms_credit_revenue"),
        (side_out, "direction_confirms_debit_expense"))
    return F.struct(amount.alias("amount"), signals.alias("signals"))


def _percent(c: Column) -> Column:
    return F.concat(F.format_string("%.0f", c * 100), F.lit("%"))


def categorize(rows: DataFrame, learned_rules: DataFrame | None = None, mode: str = "full") -> DataFrame:
    """Categorise rows that went through the loan, flow and merchant stages."""
    return explain(decide(rows, learned_rules, mode)).drop(WHY)


def decide(rows: DataFrame, learned_rules: DataFrame | None = None, mode: str = "full") -> DataFrame:
    """All of `categorize` but the evidence, with struct ``_why``, from which `explain` tells it."""
    threshold, upper = F.lit(THRESHOLDS[mode]), F.col("_upper")
    out = rows.withColumn("_upper", F.upper("description"))
    out = out.withColumns({"_pre": pre_class(known(rows, "insurer", names_insurer(upper))),
                           "_loan": loan_gated()})
    free = F.col("_pre").isNull() & ~F.col("_loan")
    out = out.withColumn("_exact", F.when(free, exact_candidate(rows)))
    still_open = free & F.col("_exact").isNull()
    if learned_rules is not None:
        out = corrections.match(out, learned_rules, still_open)
    else:
        out = out.withColumn("learned", F.lit(None).cast(corrections.LEARNED))
    out = out.withColumn("_pattern", F.when(still_open & F.col("learned").isNull(),
                                            pattern_candidate(rows)))
    out = out.withColumn("_fallback", F.when(
        still_open & F.col("learned").isNull() & F.col("_pattern").isNull(),
        known(rows, "fallback", fallback_place(upper))))
    out = settle(out, {"_decision": _decide(), WHY: _found()})
    out = out.drop("_upper", "_pre", "_loan", "_exact", "learned", "_pattern", "_fallback")
    d, b, score = F.col("_decision"), F.col("_boost"), F.col("_score")
    scored = d["layer"].isin("exact_match", "learned_match", "pattern_match")
    meals = scored & (d["code"] == "6150")
    out = out.withColumn("_boost", F.when(scored, boost(d["type"])))
    boosted = F.coalesce(b["amount"] > 0, F.lit(False))
    out = out.withColumn("_score", F.when(
        boosted, F.least(F.lit(0.99), d["confidence"] + b["amount"])).otherwise(d["confidence"]))
    below, noted = scored & (score < threshold), d["flag"].isNotNull()
    low_note = F.concat(F.lit("Confidence "), _percent(score), F.lit(" is below "),
                        _percent(threshold), F.lit(f" threshold for mode '{mode}'. "
                                                   "Queued for human review."))
    why = F.col(WHY).withField("meals", F.coalesce(meals, F.lit(False))).withField(
        "boost", F.when(boosted, b["amount"])).withField(
        "signals", F.when(boosted, F.array_join(b["signals"], ", ")))
    return out.withColumns({
        "account_code": d["code"], "account_name": d["name"], "account_type": d["type"],
        "category": d["category"], "subcategory": d["subcategory"],
        "confidence_score": score, "categorization_layer": d["layer"],
        "matched_rule_id": d["rule_id"],
        "deductible": d["deductible"],
        "deduction_limit": F.when(meals, 0.50).otherwise(d["limit"]),
        "deductible_pct": F.when(meals, F.lit("0.50")).otherwise(F.lit("1.00"))
        .cast("decimal(4,2)"),
        "irs_ref": d["ref"],
        "schedule_c_line": F.when(scored, tax_line(d["code"])).otherwise(""),
        "required_review": F.col("required_review") | below | (d["layer"] == "uncategorized"),
        "flags": F.concat("flags", compact((noted, d["flag"]), (below, "BELOW_THRESHOLD"))),
        "flag_notes": F.concat("flag_notes", compact((noted, d["note"]), (below, low_note))),
        WHY: why,
    }).drop("_decision", "_boost", "_score")


def explain(decided: DataFrame) -> DataFrame:
    """Add ``matched_tokens`` and ``categorization_evidence``, told from ``_why``. A plain projection,
    so reports that need neither leave it out."""
    w = F.col(WHY)
    extra = compact((w["meals"], "Meals: 50% deductible per IRC Section 274"),
                    (w["boost"].isNotNull(), F.concat(
                        F.lit("Multi-signal boost +"), F.format_string("%.2f", w["boost"]),
                        F.lit(": "), w["signals"])))
    out = decided.withColumn("matched_tokens", F.when(
        w["pattern"].isNotNull(), matched_tokens(F.upper("description")))
        .otherwise(F.array().cast("array<string>")))
    return out.withColumn("categorization_evidence", F.concat(_explain(), extra))


def is_flagged() -> Column:
    return F.size("flags") > 0


def needs_review() -> Column:
    return (F.col("confidence_score") < REVIEW_BELOW) | is_flagged() | F.col("required_review")


def mean_confidence(score: Column) -> Column:
    """Mean to three digits from an exact sum, so partition order cannot change it."""
    return F.bround(F.sum(score.cast("decimal(10,4)")) / F.count("*"), 3).cast("double")


def batch_stats(categorized: DataFrame, by: list[str] = ["batch_id"]) -> DataFrame:
    layer = F.col("categorization_layer")
    named = ["pre_classifier", "loan_splitter", "exact_match", "learned_match", "pattern_match"]
    labels = ["pre_classified", "loan_split", "exact_match", "learned_match", "pattern_match"]
    return categorized.groupBy(*by).agg(
        F.count("*").alias("total"),
        *[count_if(layer == n).alias(a) for n, a in zip(named, labels)],
        count_if(~layer.isin(named)).alias("uncategorized"),
        count_if(layer.isin(named)).alias("auto_categorized"),
        count_if(is_flagged()).alias("flagged"), count_if(needs_review()).alias("review_queue"),
        mean_confidence(F.col("confidence_score")).alias("avg_confidence"))


def review_queue(categorized: DataFrame) -> DataFrame:
    return categorized.where(needs_review())


def accuracy(categorized: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Share of labelled rows with the expected account, and whether it reaches 90%.

    ``labels`` may have any size: the optimiser decides how they travel."""
    hit = F.col("account_code") == F.col("expected_account_code")
    share = F.count_if(hit) / F.count("*")
    return categorized.join(labels, keys).agg(
        F.count("*").alias("total"), count_if(hit).alias("correct"),
        count_if(~hit).alias("mismatches"), F.round(share, 4).alias("accuracy"),
        (F.count_if(hit) * 10 >= F.count("*") * 9).alias("passes"))


def declarative_text(description: Column) -> Column:
    """Upper case without the table's noise tokens and trailing digits."""
    words = F.filter(F.split(F.upper(F.trim(description)), r"\s+"),
                     lambda w: ~w.isin(declarative.NOISE_TOKENS))
    return F.trim(F.regexp_replace(F.array_join(words, " "), r"\s*\d+$", ""))


def declarative_match(description: Column, amount: Column, direction: Column) -> Column:
    """Struct of the most confident declarative rule that fits, or null.

    Keywords are looked for in the upper-case description; noise tokens stay, since some
    keywords hold them.
    """
    return declarative_row(declarative_place(description, direction), amount)


def declarative_place(description: Column, direction: Column) -> Column:
    """1-based place of that rule, or null."""
    chain, upper = F, F.upper(F.trim(description))
    for place, rule in enumerate(declarative.rules(), 1):
        side = F.lit(True) if rule["direction"] == "BOTH" else direction == rule["direction"]
        chain = chain.when(side & contains_any(upper, rule["words"]), F.lit(place))
    return chain


def declarative_row(place: Column, amount: Column) -> Column:
    """Struct of the rule at ``place``, with whether the amount asks for review."""
    keys = ("rule_id", "account", "category", "subcategory", "confidence", "review_from",
            "deductible_pct", "flag", "tax_line")
    hit = pick([{k: r[k] for k in keys} for r in declarative.rules()],
               "rule_id:string,account:string,category:string,subcategory:string,"
               "confidence:double,review_from:string,deductible_pct:string,flag:string,"
               "tax_line:string", place)
    over = F.coalesce(amount >= F.nullif(hit["review_from"], F.lit("")).cast("decimal(18,2)"),
                      F.lit(False))
    return let(F.struct(hit.alias("h"), over.alias("o")), lambda x: F.when(
        x["h"].isNotNull(), x["h"].withField("requires_review", x["o"])))
