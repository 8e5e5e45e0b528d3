"""Operators on small fixed rows, with results worked out by hand."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from bookloom.functions import matching, money
from bookloom.operators import (categorize, client_rules, corrections, loans, merchant, pnl, scrub,
                                skew)
from bookloom.plans.analysis import Analysis, Inputs
from bookloom.rules.detectors import CONTEXT
from bookloom.sources import sinks, statements
from bookloom.streaming import ingest

# description | side | amount | expected account
LABELLED = """
STRIPE PAYOUT 12345|CREDIT|1250.00|4000
SQUARE DEPOSIT 03/10|CREDIT|980.00|4000
ACH DEPOSIT - CLIENT PAYMENT|CREDIT|2200.00|4000
WIRE TRANSFER IN FROM CUSTOMER|CREDIT|4800.00|4000
CHECK DEPOSIT #4451|CREDIT|750.00|4000
VENMO PAYMENT FROM JANE|CREDIT|120.00|4000
INSURANCE CLAIM PAYMENT GEICO|CREDIT|600.00|4500
VENDOR REFUND FROM STAPLES|CREDIT|85.00|4510
EMPLOYEE REIMBURSEMENT Q2|CREDIT|250.00|4520
TRANSFER FROM SAVINGS ACCOUNT|CREDIT|1500.00|1000
SBA LOAN PROCEED DEPOSIT|CREDIT|15000.00|2300
OWNER CONTRIBUTION DEPOSIT|CREDIT|5000.00|3200
SHELL OIL 1234|DEBIT|95.00|6120
AUTOZONE PARTS|DEBIT|310.00|5120
US FOODS INVOICE|DEBIT|1200.00|5000
MONTHLY SERVICE FEE|DEBIT|12.00|6300
QUICKBOOKS SUBSCRIPTION|DEBIT|55.00|6400
COMCAST BUSINESS INTERNET|DEBIT|132.00|6110
RENT PAYMENT MAIN OFFICE|DEBIT|2800.00|6100
STARBUCKS|DEBIT|14.50|6150
UPS STORE LABEL|DEBIT|28.00|6360
ADP PAYROLL RUN|DEBIT|3200.00|6000
GUSTO PAYROLL|DEBIT|2800.00|6010
PROGRESSIVE INSURANCE PREMIUM|DEBIT|350.00|6200
TRANSFER TO SAVINGS ACCOUNT|DEBIT|900.00|1020
OWNER DRAW APRIL|DEBIT|2000.00|3100
ATM WITHDRAWAL 123 MAIN ST|DEBIT|300.00|3100
SALES TAX PAYMENT STATE OF CA|DEBIT|420.00|2120
SBA LOAN PAYMENT|DEBIT|820.13|2300
VENMO PAYMENT TO JOHN DOE|DEBIT|120.00|6900
AMAZON PURCHASE|DEBIT|45.00|6350
""".strip().splitlines()


def transactions(spark, rows):
    data = [(1, "b1", i, f"t{i}", "2024-03-%02d" % (i % 28 + 1), r[0], D(r[2]), r[1])
            for i, r in enumerate(rows)]
    return spark.createDataFrame(
        data, "client_id bigint, batch_id string, seq bigint, transaction_id string, date string, "
              "description string, amount decimal(18,2), direction string")


def batches(spark, opening, closing):
    return spark.createDataFrame(
        [(1, "b1", opening, closing, "f.csv", "bank_statement")],
        "client_id bigint, batch_id string, beginning_balance decimal(18,2), "
        "ending_balance decimal(18,2), source_document string, document_type string") \
        .withColumns({"period_start": F.to_date(F.lit("2024-03-01")),
                      "period_end": F.to_date(F.lit("2024-03-31"))})


def labelled(spark, closing=None):
    rows = [x.split("|") for x in LABELLED]
    net = sum(D(r[2]) if r[1] == "CREDIT" else -D(r[2]) for r in rows)
    end = D("1000.00") + net if closing is None else closing
    return rows, Analysis(Inputs(transactions(spark, rows), batches(spark, D("1000.00"), end)))


def test_labelled_accounts(spark):
    rows, a = labelled(spark)
    got = {r.seq: r.account_code for r in a.categorized.select("seq", "account_code").collect()}
    assert got == {i: r[3] for i, r in enumerate(rows)}


def test_books_balance_and_reconcile(spark):
    _, a = labelled(spark)
    t = a.trial_totals.first()
    assert t.is_balanced and t.difference == 0
    assert a.reconciled.first().status == "GREEN"
    assert a.verdict.first().overall_status == "PASS_WITH_WARNINGS"


def test_wrong_balance_blocks_and_flags_every_row(spark):
    rows, a = labelled(spark, closing=D("5.00"))
    assert a.reconciled.first().status == "RED"
    assert a.verdict.first().overall_status == "BLOCKED"
    assert a.flagged.where(F.array_contains("flags", "BALANCE_MISMATCH")).count() == len(rows)


def _split(spark, text, amount, **tables):
    rows = transactions(spark, [(text, "DEBIT", amount)])
    r = loans.analyze(rows, **tables).select("is_loan", "loan_type", "split.*").first()
    return r


def test_loan_splits(spark):
    r = _split(spark, "SBA LOAN PAYMENT", "10000")
    assert (r.interest, r.principal, r.source) == (D("500.00"), D("9500.00"), "estimated")
    r = _split(spark, "LOAN PAYMENT INTEREST $150.00", "1000")
    assert (r.principal, r.interest, r.source) == (D("850.00"), D("150.00"), "description")
    manual = spark.createDataFrame(
        [(1, 0, "EQUIPMENT", D("0.65"), D("0.30"), D("0.05"))],
        "client_id bigint, ordinal int, pattern string, principal_pct decimal(5,4), "
        "interest_pct decimal(5,4), fees_pct decimal(5,4)")
    r = _split(spark, "EQUIPMENT FINANCING PMT", "2000", manual=manual)
    assert (r.principal, r.interest, r.fees) == (D("1300.00"), D("600.00"), D("100.00"))


def test_schedule_prefers_exact_date(spark):
    plan = spark.createDataFrame(
        [(1, 0, "L0", "2024-01-01", D("500.40"), D("1"), D("2")),
         (1, 0, "L0", "2024-03-01", D("499.60"), D("3"), D("4"))],
        "client_id bigint, loan_ordinal int, loan_id string, date string, payment decimal(18,2), "
        "principal decimal(18,2), interest decimal(18,2)")
    r = _split(spark, "NOTE PAYMENT 1", "500.00", schedules=plan)
    assert (r.principal, r.interest, r.source) == (D("3.00"), D("4.00"), "amortization")


def test_merchant_names(spark):
    df = spark.createDataFrame([("SYSCO FOOD SERVICE #1234",), ("STRIPE PAYOUT 04/01",)],
                               "description string").withColumn("seq", F.col("description"))
    got = [r.canonical_merchant_id for r in merchant.normalize(df).orderBy("seq").collect()]
    assert got == ["STRIPE_PAYOUT", "SYSCO"]


def test_vendor_tiers(spark):
    df = spark.createDataFrame([("AMZN", D("15.99")), ("AMZN", D("350")), ("AMZN", D("1200"))],
                               "t string, amount decimal(18,2)")
    got = [r[0] for r in df.orderBy("amount").select(
        categorize.vendor_tier(F.col("t"), F.col("amount"))["account"]).collect()]
    assert got == ["6350", "6410", "6900"]


def test_money_rules(spark):
    df = spark.createDataFrame([("$1,234.50",), ("(12.00)",), ("x",)], "raw string")
    assert [r[0] for r in df.select(money.parse_amount(F.col("raw"))).collect()] == [
        D("1234.50"), D("-12.00"), None]
    row = spark.sql("SELECT CAST(1.005 AS DECIMAL(10,3)) a, CAST(33.335 AS DECIMAL(10,3)) b")
    assert tuple(row.select(money.cents(F.col("a")), money.cents(F.col("b"))).first()) == (
        D("1.01"), D("33.34"))
    floats = spark.createDataFrame([(1.0,)], "amount double")
    try:
        money.require_exact_money(floats, ["amount"])
        raise AssertionError("floats must be refused")
    except TypeError:
        pass


def test_profit_and_loss_identity(spark):
    values = dict.fromkeys(pnl.BUCKETS, D("0"))
    values.update(gross_revenue=D("10000"), refunds=D("500"), inventory_costs=D("3000"),
                  direct_labor=D("1000"), rent=D("1500"), utilities=D("300"), insurance=D("200"),
                  marketing=D("250"), software=D("150"), bank_fees=D("50"), other_opex=D("200"),
                  interest_expense=D("150"))
    ddl = ", ".join(f"{b} decimal(18,2)" for b in pnl.BUCKETS)
    r = pnl.measures(spark.createDataFrame([tuple(values[b] for b in pnl.BUCKETS)], ddl)).first()
    assert (r.net_revenue, r.total_cogs, r.total_opex, r.net_profit) == (
        D("9500.00"), D("4000.00"), D("2650.00"), D("2700.00"))
    assert (r.gross_margin_pct, r.operating_margin_pct, r.net_margin_pct) == (
        D("57.89"), D("30.00"), D("28.42"))


def test_word_search_equals_contains(spark):
    words = ["GAS", "GAS BILL", "BILL", "A+B", "AT&T", "LL", "RENT"]
    texts = ["PAY GAS BILL", "PARENT", "A+B AT&T", "GASBILL", "", "NONE"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", matching.found_words(F.col("t"), words).alias("w"),
                       matching.contains_any(F.col("t"), words).alias("any"),
                       matching.first_word(F.col("t"), words).alias("first")).collect():
        want = [w for w in words if w in r.t]
        assert sorted(r.w) == sorted(want) and r.any == bool(want)
        assert r.first == (words.index(want[0]) + 1 if want else None)


def test_hot_keys_join_like_plain_joins(spark):
    facts = spark.range(400).selectExpr("id AS seq", "IF(id < 300, 0, id % 7) AS k")
    sums = facts.groupBy("k").agg(F.count("*").alias("rows"), F.max("seq").alias("top"))
    got = skew.join_totals(facts, sums, ["k"], "rows", F.col("seq"), hot_rows=50)
    want = facts.join(sums.drop("rows"), "k", "left")
    assert sorted(map(tuple, got.select("seq", "k", "top").collect())) == sorted(
        map(tuple, want.select("seq", "k", "top").collect()))
    numbered = skew.running_index(facts, ["k"], "seq", 16)
    by_key: dict = {}
    for r in numbered.orderBy("seq").collect():
        by_key[r.k] = by_key.get(r.k, 0) + 1
        assert r.nth == by_key[r.k]


def test_client_rules(spark):
    rows = spark.createDataFrame(
        [(1, 1, "PAY ACME WIDGETS", "DEBIT"), (2, 1, "ACME", "CREDIT"), (1, 2, "ZZ", "DEBIT"),
         (4, 1, "AB", "DEBIT"), (5, 3, "ANYTHING", "DEBIT"), (6, 3, None, "DEBIT")],
        "seq bigint, client_id bigint, t string, direction string")
    many = spark.range(25_000).selectExpr(
        "4L AS client_id", "id AS created", "concat('NO SUCH TEXT ', id) AS pattern", "'' AS side",
        "'m' AS code")
    rules = spark.createDataFrame(
        [(1, 0, "ACME", "", "x"), (1, 1, "ACME WIDGETS", "DEBIT", "y"), (2, 0, "Z", "", "z"),
         (1, 2, "AB", "CREDIT", "w"), (3, 0, "", "", "e")],
        "client_id bigint, created bigint, pattern string, side string, code string") \
        .unionByName(many).withColumn("len", -F.length("pattern"))
    hit = client_rules.match_client_rules(
        rows, rules, F.col("t"), "pattern", ["len", "created"], ["code"], "m",
        side=F.col("direction"), rule_side="side")
    got = {(r.client_id, r.seq): r.code for r in hit.select("client_id", "seq", "m.code").collect()}
    # an empty pattern is in every text
    assert got == {(1, 1): "y", (1, 2): "x", (2, 1): "z", (1, 4): None, (3, 5): "e", (3, 6): None}


def test_schedules_keep_clients_apart(spark):
    rows = spark.createDataFrame(
        [(1, "b1", 1, "2024-03-05", "SBA LOAN PAYMENT", D("500.00"), "DEBIT"),
         (2, "b2", 1, "2024-03-05", "SBA LOAN PAYMENT", D("900.00"), "DEBIT"),
         (1, "b1", 2, "2024-04-05", "SBA LOAN PAYMENT", D("500.00"), "DEBIT"),
         (1, "b1", 3, "2024-04-05", None, D("500.00"), "DEBIT")],
        "client_id bigint, batch_id string, seq bigint, date string, description string, "
        "amount decimal(18,2), direction string")
    schedule = [(1, 0, "L1", f"20{25 + i // 12}-{i % 12 + 1:02d}-05", D("500.00"), D(400 - i), D(100 + i), None)
                for i in range(360)]
    schedule += [(1, 0, "L1", "2024-04-05", D("500.00"), D("333.00"), D("167.00"), None),
                 (2, 0, "L2", "2024-01-05", D("900.00"), D("600.00"), D("300.00"), None)]
    table = spark.createDataFrame(
        schedule, "client_id bigint, loan_ordinal int, loan_id string, date string, "
                  "payment decimal(18,2), principal decimal(18,2), interest decimal(18,2), "
                  "balance decimal(18,2)")
    got = loans.analyze(rows, schedules=table)
    assert got.count() == 4
    split = {(r.client_id, r.seq): r.split and (r.split.principal, r.split.source) for r in got.collect()}
    assert split == {(1, 1): (D("333.00"), "amortization"), (2, 1): (D("600.00"), "amortization"),
                     (1, 2): (D("333.00"), "amortization"), (1, 3): None}


def test_dates_as_statements_write_them(spark):
    from bookloom.functions.dates import iso_date

    cases = {"25/12/2024": "2024-12-25", "12/05/2024": "2024-12-05", "March 5, 2024": "2024-03-05",
             "5 Jan 2024": "2024-01-05", "2024-03-01T10:00:00": "2024-03-01",
             "03.15.2024": "2024-03-15", "20240315": "2024-03-15", "Sept 3, 2024": "2024-09-03",
             "SEP 3 2024": "2024-09-03", "3/4": "2023-03-04", "1-2-68": "2068-01-02",
             "1/2/69": "1969-01-02", "13/13/2024": "13/13/2024", " soon ": "soon"}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: r.iso for r in df.withColumn("iso", iso_date(F.col("raw"), 2023)).collect()}
    assert got == cases


def test_percent_of_manual_split_rounds_half_even(spark):
    rows = spark.createDataFrame([(1, "b", 1, "2024-01-01", "SBA LOAN PAYMENT", D("1000.00"), "DEBIT")],
                                 "client_id bigint, batch_id string, seq bigint, date string, "
                                 "description string, amount decimal(18,2), direction string")
    shares = spark.createDataFrame([(1, 0, "SBA", D("0.6450"), D("0.3550"), D("0.0000"))],
                                   "client_id bigint, ordinal int, pattern string, principal_pct "
                                   "decimal(5,4), interest_pct decimal(5,4), fees_pct decimal(5,4)")
    evidence = loans.analyze(rows, manual=shares).select("split.evidence").first()[0]
    assert evidence == "Manual split applied: 64% principal, 36% interest"


def test_empty_batch_is_blocked(spark):
    rows = transactions(spark, [("STRIPE PAYOUT", "CREDIT", "10.00")])
    both = batches(spark, D("0.00"), D("10.00")).unionByName(
        batches(spark, D("5.00"), D("5.00")).withColumn("batch_id", F.lit("b2")))
    a = Analysis(Inputs(rows, both))
    status = {r.batch_id: r.overall_status for r in a.verdict.collect()}
    assert set(status) == {"b1", "b2"} and status["b2"] == "BLOCKED"
    sheet = {r.batch_id: (r.transaction_count, r.total_debits) for r in a.cover.collect()}
    assert sheet["b2"] == (0, D("0.00")) and sheet["b1"][0] == 1


def test_quoted_cells(spark):
    cases = ['a,"b,c",d', '"x ""y"" z",1', 'a,"b', 'a,b",c,"d,e"', '"",,"  q,r "', "plain,text"]
    want = [["a", "b,c", "d"], ['x "y" z', "1"], ["a,\"b"], ['a,b"', "c", "d,e"], ["", "", "  q,r "],
            ["plain", "text"]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = df.select("i", statements.split_cells(F.col("c"), F.lit(",")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == want


def test_long_prefix_keeps_its_tail(spark):
    from bookloom.operators import merchant
    from bookloom.rules import merchants

    text = merchants.LIGHT_PREFIXES[0] + " " + "A" * 1_000_050
    got = spark.createDataFrame([(text,)], "t string").select(
        F.length(merchant.light_clean(F.col("t"))).alias("n")).first()
    assert got.n == 1_000_050


def test_correction_log(spark):
    cols = ("client_id bigint, event_seq bigint, kind string, description string, "
            "account_code string, account_name string, account_type string, category string, "
            "subcategory string, deductible boolean, irs_ref string, direction string, notes string, "
            "source string")
    row = lambda n, kind, code, cat="": (1, n, kind, f"SYSCO #{n}234", code, "n", "COGS", cat, "",
                                         True, "", "", "", "human_override")
    log = spark.createDataFrame([row(0, "override", None), row(1, "correct", "5000", "food"),
                                 row(2, "correct", "5120"), row(3, "override", None)], cols)
    r = corrections.fold(log).first()
    assert (r.account_code, r.category, r.times_confirmed, r.times_overridden) == ("5120", "food", 1, 1)
    assert abs(r.confidence - 0.81) < 1e-9


SAMPLE = ("Account number: 1234567890 SSN 123-45-6789 mail a.b@example.com\n"
          "Call (212) 555-0199 card 4111 1111 1111 1111 ip 10.0.0.1")


def test_redaction_leaves_no_kept_span(spark):
    df = spark.createDataFrame([("s", SAMPLE), ("t", "nothing here")], "source_id string, text string")
    out = {r.source_id: r for r in scrub.redact(scrub.detect(df)).collect()}
    for span in out["s"].kept:
        assert SAMPLE[span.start:span.stop] == span.value
        assert span.value not in out["s"].redacted
    assert "CARD-XXXX1111" in out["s"].redacted and out["t"].redacted == "nothing here"


def test_folder_stream_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text(SAMPLE)
    (folder / "b.csv").write_text('Date,Description,Amount\n03/01/2024,"A, B",-5.00\n03/02/2024,C,7\n')
    q = ingest.scrub_folder(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    lines = statements.read_lines(spark, str(folder / "b.csv"))
    got = statements.delimited(lines, 2024).orderBy("seq").collect()
    assert [(r.date, r.description, r.amount, r.direction) for r in got] == [
        ("2024-03-01", "A, B", D("5.00"), "DEBIT"), ("2024-03-02", "C", D("7.00"), "CREDIT")]
    _, a = labelled(spark)
    stored = a.use_stored(sinks.materialize(a.posted, str(tmp_path / "posted")))
    sinks.write_package(stored.package, str(tmp_path / "package"))
    assert spark.read.json(str(tmp_path / "package")).select("section").distinct().count() == 17


def test_many_spans_in_one_text(spark):
    """More hits than a chunk holds, of several types, overlapping and at both ends."""
    n = 700
    text = " ".join(f"call (212) 555-{1000 + i} u{i}@mail.example.com" for i in range(n))
    rows = spark.createDataFrame([(1, text), (2, ""), (3, "plain")], "source_id int, text string")
    row = scrub.redact(scrub.detect(rows, only=["PHONE", "EMAIL"])).orderBy("source_id")
    full, empty, plain = row.collect()
    assert [text[d.start:d.stop] for d in full.detections] == [d.value for d in full.detections]
    assert all(d.context == text[max(0, d.start - CONTEXT):d.stop + CONTEXT] for d in full.detections)
    assert len(full.kept) >= 2 * n and all(a.stop <= b.start for a, b in zip(full.kept, full.kept[1:]))
    at, want = 0, ""
    tokens = {r.start: r.token for r in spark.createDataFrame([full]).select(
        "text", F.explode("kept").alias("k")).select("k.start", scrub.replacement(F.col("k")).alias("token")).collect()}
    for k in full.kept:
        want, at = want + text[at:k.start] + tokens[k.start], k.stop
    assert full.redacted == want + text[at:]
    assert (empty.redacted, plain.redacted) == ("", "plain")


def test_scrubbed_texts_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", "mail me@x.com"), ("b", "nothing")], "source_id string, text string")
    sinks.write_scrubbed(scrub.report(scrub.redact(scrub.detect(rows, only=["EMAIL"]))), str(tmp_path))
    texts = {r.source_id: r.redacted for r in spark.read.parquet(str(tmp_path / "scrubbed")).collect()}
    items = {r.source_id: r["items"] for r in spark.read.parquet(str(tmp_path / "reports")).collect()}
    assert texts["b"] == "nothing" and "me@x.com" not in texts["a"] and items == {"a": 1, "b": 0}


def test_statement_files_to_verdict(spark, tmp_path):
    folder = tmp_path / "statements"
    folder.mkdir()
    (folder / "march.txt").write_text(
        "FIRST EXAMPLE BANK\nAccount #: ****1234\nStatement Period: December 15 - January 14, 2024\n"
        "Beginning Balance: $100.00\n01/05  STRIPE PAYOUT 1   50.00\n01/06  SHELL OIL 12   -20.00\n"
        "Ending Balance: $130.00\n")
    (folder / "card.csv").write_text('Date,Description,Amount\n2024-01-03,"SYSCO, INC",-9.50\n')
    (folder / "empty.txt").write_text("nothing to see")
    q = ingest.read_folder(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck2"), 2024)
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out" / "transactions")).drop("run")
    batches_ = spark.read.parquet(str(tmp_path / "out" / "batches")).drop("run")
    assert sorted((r.date, r.description, r.amount, r.direction) for r in rows.collect()) == [
        ("2024-01-03", "SYSCO, INC", D("9.50"), "DEBIT"),
        ("2024-01-05", "STRIPE PAYOUT 1", D("50.00"), "CREDIT"),
        ("2024-01-06", "SHELL OIL 12", D("20.00"), "DEBIT")]
    by_name = {r.source_document.rsplit("/", 1)[-1]: r for r in batches_.collect()}
    march = by_name["march.txt"]
    assert (str(march.period_start), str(march.period_end)) == ("2023-12-15", "2024-01-14")
    assert (march.beginning_balance, march.ending_balance, march.account_last4) == (
        D("100.00"), D("130.00"), "1234")
    assert {n: r.success for n, r in by_name.items()} == {
        "march.txt": True, "card.csv": True, "empty.txt": False}
    a = Analysis(Inputs(rows, batches_))
    status = {r.batch_id: r.overall_status for r in a.verdict.collect()}
    assert len(status) == 3 and status[march.batch_id] != "BLOCKED"
    assert {r.source_document.rsplit("/", 1)[-1] for r in a.cover.collect()} == set(by_name)
