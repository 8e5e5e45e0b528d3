"""Bookkeeping inputs derived from the order and document tables.

Credits come from orders and debits from order lines; client, date, amount and
description follow from the keys, so the volume grows with the tables. Everything is a
narrow projection: row ids are hashes of the row, no window or shuffle numbers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.functions.matching import literal
from bookloom.functions.money import MONEY
from bookloom.functions.plan import widen
from bookloom.operators import corrections, reconcile
from bookloom.rules import accounts, loans

CLIENTS = 50
DEFAULT_YEAR = 2024
SEQ_BITS = 61
# Slice width for running counts: 1024 slices of the id space.
SEQ_SLICE = 1 << (SEQ_BITS - 10)

CREDIT_TEXTS = """
STRIPE PAYOUT 12345
SQUARE DEPOSIT 03/10
ACH DEPOSIT - CLIENT PAYMENT
WIRE TRANSFER IN FROM CUSTOMER
CHECK DEPOSIT #4451
VENMO PAYMENT FROM JANE
INSURANCE CLAIM PAYMENT GEICO
VENDOR REFUND FROM STAPLES
EMPLOYEE REIMBURSEMENT Q2
TRANSFER FROM SAVINGS ACCOUNT
SBA LOAN PROCEED DEPOSIT
OWNER CONTRIBUTION DEPOSIT
SHOPIFY PAYOUT
TOAST DEPOSIT 88
POS BATCH 221
DAILY SALES SUMMARY
CASH DEPOSIT BRANCH 12
CONSULTING FEE ACME
SERVICE PAYMENT NORTHSIDE
ZELLE FROM MARIA
PAYPAL INST XFER
CUSTOMER RETURN ADJ
CHARGEBACK DISPUTE
CREDIT MEMO 9981
GEICO PMT
INTEREST CREDIT
MISC CREDIT ITEM
Deposit 12345
REVENUE SHARE PARTNER
STATE TREASURY PYMT
ACME WIDGETS REBATE
OWNER DRAW RETURNED
SHELL OIL CREDIT
FEDEX CREDIT ADJ
LINE OF CREDIT ADVANCE
CLOVER DEPOSIT STORE 4
LIBERTY MUTUAL ADJ
RECEIVED RENTAL INCOME
AMAZON SELLER PMT
INVOICE PMT 7781
""".strip().splitlines()

DEBIT_TEXTS = """
SHELL OIL 1234
CHEVRON #9901
AUTOZONE PARTS
NAPA AUTO PARTS
US FOODS INVOICE
SYSCO FOODS ORDER
COPART VEHICLE PURCHASE
MONTHLY SERVICE FEE
OVERDRAFT FEE
QUICKBOOKS SUBSCRIPTION
ADOBE CREATIVE CLOUD
FACEBOOK ADS MARCH
GOOGLE ADS CAMPAIGN
COMCAST BUSINESS INTERNET
AT&T BUSINESS WIRELESS
RENT PAYMENT MAIN OFFICE
PUBLIC STORAGE UNIT
STARBUCKS
GRUBHUB ORDER
UPS STORE LABEL
USPS SHIPPING
ADP PAYROLL RUN
GUSTO PAYROLL
PROGRESSIVE INSURANCE PREMIUM
STATE FARM INSURANCE
TRANSFER TO SAVINGS ACCOUNT
OWNER DRAW APRIL
ATM WITHDRAWAL 123 MAIN ST
SALES TAX PAYMENT STATE OF CA
SBA LOAN PAYMENT
VENMO PAYMENT TO JOHN DOE
AMAZON PURCHASE
AMZN MKTP US
WAL-MART SUPERCENTER 55
TARGET STORE 0192
BEST BUY 00412
LOAN PAYMENT INTEREST $150.00
EQUIPMENT FINANCING PMT LATE FEE $50
SBA LOAN PMT FEE $25.00
MERCHANT ADVANCE REMIT
LINE OF CREDIT PMT
NOTE PAYMENT 4471
BUSINESS LOAN INSTALLMENT
LAPTOP SERVER UPGRADE
FORKLIFT DEALERSHIP
OFFICE FURNITURE DESK
TENANT IMPROVEMENT BUILD OUT
NETFLIX.COM
WHOLE FOODS MARKET
O'REILLY AUTO PARTS
DELTA AIRLINE TICKET
UBER EATS ORDER
UBER TRIP 8812
PIZZA KITCHEN CATERING
RENEWAL ANNUAL MEMBERSHIP
LAW OFFICE OF SMITH
CITY PERMIT LICENSE
IRS EFTPS 1040
CHECKING MONTHLY MAINTENANCE
NORTHSIDE HARDWARE #22
ACME WIDGETS 5521
ZELLE TO CONTRACTOR
UNKNOWN VENDOR 99
HOME DEPOT 4410
CASH WITHDRAWAL BRANCH
PERSONAL TRANSFER OUT
POWER AND LIGHT
WATER DEPARTMENT
PREMIUM AUDIT
PROPERTY UPKEEP
WAGES ADJ
SUPPLIES WHOLESALE
XFER TO CHECKING
EQUIPMENT RENTAL
JIFFY LUBE MIDAS FIRESTONE
MARRIOTT HOTEL UNITED
COSTCO GAS STATION
SQ *COFFEE CART
KROGER GROCERY
PLANET FITNESS GYM
""".strip().splitlines()

ROUND_AMOUNTS = [500, 1000, 2500, 5000, 10000, 15000, 20000]

# What clients have taught the system: text|account|name|type|side, oldest first.
LESSONS = """
VENMO PAYMENT TO JOHN DOE|6020|Contract Labor|EXPENSE|DEBIT
NORTHSIDE HARDWARE|6350|Office Supplies|EXPENSE|
ACME WIDGETS|5120|Parts & Materials - COGS|COGS|DEBIT
ACME|6900|Miscellaneous Expense|EXPENSE|
UNKNOWN VENDOR 99|6150|Meals & Entertainment|EXPENSE|DEBIT
MISC CREDIT ITEM|4200|Service Revenue|REVENUE|CREDIT
STATE TREASURY|4520|Other Reimbursements|REVENUE|
POWER AND|6110|Utilities|EXPENSE|DEBIT
""".strip().splitlines()

# Merchant names of a client's own: pattern|merchant|account.
OWN_MERCHANTS = """
northside|NORTHSIDE_HW|6350
PARTS|PARTS_HOUSE|5120
ACME WIDGETS|ACME|5120
STARBUCKS|COFFEE_BAR|6150
""".strip().splitlines()


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _texts(lines: list[str]) -> Column:
    return literal(lines, "array<string>")


def _pick(lines: list[str], key: Column) -> Column:
    return F.get(_texts(lines), (F.pmod(key, F.lit(len(lines)))).cast("int"))


def _description(lines: list[str], key: Column) -> Column:
    """A text by key, in one of the spellings banks use."""
    text, style = _pick(lines, key), F.pmod(F.shiftright(key, 20), F.lit(8))
    return (F.when(style == 1, F.concat(text, F.lit(" #"), F.pmod(key, F.lit(100000)).cast("string")))
            .when(style == 2, F.concat(text, F.lit(" 03/15")))
            .when(style == 3, F.concat(F.lit("POS "), text))
            .when(style == 4, F.lower(text))
            .when(style == 5, F.concat(text, F.lit(" CARD 1234")))
            .otherwise(text))


def _amount(price: Column, key: Column) -> Column:
    raw = F.round(price * 100).cast("bigint")
    cents = (F.when(F.pmod(key, F.lit(1009)) == 5, F.lit(0))
             .when(F.pmod(key, F.lit(17)) == 0, F.get(
                 F.array(*[F.lit(a * 100) for a in ROUND_AMOUNTS]),
                 F.pmod(F.shiftright(key, 12), F.lit(7)).cast("int")))
             .when(F.pmod(key, F.lit(5)).isin(1, 2), F.pmod(raw, F.lit(20000)) + 1)
             .when(F.pmod(key, F.lit(5)) == 3, F.pmod(raw, F.lit(60000)) + 1)
             .otherwise(F.pmod(raw, F.lit(1200000)) + 1))
    return (cents.cast("decimal(16,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)


def _copies(key: Column) -> Column:
    """Every 23rd row arrives twice, as imports that overlap do: the numbers of its copies."""
    return F.explode(F.when(F.pmod(key, F.lit(23)) == 7, F.array(F.lit(0), F.lit(1)))
                     .otherwise(F.array(F.lit(0))))


def _hash(parts: list[str]) -> Column:
    """60-bit id of a row."""
    text = F.concat_ws("|", *[F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def transaction_id() -> Column:
    return F.concat(F.lit("t"), F.col("seq").cast("string"))


def _rows(df: DataFrame, key: str, client: Column, when: Column, price: Column,
          texts: list[str], side: str) -> DataFrame:
    k = F.col(key)
    df = df.select(k, client.alias("_client"), F.date_format(when, "yyyy-MM-dd").alias("_date"),
                   _description(texts, k).alias("_text"), _amount(price, k).alias("_amount"))

    # only numbers are copied, so a reader works out no column that it doesn't read
    owner = F.pmod("_client", F.lit(CLIENTS)).cast("bigint")
    return (df.select("*", _copies(k).alias("_copy"))
            .select(owner.alias("client_id"), (k * 2 + F.col("_copy")).alias("seq"), "_date", "_text", "_amount")
            .select("client_id", "seq", F.col("_date").alias("date"), F.col("_text").alias("description"),
                    F.col("_amount").alias("amount"), F.lit(side).alias("direction"),
                    F.concat(F.lit("c"), F.col("client_id").cast("string"), F.lit("-"),
                             F.substring("_date", 1, 7)).alias("batch_id"),
                    transaction_id().alias("transaction_id")))


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """client_id, batch_id, seq, transaction_id, date, description, amount, direction."""
    orders = widen(read(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), "o_orderkey").withColumn(
        "k", _hash(["o_orderkey", "o_custkey"]))
    lines = widen(read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"),
        "l_partkey").withColumn(
        "price_text", F.round(F.col("l_extendedprice") * 100).cast("bigint")).withColumn(
        "ship", F.date_format("l_shipdate", "yyyy-MM-dd")).withColumn(
        "k", _hash(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_text", "ship"]))
    return _rows(orders, "k", F.col("o_custkey"), F.col("o_orderdate"), F.col("o_totalprice"),
                 CREDIT_TEXTS, "CREDIT").unionByName(
        _rows(lines, "k", F.col("l_suppkey"), F.col("l_shipdate"), F.col("l_extendedprice"),
              DEBIT_TEXTS, "DEBIT"))


def batches(rows: DataFrame) -> DataFrame:
    """One statement per client month. Opening balances run on from the months before;
    some closing balances are off or missing, so every reconciliation colour occurs."""
    month = F.substring("batch_id", -7, 7)
    sums = reconcile.totals(rows, ["client_id", "batch_id"]).withColumn("month", month)
    earlier = F.sum("net_change").over(
        W.partitionBy("client_id").orderBy("month").rowsBetween(W.unboundedPreceding, -1))
    opening = (F.lit(1000) + F.coalesce(earlier, F.lit(0))).cast(MONEY)
    n = (F.col("client_id") + F.substring("month", 1, 4).cast("int") * 12
         + F.substring("month", 6, 2).cast("int"))
    closing = (opening + F.col("net_change")).cast(MONEY)
    off = (F.when(n % 7 == 0, F.lit("12.34")).when(n % 10 == 0, F.lit("0.05"))
           .when(n % 11 == 0, F.lit("-40.00")).otherwise(F.lit("0.00"))).cast(MONEY)
    first = F.to_date(F.concat("month", F.lit("-01")))
    return sums.select(
        "client_id", "batch_id", first.alias("period_start"), F.last_day(first).alias("period_end"),
        opening.alias("beginning_balance"),
        F.when(n % 13 == 0, F.lit(None)).otherwise((closing + off).cast(MONEY))
        .cast(MONEY).alias("ending_balance"),
        F.concat("batch_id", F.lit(".csv")).alias("source_document"),
        F.lit("bank_statement").alias("document_type"))


def clients(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "customer").select(
        F.pmod("c_custkey", F.lit(CLIENTS)).cast("bigint").alias("client_id")).distinct()


def _per_client(spark, folder, rows: list[dict], ddl: str, keep: Column) -> DataFrame:
    """The listed rows for every client where ``keep`` (over client_id and ``r``) holds."""
    return (clients(spark, folder)
            .withColumn("r", F.explode(literal(rows, f"array<struct<{ddl}>>")))
            .where(keep).select("client_id", "r.*"))


def learned_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = []
    for i, line in enumerate(LESSONS):
        text, code, name, kind, side = line.split("|")
        rows.append(dict(created_seq=i, description=text, account_code=code, account_name=name,
                         account_type=kind, direction=side))
    ddl = ("created_seq:int,description:string,account_code:string,account_name:string,"
           "account_type:string,direction:string")
    base = _per_client(spark, folder, rows, ddl, (F.col("client_id") + F.col("r.created_seq")) % 3 > 0)
    return corrections.keyed(base).drop("description").withColumns({
        "category": F.lit(""), "subcategory": F.lit(""), "deductible": F.lit(True),
        "irs_ref": F.lit(""), "source": F.lit("human_override"),
        "times_applied": (F.col("client_id") * 2).cast("bigint"),
        "times_confirmed": F.pmod("client_id", F.lit(12)).cast("bigint"),
        "times_overridden": F.pmod("client_id", F.lit(5)).cast("bigint")})


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    rows = [dict(zip(("ordinal", "pattern", "canonical_id", "default_account"),
                     (i, *line.split("|")))) for i, line in enumerate(OWN_MERCHANTS)]
    ddl = "ordinal:int,pattern:string,canonical_id:string,default_account:string"
    return _per_client(spark, folder, rows, ddl, (F.col("client_id") + F.col("r.ordinal")) % 4 == 0)


def manual_splits(spark: SparkSession, folder: str) -> DataFrame:
    rows = [dict(ordinal=0, pattern="SBA LOAN", principal_pct="0.7000", interest_pct="0.3000",
                 fees_pct="0.0000"),
            dict(ordinal=1, pattern="equipment", principal_pct="0.6500", interest_pct="0.3000",
                 fees_pct="0.0500")]
    ddl = ("ordinal:int,pattern:string,principal_pct:decimal(5,4),interest_pct:decimal(5,4),"
           "fees_pct:decimal(5,4)")
    return _per_client(spark, folder, rows, ddl, (F.col("client_id") + F.col("r.ordinal")) % 4 == 0)


def schedules(rows: DataFrame) -> DataFrame:
    """Payment schedules taken from every eleventh loan row, some on another date."""
    loan = rows.where((F.col("direction") == "DEBIT") & (F.col("seq") % 11 == 0)
                      & F.upper("description").rlike("NOTE PAYMENT|INSTALLMENT|ADVANCE"))
    payment = (F.col("amount") + F.lit("0.25").cast(MONEY)).cast(MONEY)
    principal = F.round(F.col("amount") * F.lit("0.8").cast("decimal(2,1)"), 2).cast(MONEY)
    n = (F.col("seq") % 3).cast("int")
    return loan.select(
        "client_id", n.alias("loan_ordinal"), F.concat(F.lit("L"), n.cast("string")).alias("loan_id"),
        F.when(F.col("seq") % 2 == 0, F.col("date")).otherwise("2000-01-01").alias("date"),
        payment.alias("payment"), principal.alias("principal"),
        (F.col("amount") - principal).cast(MONEY).alias("interest"),
        (F.col("amount") * 10).cast(MONEY).alias("balance")).distinct()


def inventory(statement_batches: DataFrame) -> DataFrame:
    """Stock counts per statement, from its balances."""
    n = F.dayofmonth("period_end") * 10 + F.col("client_id")
    return statement_batches.select(
        "batch_id", (n * 7).cast(MONEY).alias("beginning_inventory"),
        (n * 9).cast(MONEY).alias("ending_inventory"), (n % 50).cast(MONEY).alias("labor"),
        (n % 30).cast(MONEY).alias("materials"), F.lit(5).cast(MONEY).alias("other"))


def correction_events(spark: SparkSession, folder: str) -> DataFrame:
    """A log of corrections, bulk rows and overrides, from the event stream."""
    accounts_list = literal([{"c": a["code"], "n": a["name"], "t": a["type"]}
                             for a in accounts.chart()], "array<struct<c:string,n:string,t:string>>")
    e, n = F.col("event_id"), F.col("event_seq")
    pick = F.get(accounts_list, F.pmod(e, F.lit(67)).cast("int"))
    kind = (F.when(F.col("event_type") == "error", "override")
            .when(F.col("event_type") == "view", "import").otherwise("correct"))
    return (read(spark, folder, "events").select(
        F.pmod("user_id", F.lit(CLIENTS)).cast("bigint").alias("client_id"), e.alias("event_seq"),
        kind.alias("kind"),
        F.concat(_pick(DEBIT_TEXTS, e), F.when(e % 2 == 0, F.concat(F.lit(" #"), e.cast("string")))
                 .otherwise("")).alias("description"), pick.alias("a"))
        .withColumns({
            "account_code": F.when((F.col("kind") == "import") & (n % 9 == 0), F.lit(None))
            .otherwise(F.col("a.c")),
            "account_name": F.col("a.n"), "account_type": F.col("a.t"),
            "category": F.when(n % 3 == 0, "books").otherwise(""), "subcategory": F.lit(""),
            "deductible": n % 4 != 0, "irs_ref": F.when(n % 5 == 0, "Line 9").otherwise(""),
            "direction": F.when(n % 6 == 0, "DEBIT").otherwise(""),
            "notes": F.when(n % 7 == 0, "checked").otherwise(""),
            "source": F.lit("human_override")}).drop("a"))


# --- statement texts --------------------------------------------------------

def _statement_amount(cents: Column) -> Column:
    return (cents.cast("decimal(16,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY).cast("string")


def statement_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One printed statement per order: header, balances and up to seven dated lines."""
    o, texts = F.col("o_orderkey"), CREDIT_TEXTS + DEBIT_TEXTS
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")

    def line(i: Column) -> Column:
        day = F.date_add(F.to_date("o_orderdate"), i.cast("int"))
        stamp = F.when(i % 2 == 0, F.date_format(day, "MM/dd/yyyy")).otherwise(
            F.date_format(day, "MM/dd"))
        sign = F.when((o + i) % 3 == 0, "").when((o + i) % 3 == 1, "-").otherwise("-$")
        return F.concat(stamp, F.lit("  "), _pick(texts, o + i * 13), F.lit("   "), sign,
                        _statement_amount((cents + i * 977) % 500000 + 1))

    lines = F.transform(F.sequence(F.lit(0), F.pmod(o, F.lit(7)).cast("int")), line)
    head = F.concat(
        F.lit("FIRST EXAMPLE BANK\nAccount #: ****"), F.lpad((o % 10000).cast("string"), 4, "0"),
        F.lit("\nStatement Period: "), F.date_format("o_orderdate", "MMMM d"), F.lit(" - "),
        F.date_format(F.date_add("o_orderdate", 27), "MMMM d, yyyy"),
        F.lit("\nBeginning Balance: $"), _statement_amount(cents % 900000), F.lit("\n"))
    foot = F.when(o % 5 == 0, "").otherwise(F.concat(
        F.lit("\nEnding Balance: $"), _statement_amount((cents * 3) % 900000), F.lit("\n")))
    return read(spark, folder, "orders").select(
        F.concat(F.lit("s"), o.cast("string")).alias("source_id"),
        F.concat(F.when(o % 4 == 3, F.lit("")).otherwise(head), F.array_join(lines, "\n"), foot)
        .alias("text"))


def statement_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines as extracted tables, in two header layouts."""
    o, texts = F.col("o_orderkey"), CREDIT_TEXTS + DEBIT_TEXTS
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")

    def row(i: Column) -> Column:
        day = F.date_format(F.date_add(F.to_date("o_orderdate"), i.cast("int")), "MM/dd/yyyy")
        text = F.when((o + i) % 11 == 0, "").otherwise(_pick(texts, o + i * 13))
        money = _statement_amount((cents + i * 977) % 500000)
        credit = (o + i) % 3 == 0
        one = F.when(credit, money).otherwise(F.concat(F.lit("("), money, F.lit(")")))
        return F.when(o % 2 == 0, F.array(day, text, one)).otherwise(F.array(
            day, text, F.when(credit, F.lit(None)).otherwise(money), F.when(credit, money)))

    body = F.transform(F.sequence(F.lit(0), F.pmod(o, F.lit(7)).cast("int")), row)
    head = F.when(o % 2 == 0, F.array(*map(F.lit, ["Date", "Description", "Amount"]))).otherwise(
        F.array(*map(F.lit, ["Posting_Date", " Memo ", "Withdrawals", "Deposits"])))
    return read(spark, folder, "orders").select(
        F.concat(F.lit("s"), o.cast("string")).alias("source_id"),
        F.concat(F.array(head), body).alias("table"))


# Header lines of the four delimited layouts.
LAYOUT_HEADERS = ["Date,Description,Amount", "Posting Date;Details;Debit;Credit",
                  "trans_date\tMemo\tTotal", "Effective Date|Payee|Withdrawals|Deposits"]


def delimited_lines(rows: DataFrame) -> DataFrame:
    """Bank exports: one file per batch in one of four layouts, header first (seq -1)."""
    layout = F.pmod(F.col("client_id") + F.substring("batch_id", -2, 2).cast("int"), F.lit(4))
    d, credit = F.to_date("date"), F.col("direction") == "CREDIT"
    us, iso = F.date_format(d, "MM/dd/yyyy"), F.col("date")
    text = F.when(F.col("seq") % 97 == 0, "").otherwise(F.col("description"))
    money = F.when(F.col("seq") % 89 == 0, "n/a").otherwise(F.col("amount").cast("string"))
    pair = lambda d_, sep: F.concat(
        F.when(credit, "").otherwise(money), F.lit(sep), F.when(credit, money).otherwise(""))
    line = (F.when(layout == 0, F.concat(us, F.lit(',"'), text, F.lit('",'), F.when(
        credit, "").otherwise("-"), money))
        .when(layout == 1, F.concat(us, F.lit(";"), text, F.lit(";"), pair(d, ";")))
        .when(layout == 2, F.concat(us, F.lit("\t"), text, F.lit("\t"), F.when(credit, F.concat(
            F.lit("$"), money)).otherwise(F.concat(F.lit("($"), money, F.lit(")")))))
        .otherwise(F.concat(iso, F.lit("|"), text, F.lit("|"), pair(d, "|"))))
    body = rows.select(F.col("batch_id").alias("source_id"), "seq", line.alias("line"))
    heads = rows.select("batch_id", layout.cast("int").alias("n")).distinct().select(
        F.col("batch_id").alias("source_id"), F.lit(-1).cast("bigint").alias("seq"),
        F.get(_texts(LAYOUT_HEADERS), F.col("n")).alias("line"))
    return heads.unionByName(body)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, pages and conversation turns as (source_id, source, text), whole.

    Documents carry a strip with every kind of personal data, spelled from their id.
    """
    n = F.col("doc_id")
    pad = lambda mult, width: F.lpad(
        F.pmod(n * mult + 1234567, F.lit(10 ** width)).cast("string"), width, "0")
    strip = F.concat(
        F.lit("\nName on file. SSN 123-45-"), F.lpad((n % 9000 + 1000).cast("string"), 4, "0"),
        F.lit(" card 4111 1111 1111 "), pad(7919, 4),
        F.lit(" IBAN GB82WEST"), pad(104729, 7), pad(31, 7),
        F.lit("\nRouting number: "), pad(15485863, 9), F.lit("\nAccount no. "), pad(32452843, 10),
        F.lit("\nCall (212) 555-"), pad(13, 4), F.lit(" or mail user"), n.cast("string"),
        F.lit("@mail.example.com, 12"), (n % 10).cast("string"), F.lit(" Old Oak Street, Springfield"),
        F.lit("\nDOB: 0"), (n % 9 + 1).cast("string"), F.lit("/15/1980 from 10.0."),
        (n % 256).cast("string"), F.lit("."), (n % 100).cast("string"))
    docs = read(spark, folder, "documents").select(
        F.concat(F.lit("doc-"), n.cast("string")).alias("source_id"), F.lit("documents").alias("source"),
        F.concat("text", F.when(n % 3 == 0, strip).otherwise("")).alias("text"))
    pages = read(spark, folder, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("source_id"),
        F.lit("pages").alias("source"), F.col("html").alias("text"))
    turns = read(spark, folder, "conversations").select(
        F.concat(F.lit("turn-"), F.col("conv_id").cast("string"), F.lit("-"),
                 F.col("turn").cast("string")).alias("source_id"),
        F.lit("conversations").alias("source"), "text")
    return docs.unionByName(pages).unionByName(turns)
