"""Keyword buckets of the simple profit-and-loss path."""

# category|subcategory|keywords, in scan order. Transfers are tried first.
TEXT = """
transfers|internal|transfer; xfer; savings; between accounts; internal transfer; owner draw; distribution; owner contribution
revenue|sales|payment; deposit; square; venmo; zelle in; paypal; stripe; cash deposit; pos sale; pos credit; shopify; clover; toast; invoice payment; client payment
revenue|refund_received|refund received; reversal credit; credit adjustment; chargeback reversal
refund_out|refunds_issued|refund issued; customer refund; return credit; chargeback; dispute
cogs|inventory|sysco; restaurant depot; us foods; gfs; supplies; wholesale; parts; autozone; napa; oreilly; advance auto; ingredient; raw material; food supply; packaging; baker; flour; produce; meat; dairy
cogs|direct_labor|payroll; gusto; adp; paychex; direct labor; wage; salary; contractor pay; hourly pay
opex|rent|rent; lease; property management; commercial lease
opex|utilities|electric; gas bill; water bill; utility; con ed; pge; duke energy; sewer; garbage; waste management; comcast; att; verizon; internet; phone bill; t-mobile
opex|insurance|insurance; geico; progressive; state farm; allstate; liability; workers comp; health insurance; dental; general liability
opex|marketing|facebook ads; google ads; instagram; marketing; advertising; promo; yelp; print ad; flyer; social media; mailchimp; constant contact
opex|software|quickbooks; square subscription; subscription; saas; software; intuit; xero; freshbooks; hubspot; zoom; microsoft; google workspace; adobe; shopify subscription
opex|bank_fees|service charge; monthly fee; overdraft; wire fee; nsf fee; account fee; maintenance fee; atm fee; foreign transaction
opex|vehicle|fuel; gas station; shell; chevron; bp; exxon; car wash; oil change; vehicle maintenance; tire
opex|office|office depot; staples; amazon business; supplies; cleaning; janitorial
opex|meals_entertainment|restaurant; doordash; uber eats; grubhub; catering; client dinner; business meal
opex|professional_services|accountant; cpa; attorney; lawyer; legal; consultant; bookkeeper; tax prep
debt|loan_payment|loan payment; financing; interest charge; sba loan; line of credit; credit line; note payment; equipment financing; merchant advance
"""

# Expense subcategories with a bucket of their own.
OPEX_BUCKETS = ["rent", "utilities", "insurance", "marketing", "software", "bank_fees"]
# The rest of the known subcategories, which share the other bucket;
# anything else (and other_opex itself) also counts as uncategorised.
OPEX_KNOWN = ["vehicle", "office", "meals_entertainment", "professional_services"]

# industry|metric|level=value…
BENCHMARKS = """
general|gross_margin_pct|low=30 healthy=45 excellent=60
general|net_margin_pct|struggling=3 average=8 healthy=15 excellent=20
general|rent_pct_of_revenue|ideal=8 warning=12 critical=15
general|cogs_pct|low=25 healthy=40 high=60
bakery|gross_margin_pct|low=50 healthy=60 excellent=70
bakery|net_margin_pct|struggling=5 average=10 healthy=15 excellent=20
bakery|rent_pct_of_revenue|ideal=8 warning=12 critical=15
bakery|cogs_pct|low=25 healthy=35 high=45
mechanic|gross_margin_pct|low=45 healthy=55 excellent=65
mechanic|net_margin_pct|struggling=5 average=12 healthy=18 excellent=25
mechanic|rent_pct_of_revenue|ideal=6 warning=10 critical=14
mechanic|cogs_pct|low=30 healthy=40 high=55
"""
INDUSTRY_NAMES = {"general": "General Business", "bakery": "Bakery",
                  "mechanic": "Auto Repair Shop"}


def rules() -> list[dict]:
    """Keywords in match order."""
    rows = [x.split("|") for x in TEXT.strip().splitlines()]
    flat = [(c, s, w) for c, s, words in rows for w in words.split("; ")]
    return [dict(ordinal=i, keyword=w,
                 category="transfer" if c == "transfers" else c, subcategory=s)
            for i, (c, s, w) in enumerate(flat)]


def benchmarks() -> dict[str, dict[str, dict[str, int]]]:
    out: dict = {}
    for line in BENCHMARKS.strip().splitlines():
        industry, metric, levels = line.split("|")
        out.setdefault(industry, {})[metric] = {
            k: int(v) for k, v in (x.split("=") for x in levels.split())}
    return out
