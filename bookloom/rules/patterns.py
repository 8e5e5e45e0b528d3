"""Keyword-count rules of the second layer and amount tiers for broad vendors."""

# Fixed values, in rule order. A rule is a head line and an indented keyword line:
# id|account|name|type|direction|deductible|confidence shift|deduction limit|tax reference|note
TEXT = """
FUEL|6120|Auto & Fuel Expense|EXPENSE||Y|||Schedule C Line 9|
  GAS; FUEL; SHELL; EXXON; CHEVRON; BP OIL; SUNOCO; MARATHON; VALERO; CITGO; SPEEDWAY; PILOT; LOVES TRAVEL
MEALS|6150|Meals & Entertainment|EXPENSE||Y||0.50|IRC Section 274|Only 50% deductible — CPA verify business purpose
  RESTAURANT; DOORDASH; UBER EATS; GRUBHUB; MCDONALD; STARBUCKS; CHIPOTLE; CHICK-FIL-A; DARDEN; GRILL; KITCHEN; CAFE; PIZZA; SUSHI; STEAKHOUSE
AUTO_REPAIR|6125|Vehicle Repairs & Maintenance|EXPENSE||Y|||Schedule C Line 9|
  AUTO REPAIR; MIDAS; JIFFY LUBE; FIRESTONE; PEP BOYS; AUTOZONE; O'REILLY; NAPA AUTO; ADVANCE AUTO; TRANSMISSION; MECHANIC; BODY SHOP; DETAILING; CAR WASH
OFFICE|6350|Office Supplies|EXPENSE||Y|||Schedule C Line 22|
  STAPLES; OFFICE DEPOT; OFFICEMAX
SUBSCRIPTION|6400|Software & Subscriptions|EXPENSE||Y|-0.10||Schedule C Line 27|Verify this is a business subscription, not personal
  ANNUAL; MONTHLY; SUBSCRIPTION; RENEWAL; RECURRING; MEMBERSHIP
RENT|6100|Rent & Lease Expense|EXPENSE||Y|||Schedule C Line 20b|
  RENT; LEASE PAYMENT; PROPERTY MANAGEMENT; STORAGE; EXTRA SPACE; PUBLIC STORAGE; LIFE STORAGE
UTILITIES|6110|Utilities|EXPENSE||Y|||Schedule C Line 25|
  ELECTRIC; UTILITY; WATER BILL; GAS BILL; COMCAST; AT&T; VERIZON; T-MOBILE; SPECTRUM; DUKE ENERGY
ADVERTISING|6450|Advertising & Marketing|EXPENSE||Y|||Schedule C Line 8|
  FACEBOOK ADS; GOOGLE ADS; META ADS; INSTAGRAM; MAILCHIMP; CONSTANT CONTACT; VISTAPRINT; CANVA; MARKETING; ADVERTISING
PROFESSIONAL|6500|Professional Fees|EXPENSE||Y|||Schedule C Line 17|
  LAW OFFICE; ATTORNEY; LEGAL; ACCOUNTANT; CPA; BOOKKEEPING; CONSULTING; NOTARY
REVENUE|4000|Sales Revenue|REVENUE|CREDIT|Y||||Verify this is business revenue not a personal transfer
  ACH DEPOSIT; WIRE TRANSFER IN; ZELLE; PAYPAL TRANSFER; SQUARE DEPOSIT; STRIPE PAYOUT; VENMO
LOAN|2300|Loan Payment|LIABILITY||N||||Split principal vs interest — only interest deductible
  LOAN PAYMENT; SBA LOAN; LINE OF CREDIT; NOTE PAYMENT; EQUIPMENT FINANCING; MERCHANT ADVANCE
INSURANCE|6200|Insurance - General|EXPENSE||Y|||Schedule C Line 15|
  INSURANCE; LIABILITY; WORKERS COMP; GENERAL LIABILITY
TRAVEL|6140|Travel Expense|EXPENSE||Y|||Schedule C Line 24a|
  AIRLINE; DELTA; UNITED; SOUTHWEST; AMERICAN AIR; HOTEL; MARRIOTT; HILTON; AIRBNB; UBER; LYFT
SHIPPING|6360|Postage & Shipping|EXPENSE||Y|||Schedule C Line 18|
  USPS; UPS; FEDEX; DHL; POSTAGE; SHIPPING
LICENSES|6510|Licenses & Permits|EXPENSE||Y|||Schedule C Line 23|
  LICENSE; PERMIT; REGISTRATION; DMV; SECRETARY OF STATE
"""

# Base confidence, step per extra keyword, ceilings and floor.
BASE, STEP, SOFT_CAP, FLOOR, CEILING = 0.85, 0.03, 0.95, 0.50, 0.98

# alias|vendor, then vendor|upper bound|account|name|confidence|note.
VENDOR_ALIASES = """
AMAZON|AMAZON
AMZN|AMAZON
AMZN MKTP|AMAZON
AMAZON.COM|AMAZON
WALMART|WALMART
WAL-MART|WALMART
WM SUPERCENTER|WALMART
TARGET|TARGET
BEST BUY|BEST BUY
"""
VENDOR_TIERS = """
AMAZON|20|6350|Office Supplies|0.72|Amazon < $20 — likely supplies
AMAZON|100|6350|Office Supplies|0.68|Amazon $20-$100 — likely supplies, verify receipt
AMAZON|500|6410|Computer & Technology|0.60|Amazon $100-$500 — possibly tech, verify receipt
AMAZON|99999|6900|Miscellaneous Expense|0.40|Amazon > $500 — could be equipment, verify receipt
WALMART|30|6350|Office Supplies|0.70|Walmart < $30 — likely supplies
WALMART|200|6350|Office Supplies|0.60|Walmart $30-$200 — likely supplies, verify receipt
WALMART|99999|6900|Miscellaneous Expense|0.40|Walmart > $200 — verify receipt for category
TARGET|50|6350|Office Supplies|0.65|Target < $50 — likely supplies
TARGET|99999|6900|Miscellaneous Expense|0.40|Target > $50 — verify receipt
BEST BUY|200|6410|Computer & Technology|0.75|Best Buy < $200 — likely tech/accessories
BEST BUY|2500|6410|Computer & Technology|0.70|Best Buy $200-$2500 — computer/equipment
BEST BUY|99999|6410|Computer & Technology|0.55|Best Buy > $2500 — possible capex, verify
"""


def rules() -> list[dict]:
    lines = TEXT.strip().splitlines()
    out = []
    for ordinal, (head, words) in enumerate(zip(lines[::2], lines[1::2])):
        rid, account, name, kind, direction, ded, shift, limit, ref, note = head.split("|")
        out.append(dict(
            ordinal=ordinal, rule_id=rid, account=account, name=name, type=kind,
            direction=direction, deductible=ded == "Y", shift=float(shift or 0),
            limit=float(limit) if limit else None, ref=ref, note=note,
            words=words.strip().split("; ")))
    return out


def vendor_aliases() -> list[tuple[str, str]]:
    """(alias, vendor), longest alias first."""
    pairs = [tuple(x.split("|")) for x in VENDOR_ALIASES.strip().splitlines()]
    return sorted(pairs, key=lambda p: -len(p[0]))


def vendor_tiers() -> list[dict]:
    keys = ("vendor", "bound", "account", "name", "confidence", "note")
    rows = [dict(zip(keys, x.split("|"))) for x in VENDOR_TIERS.strip().splitlines()]
    return [dict(r, bound=int(r["bound"]), confidence=float(r["confidence"])) for r in rows]
