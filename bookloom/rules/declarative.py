"""The declarative rule table: direction, any-of keywords, target and review bound."""

# id|direction|account|category|subcategory|confidence|review from amount|
# deductible share|flag|tax line, then the keywords, in listing order.
TEXT = """
REV_STRIPE_PAYOUT|CREDIT|4000|revenue|card_processor|0.92|5000.00|||
  STRIPE PAYOUT; STRIPE TRANSFER
REV_SQUARE_PAYOUT|CREDIT|4000|revenue|card_processor|0.91|5000.00|||
  SQUARE PAYOUT; SQ PAYOUT; SQUARE INC
REV_PAYPAL|CREDIT|4000|revenue|card_processor|0.88|3000.00|||
  PAYPAL TRANSFER; PAYPAL INST
COGS_INVENTORY_VENDOR|DEBIT|5000|cogs|inventory|0.95||||36
  SYSCO; RESTAURANT DEPOT; US FOODS; GFS; WHOLESALE
COGS_PAYROLL|DEBIT|5100|cogs|direct_labor|0.90|10000.00|||26
  PAYROLL; GUSTO; ADP; PAYCHEX
OPEX_RENT|DEBIT|6100|opex|rent|0.93||||20b
  RENT; LEASE PAYMENT; PROPERTY MGMT
OPEX_INSURANCE|DEBIT|6300|opex|insurance|0.92||||15
  INSURANCE; GEICO; PROGRESSIVE; STATE FARM; ALLSTATE; WORKERS COMP
OPEX_UTILITIES|DEBIT|6200|opex|utilities|0.90||||25
  ELECTRIC; GAS BILL; WATER BILL; UTILITY; INTERNET; COMCAST; ATT; VERIZON
OPEX_MARKETING|DEBIT|6400|opex|marketing|0.91||||8
  FACEBOOK ADS; GOOGLE ADS; INSTAGRAM; MARKETING; ADVERTISING; YELP
OPEX_SOFTWARE|DEBIT|6500|opex|software|0.88||||18
  QUICKBOOKS; SUBSCRIPTION; SAAS; SOFTWARE; ZOOM; MICROSOFT; ADOBE; GOOGLE WORKSPACE
OPEX_BANK_FEES|DEBIT|6600|opex|bank_fees|0.95||||27a
  SERVICE CHARGE; MONTHLY FEE; OVERDRAFT; WIRE FEE; NSF FEE; ATM FEE
OPEX_VEHICLE|DEBIT|6150|opex|vehicle|0.85|||VEHICLE_EXPENSE_METHOD|9
  FUEL; GAS STATION; SHELL; CHEVRON; BP; EXXON; CAR WASH; OIL CHANGE
OPEX_MEALS|DEBIT|6350|opex|meals_entertainment|0.82||0.50||24b
  RESTAURANT; DOORDASH; UBER EATS; GRUBHUB; CATERING; BUSINESS MEAL
OPEX_PROFESSIONAL|DEBIT|6450|opex|professional_services|0.90||||17
  ACCOUNTANT; CPA; ATTORNEY; LAWYER; LEGAL; CONSULTANT; BOOKKEEPER; TAX PREP
DEBT_LOAN_PAYMENT|DEBIT|6700|debt|loan_payment|0.88|||LOAN_NEEDS_SPLIT|16b
  LOAN PAYMENT; SBA LOAN; LINE OF CREDIT; NOTE PAYMENT; EQUIPMENT FINANCING
XFER_INTERNAL|BOTH|0000|transfer|internal|0.85||||
  TRANSFER; XFER; BETWEEN ACCOUNTS; INTERNAL TRANSFER
XFER_OWNER_DRAW|DEBIT|3200|transfer|owner_draw|0.90||||
  OWNER DRAW; DISTRIBUTION; OWNER WITHDRAWAL
XFER_OWNER_CONTRIB|CREDIT|3100|transfer|owner_contribution|0.90||||
  OWNER CONTRIBUTION; CAPITAL CONTRIBUTION; SHAREHOLDER LOAN
"""

# Tokens the table's text normalisation drops.
NOISE_TOKENS = "POS DBT ACH ONLINE WEB PAYMENT DEBIT PURCHASE CARD VISA MASTERCARD".split()
FULL_THRESHOLD, QUICK_THRESHOLD = 0.70, 0.90


def rules() -> list[dict]:
    """Rules in match order: most confident first, then listing order."""
    lines = TEXT.strip().splitlines()
    out = []
    for ordinal, (head, words) in enumerate(zip(lines[::2], lines[1::2])):
        rid, side, account, cat, sub, conf, review, share, flag, tax = head.split("|")
        out.append(dict(ordinal=ordinal, rule_id=rid, direction=side, account=account,
                        category=cat, subcategory=sub, confidence=float(conf),
                        review_from=review, deductible_pct=share or "1.00", flag=flag,
                        tax_line=tax, words=words.strip().split("; ")))
    return sorted(out, key=lambda r: (-r["confidence"], r["ordinal"]))
