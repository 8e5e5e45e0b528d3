"""Bank noise, stop words and merchant aliases."""

# Words banks add to a description. The four groups are removed in
# this order, each hit becoming one space; words inside a group do not interact.
NOISE_WORDS_FIRST = "POS DEBIT CREDIT PURCHASE ACH WITHDRAWAL"
NOISE_CHECK = r"\bCHECK\s*#?\d*"
NOISE_WORDS_SECOND = ("WIRE ONLINE MOBILE RECURRING AUTOPAY EFT PAYMENT TRANSFER "
                      "ELECTRONIC PRE-AUTH PENDING")
NOISE_NUMBERS = [r"\b\d{2}/\d{2}\b", r"#\d+", r"\bCARD\s*\d{4}\b", r"\bXX+\d{4}\b"]
PUNCTUATION = r"[^\w\s&'-]"
STOP_WORDS = "THE OF AND FOR TO IN AT ON BY A AN".split()

# Merchant id|aliases, in listing order.
ALIASES = """
AMAZON|AMZN; AMZN MKTP; AMAZON.COM
AMAZON_PRIME|AMAZON PRIME; PRIME VIDEO
WALMART|WM SUPERCENTER; WAL-MART; WALMART.COM
MCDONALDS|MCDONALD'S; MCDONALDS
CHICK_FIL_A|CHICK FIL A; CHICK-FIL-A
SHELL|SHELL OIL; SHELL SERVICE
EXXON|EXXONMOBIL; EXXON MOBIL
SQUARE|SQ *; SQUARE; GOSQ.COM
SQUARE_DEPOSIT|SQUARE DEPOSIT; SQ *DEPOSIT
STRIPE|STRIPE
STRIPE_PAYOUT|STRIPE PAYOUT; STRIPE TRANSFER
PAYPAL|PP *; PAYPAL
PAYPAL_PAYOUT|PAYPAL TRANSFER; PAYPAL INST
CLOVER|CLOVER
CLOVER_DEPOSIT|CLOVER DEPOSIT
SHOPIFY|SHOPIFY
SHOPIFY_PAYOUT|SHOPIFY PAYOUT
TOAST|TOAST
TOAST_DEPOSIT|TOAST DEPOSIT
US_FOODS|US FOODS; USFOODS
SYSCO|SYSCO; SYSCO FOOD
RESTAURANT_DEPOT|RESTAURANT DEPOT; REST DEPOT
GORDON_FOOD|GORDON FOOD; GFS
PERFORMANCE_FOOD|PERFORMANCE FOOD
AUTOZONE|AUTOZONE; AUTO ZONE
NAPA|NAPA AUTO; NAPA
OREILLY_AUTO|O'REILLY; O'REILLY AUTO
ADVANCE_AUTO|ADVANCE AUTO
PEP_BOYS|PEP BOYS
OFFICE_DEPOT|OFFICE DEPOT; OFFICEMAX
STAPLES|STAPLES
GOOGLE|GOOGLE *
GOOGLE_ADS|GOOGLE ADS
FACEBOOK_ADS|FB ADS; FACEBOOK ADS; META ADS
QUICKBOOKS|INTUIT; QUICKBOOKS; QB ONLINE; QB
UBER_RIDE|UBER TRIP; UBER *TRIP
UBER_EATS|UBER EATS; UBEREATS
VERIZON|VZWRLSS; VERIZON
ATT|ATT*; AT&T
COMCAST|COMCAST; XFINITY
TMOBILE|T-MOBILE; TMOBILE
SPECTRUM|SPECTRUM
ADP|ADP PAYROLL; ADP
GUSTO|GUSTO; GUSTO PAYROLL
PAYCHEX|PAYCHEX
"""

# Prefixes the light cleaner strips one after the other.
LIGHT_PREFIXES = ["POS PURCHASE", "POS DEBIT", "DEBIT CARD", "ACH DEBIT", "ACH CREDIT",
                  "WIRE TRANSFER", "CHECK", "ATM"]
LIGHT_TAILS = [r"\s+#?\d{4,}$", r"(?i)\s+REF\s*#?\S+$", r"\s+[A-Z]{2}\s+\d{5}$"]


def aliases() -> list[dict]:
    """Aliases in match order: longest first, then listing order."""
    pairs = [(alias, canon) for canon, names in
             (x.split("|") for x in ALIASES.strip().splitlines()) for alias in names.split("; ")]
    rows = [dict(ordinal=i, alias=a, canonical=c) for i, (a, c) in enumerate(pairs)]
    return sorted(rows, key=lambda r: (-len(r["alias"]), r["ordinal"]))
