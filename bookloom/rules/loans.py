"""Loan keywords, types, rates and the amounts written into descriptions."""

# Fixed values.
KEYWORDS = ["LOAN", "SBA", "NOTE PAYMENT", "LINE OF CREDIT", "LOC PAYMENT",
            "EQUIPMENT FINANCING", "MERCHANT ADVANCE", "BUSINESS LOAN", "INSTALLMENT",
            "FINANCE CHARGE"]

# type|substrings that decide it, in order; anything else is GENERIC.
TYPES = """
SBA|SBA; PPP; EIDL
EQUIPMENT|EQUIPMENT; EQUIP
LOC|LINE OF CREDIT; LOC; REVOLVING
MERCHANT|MERCHANT; ADVANCE
"""

# Annual rate by type. Estimates take half of it, in cents, within bounds.
RATES = {"SBA": "0.065", "EQUIPMENT": "0.080", "LOC": "0.100", "MERCHANT": "0.150",
         "GENERIC": "0.080"}
SHARE_MIN, SHARE_MAX = "0.05", "0.45"

# Fixed values.
FEE_PATTERN = r"(?:FEE|LATE\s*FEE|SERVICE\s*CHARGE|ORIGINATION)\s*[\$:]?\s*(\d+\.?\d*)"
INTEREST_PATTERN = (r"(?:INTEREST|INT\s*CHARGE|INT\s*PMT|FINANCE\s*CHARGE)"
                    r"\s*[\$:]?\s*(\d+\.?\d*)")
AMOUNT_TOLERANCE = "0.50"


def types() -> list[tuple[str, list[str]]]:
    return [(t, words.split("; ")) for t, words in
            (x.split("|") for x in TYPES.strip().splitlines())]


def estimates() -> dict[str, tuple[str, str, str]]:
    """type -> (interest share, share as a whole percent, rate as a one-digit percent)."""
    from decimal import ROUND_HALF_UP, Decimal

    out = {}
    for kind, rate in RATES.items():
        share = (Decimal(rate) / 2).quantize(Decimal("0.01"), ROUND_HALF_UP)
        share = max(Decimal(SHARE_MIN), min(Decimal(SHARE_MAX), share))
        out[kind] = (str(share), f"{share * 100:.0f}", f"{Decimal(rate) * 100:.1f}")
    return out
