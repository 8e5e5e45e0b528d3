"""Sensitive-data patterns and their replacement tokens."""

# code|label|confidence|replacement, then the pattern, in scan order.
# Patterns ignore case.
TEXT = r"""
SSN|Social Security Number|0.97|██ SSN-REDACTED ██
  \b(?!000|666|9\d{2})\d{3}[-.\s]?(?!00)\d{2}[-.\s]?(?!0000)\d{4}\b
CREDIT_CARD|Credit Card Number|0.92|██ CARD-XXXX{last4} ██
  \b(?:4[0-9]{12}(?:[0-9]{3})?|(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|(?:\d[ -]?){13,19})\b
IBAN|IBAN|0.95|██ IBAN-REDACTED ██
  \b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]?){0,16}\b
ROUTING_NUMBER|Routing Number|0.78|██ ROUTING-REDACTED ██
  \b(?:routing(?:\s+(?:number|#|no\.?))?[\s:]*)?[0-9]{9}\b
ACCOUNT_NUMBER|Account Number|0.72|██ ACCOUNT-XXXX{last4} ██
  \b(?:account(?:\s+(?:number|#|no\.?))?[\s:]*)?[0-9]{8,17}\b
PHONE|Phone Number|0.95|██ PHONE-REDACTED ██
  \b(?:\+?1[-.\s]?)?(?:\(?[2-9][0-9]{2}\)?[-.\s]?)[2-9][0-9]{2}[-.\s]?[0-9]{4}\b
EMAIL|Email Address|0.99|██ EMAIL-REDACTED ██
  \b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b
ADDRESS|Street Address|0.87|██ ADDRESS-REDACTED ██
  \b\d{1,5}\s+(?:[A-Z][a-z]+\s+){1,4}(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Place|Pl|Way|Circle|Cir)(?:\.|\s|,|$)
DATE_OF_BIRTH|Date of Birth|0.92|██ DOB-REDACTED ██
  \b(?:DOB|Date\s+of\s+Birth|Born|Birth\s+Date)[\s:]+\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b
IP_ADDRESS|IP Address|0.99|██ IP-REDACTED ██
  \b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b
"""
CUSTOM = dict(code="CUSTOM", label="Custom Term", confidence=1.0, token="██ REDACTED ██")
# A word boundary between ASCII word characters and all others.
BOUNDARY = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
CONTEXT = 30
EXAMPLES_PER_TYPE = 3

# The social-security pattern without look-ahead, for SQL engines that lack it.
SSN_NO_LOOKAHEAD = (r"\b(?:0(?:0[1-9]|[1-9]\d)|[1-57-8]\d{2}|6(?:[0-57-9]\d|6[0-57-9]))[-.\s]?"
                    r"(?:0[1-9]|[1-9]\d)[-.\s]?"
                    r"(?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})\b")

# Document type|weight|identifiers, in scoring order.
SIGNATURES = """
bank_statement|1.0|account number; routing; statement period; beginning balance; ending balance; checking; savings account; account summary; deposits and credits; withdrawals and debits; daily balance
credit_card_statement|1.0|credit card; minimum payment; credit limit; payment due date; new balance; previous balance; annual percentage rate; apr; credit line; reward points; cash advance
receipt|0.8|receipt; subtotal; tax; total; thank you; change due; payment method; visa; mastercard; item; qty
invoice|1.0|invoice number; invoice #; bill to; due date; net 30; net 60; remit to; purchase order; terms; ship to; invoice date
"""
UNKNOWN_BELOW = 0.15
DATED_AMOUNT = r"\d{1,2}[/-]\d{1,2}[/-]?\d{0,4}\s+.+\s+\$?[\d,]+\.\d{2}"
DATED_AMOUNT_LINES, DATED_AMOUNT_CONFIDENCE = 5, 0.50
DATED_AMOUNT_EVIDENCE = "heuristic: dated transaction rows"


def detectors() -> list[dict]:
    lines = TEXT.strip().splitlines()
    out = []
    for ordinal, (head, pattern) in enumerate(zip(lines[::2], lines[1::2])):
        code, label, confidence, token = head.split("|")
        out.append(dict(ordinal=ordinal, code=code, label=label, confidence=float(confidence),
                        token=token, pattern=pattern.strip()))
    return out


def signatures() -> list[dict]:
    rows = [x.split("|") for x in SIGNATURES.strip().splitlines()]
    return [dict(type=t, weight=float(w), words=ids.split("; ")) for t, w, ids in rows]
