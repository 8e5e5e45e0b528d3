"""Money-flow rules: what an inflow or outflow is before it is categorised."""

# Fixed values. type|confidence|evidence, then the patterns, in rule order; the
# first rule with a hit decides.
INFLOW = r"""
TRANSFER|0.92|Description matches inter-account transfer pattern
  TRANSFER\s*(FROM|TO)\s*(SAVINGS|CHECKING|ACCOUNT)
  ONLINE\s*TRANSFER
  INTERNAL\s*TRANSFER
  XFER\s*(FROM|TO)
  MOBILE\s*TRANSFER
  BETWEEN\s*ACCOUNTS
FINANCING|0.90|Description matches financing/loan pattern — NOT revenue
  LOAN\s*PROCEED
  LINE\s*OF\s*CREDIT
  SBA\s*(LOAN|EIDL|PPP)
  CREDIT\s*LINE\s*DRAW
  MERCHANT\s*ADVANCE
  EQUIPMENT\s*FINANCING
  BUSINESS\s*LOAN
EQUITY|0.88|Description matches owner/equity contribution pattern — NOT revenue
  OWNER\s*(CONTRIBUTION|INVEST|DEPOSIT|CAPITAL)
  MEMBER\s*CONTRIBUTION
  CAPITAL\s*INJECTION
  PERSONAL\s*DEPOSIT
  SHAREHOLDER\s*LOAN
REFUND|0.85|Description matches refund/reversal pattern
  REFUND
  CREDIT\s*MEMO
  REVERSAL
  TAX\s*REFUND
  INSURANCE\s*REFUND
  VENDOR\s*CREDIT
  RETURN\s*CREDIT
  CHARGEBACK\s*CREDIT
CONTRA_REV|0.87|Customer return/chargeback — reduces gross revenue
  CUSTOMER\s*RETURN
  SALES\s*RETURN
  CHARGEBACK
  DISPUTE\s*CREDIT
REVENUE|0.95|Payment processor payout — deterministic revenue deposit
  SQUARE\s*(DEPOSIT|PAYOUT)
  SQ\s*\*?\s*(DEPOSIT|PAYOUT)
  STRIPE\s*(PAYOUT|TRANSFER|DEPOSIT)
  PAYPAL\s*(TRANSFER|DEPOSIT|INST)
  CLOVER\s*(DEPOSIT|PAYOUT)
  SHOPIFY\s*(PAYOUT|DEPOSIT)
  TOAST\s*(DEPOSIT|PAYOUT)
REVENUE|0.85|Customer receipt or deposit — likely business revenue
  DEPOSIT\s*-?\s*(CUSTOMER|CLIENT|INVOICE|PAYMENT)
  CUSTOMER\s*(PAYMENT|PMT|DEPOSIT)
  CLIENT\s*(PAYMENT|PMT|DEPOSIT)
  INVOICE\s*(PAYMENT|PMT)
  ZELLE\s*(FROM|PAYMENT|RECEIVED|PMT)
  VENMO\s*(PAYMENT|CASHOUT|FROM)
  WIRE\s*(TRANSFER\s*)?IN
  ACH\s*(DEPOSIT|CREDIT)\s*-?\s*\w
  CHECK\s*DEPOSIT
  POS\s*(SALE|BATCH|DEPOSIT)
  DAILY\s*SALES
  CASH\s*DEPOSIT
  SERVICE\s*(PAYMENT|PMT|FEE)
  CONSULTING\s*(FEE|PAYMENT|PMT)
  PAYMENT\s*RECEIVED
  RECEIVED\s*FROM
  MOBILE\s*DEPOSIT
  REMOTE\s*DEPOSIT
REFUND|0.90|Insurance reimbursement/claim payment — not operating revenue
  INSURANCE\s*(REIMBURSE|REFUND|CLAIM|PAYMENT|PMT|PROCEEDS)
  CLAIM\s*(PAYMENT|PROCEEDS|SETTLEMENT)
  (GEICO|STATE\s*FARM|PROGRESSIVE|ALLSTATE|LIBERTY|NATIONWIDE|USAA)\s*(CLAIM|PMT|PAYMENT)
EQUITY|0.92|Owner draw/distribution — equity reduction, NOT P&L expense
  OWNER\s*(DRAW|DISTRIBUTION|DIST|WITHDRAWAL)
  MEMBER\s*DISTRIBUTION
  SHAREHOLDER\s*DISTRIBUTION
  PERSONAL\s*(TRANSFER|WITHDRAWAL)
"""

# The same for debits.
OUTFLOW = r"""
TRANSFER|0.92|Inter-account transfer — balance sheet only, not P&L
  TRANSFER\s*(TO|FROM)\s*(SAVINGS|CHECKING|ACCOUNT)
  ONLINE\s*TRANSFER
  INTERNAL\s*TRANSFER
  XFER\s*(TO|FROM)
  MOBILE\s*TRANSFER
  BETWEEN\s*ACCOUNTS
EQUITY|0.92|Owner draw/distribution — equity reduction, NOT P&L expense
  OWNER\s*(DRAW|DISTRIBUTION|DIST|WITHDRAWAL)
  MEMBER\s*DISTRIBUTION
  SHAREHOLDER\s*DISTRIBUTION
  PERSONAL\s*(TRANSFER|WITHDRAWAL)
  ATM\s*WITHDRAWAL
  CASH\s*WITHDRAWAL
TAX_LIABILITY|0.90|Sales tax payment — liability reduction, not operating expense
  SALES\s*TAX\s*(PAYMENT|PMT)
  STATE\s*TAX.*SALES
"""

# The outcomes when no rule fires, as confidence|evidence.
GENERIC_DEPOSIT = (0.40, "Generic deposit — source unclear, could be revenue or transfer")
LARGE_ROUND = (0.30, "Large round deposit — may be loan proceeds, owner contribution, or revenue")
NO_PATTERN = (0.20, "No matching inflow pattern — human review required before posting as revenue")
PLAIN_OUTFLOW = (1.0, "Standard business outflow")
REVIEW_BELOW = 0.85


def parse(text: str) -> list[dict]:
    out: list[dict] = []
    for line in text.strip().splitlines():
        if line.startswith("  "):
            out[-1]["patterns"].append(line.strip())
        else:
            kind, confidence, evidence = line.split("|")
            out.append(dict(type=kind, confidence=float(confidence), evidence=evidence, patterns=[]))
    return out


def inflow() -> list[dict]:
    return parse(INFLOW)


def outflow() -> list[dict]:
    return parse(OUTFLOW)
