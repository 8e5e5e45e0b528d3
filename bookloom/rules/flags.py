"""Review flags: words, bounds, messages and severities."""

# flag|severity|message, in the order the engine raises them.
TEXT = """
BALANCE_MISMATCH|CRITICAL|Bank statement math does not reconcile. Possible missing transactions or extraction error.
MEALS_OVER_75|MEDIUM|IRS requires documentation for meals > $75. CPA needs: who, business purpose, where, when.
LARGE_CASH_WITHDRAWAL|MEDIUM|Cash > $500 requires business purpose documentation.
CASH_NEAR_10K|HIGH|Transaction near $10,000 threshold. Bank may file CTR. Ensure proper documentation.
ROUND_NUMBER_SUSPICIOUS|LOW|Round number expense may indicate estimate vs actual receipt.
PERSONAL_EXPENSE_MIXED|MEDIUM|Potential personal expense in business account. IRS disallows personal expenses as business deductions.
POSSIBLE_CAPITAL_EXPENSE|HIGH|Purchase > $2,500 may need capitalization vs expensing. CPA to apply Section 179 or Bonus Depreciation.
LOAN_PAYMENT_DETECTED|MEDIUM|Loan payments must be split: principal reduces liability (not deductible), interest is deductible.
AMBIGUOUS_VENDOR|MEDIUM|Vendor sells across many categories. Receipt needed.
DUPLICATE_TRANSACTION|HIGH|Potential duplicate — same date + amount + merchant within 48h.
LOW_CONFIDENCE_CATEGORY|MEDIUM|System could not reliably categorize. CPA review required.
"""

# Fixed values.
PERSONAL = ["NETFLIX", "SPOTIFY", "HULU", "DISNEY+", "HBO", "GROCERY", "KROGER", "PUBLIX",
            "WHOLE FOODS", "NORDSTROM", "GAP", "OLD NAVY", "ZARA", "PLANET FITNESS", "GYM"]
BROAD_VENDORS = ["AMAZON", "WALMART", "TARGET", "HOME DEPOT", "COSTCO"]
ROUND_AMOUNTS = ["500", "1000", "2500", "5000", "10000"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]

# Severities the dashboard shows for flags the engine does not know.
# Any other flag is LOW.
DASHBOARD_EXTRA = {"INFLOW_UNCLASSIFIED": "MEDIUM", "BELOW_THRESHOLD": "MEDIUM",
                   "LOAN_NEEDS_SPLIT": "HIGH", "CAPEX_DETECTED": "HIGH",
                   "LARGE_EXPENSE_REVIEW": "MEDIUM"}


def rules() -> list[dict]:
    return [dict(zip(("flag", "severity", "message"), x.split("|")))
            for x in TEXT.strip().splitlines()]
