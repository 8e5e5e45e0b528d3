"""Chart of accounts and the tax-form lines it feeds."""

# code|name|tax line|deductible, under type/normal-balance headings.
TEXT = """
ASSET DEBIT
1000|Checking Account - Operating
1010|Checking Account - Secondary
1020|Savings Account
1030|Petty Cash
1100|Accounts Receivable
1200|Inventory - Vehicles Held for Sale
1201|Inventory - Parts & Materials
1300|Prepaid Insurance
1310|Prepaid Expenses - Other
1500|Vehicles & Equipment
1520|Office Equipment
1600|Security Deposits
ASSET CREDIT
1510|Accum Depreciation - Vehicles
1530|Accum Depreciation - Equipment
LIABILITY CREDIT
2000|Accounts Payable
2100|Federal Income Tax Payable
2110|State Income Tax Payable
2120|Sales Tax Payable
2130|Payroll Tax Payable
2200|Credit Card Payable
2300|Short-Term Loans Payable
2400|Long-Term Loans Payable
2500|Deferred Revenue
EQUITY CREDIT
3000|Owner's Equity / Retained Earnings
3200|Owner's Contributions
3900|Current Year Net Income
EQUITY DEBIT
3100|Owner's Draw / Distributions
REVENUE CREDIT
4000|Sales Revenue - General|Line 1
4100|Vehicle Sales Revenue|Line 1
4200|Service Revenue|Line 1
4300|Consulting Revenue|Line 1
4500|Insurance Reimbursements|Line 6
4510|Vendor Refunds & Credits|Line 6
4520|Other Reimbursements|Line 6
4900|Other Income / Miscellaneous|Line 6
COGS DEBIT
5000|COGS - General|Line 4|Y
5100|Vehicle Purchase Cost|Line 4|Y
5110|Vehicle Acquisition Fees|Line 4|Y
5120|Vehicle Repair Costs - COGS|Line 4|Y
5130|Vehicle Detailing & Prep - COGS|Line 4|Y
5140|Title & Registration Fees - COGS|Line 4|Y
EXPENSE DEBIT
6000|Salaries & Wages|Line 26|Y
6010|Payroll Processing Fees|Line 27|Y
6020|Contract Labor / 1099 Workers|Line 11|Y
6100|Rent & Lease Expense|Line 20b|Y
6110|Utilities|Line 25|Y
6120|Auto & Fuel Expense|Line 9|Y
6125|Vehicle Repairs - Operating|Line 9|Y
6130|Vehicle Insurance|Line 15|Y
6140|Travel Expense|Line 24a|Y
6150|Meals & Entertainment|Line 24b|Y
6200|Insurance - General Business|Line 15|Y
6210|Health Insurance|Line 14|Y
6300|Bank Service Charges & Fees|Line 27|Y
6310|Credit Card Processing Fees|Line 10|Y
6350|Office Supplies|Line 22|Y
6360|Postage & Shipping|Line 18|Y
6400|Software & Subscriptions|Line 27|Y
6410|Computer & Technology|Line 27|Y
6450|Advertising & Marketing|Line 8|Y
6500|Professional Fees (Legal, CPA)|Line 17|Y
6510|Licenses & Permits|Line 23|Y
6600|Depreciation Expense|Line 13|Y
6700|Interest Expense|Line 16|Y
6800|Bad Debt Expense|Line 27|Y
6900|Miscellaneous Expense|Line 27|Y
9000|Suspense / Unclassified
"""

# Tax-form line|account codes, in form order.
TAX_LINES = """
Line 1  - Gross Receipts|4000 4100 4200 4300
Line 4  - COGS|5000 5100 5110 5120 5130 5140
Line 6  - Other Income|4500 4510 4520 4900
Line 8  - Advertising|6450
Line 9  - Car & Truck|6120 6125
Line 10 - Commissions|6310
Line 11 - Contract Labor|6020
Line 13 - Depreciation|6600
Line 14 - Employee Benefits|6210
Line 15 - Insurance|6130 6200
Line 16 - Interest|6700
Line 17 - Legal & Professional|6500
Line 18 - Shipping & Postage|6360
Line 20 - Rent/Lease|6100
Line 22 - Supplies|6350
Line 23 - Taxes & Licenses|6510
Line 24a - Travel|6140
Line 24b - Meals (50%)|6150
Line 25 - Utilities|6110
Line 26 - Wages|6000
Line 27 - Other Expenses|6010 6300 6400 6410 6800 6900
"""
INCOME_LINES = ("Line 1  - Gross Receipts", "Line 4  - COGS", "Line 6  - Other Income")

# Accounts summed as cost of goods, and their direct-material,
# subcontractor subsets.
COGS_CODES = ["5000", "5100", "5110", "5120", "5130", "5140"]
MATERIAL_CODES = ["5110", "5120"]
SUBCONTRACT_CODES = ["5130"]


def chart() -> list[dict]:
    out, kind, side = [], "", ""
    for line in TEXT.strip().splitlines():
        if "|" not in line:
            kind, side = line.split()
            continue
        code, name, tax_line, ded = (line.split("|") + ["", ""])[:4]
        out.append(dict(code=code, name=name, type=kind, normal_balance=side,
                        tax_line=tax_line, deductible=ded == "Y"))
    return sorted(out, key=lambda a: a["code"])


def tax_lines() -> list[dict]:
    rows = [x.split("|") for x in TAX_LINES.strip().splitlines()]
    return [dict(ordinal=i, line=line, code=code)
            for i, (line, codes) in enumerate(rows) for code in codes.split()]
