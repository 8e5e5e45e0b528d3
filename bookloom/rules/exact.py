"""Keyword rules of the first categorisation layer."""

# Fixed values. One line per account and note, in rule order:
# account|name|type|direction|deductible|tax reference|note :: keyword; keyword …
# A keyword listed twice keeps its first position and its last account.
TEXT = """
2100|Federal Income Tax Payable|LIABILITY||Y|| :: IRS EFTPS; EFTPS TAX
2110|State Income Tax Payable|LIABILITY||Y|| :: STATE TAX PAYMENT; FRANCHISE TAX
6010|Payroll Expense|EXPENSE||Y|| :: ADP PAYROLL; GUSTO PAYROLL
6010|Payroll Processing Fees|EXPENSE||Y|| :: GUSTO FEE
6010|Payroll Expense|EXPENSE||Y|| :: PAYCHEX; SQUARE PAYROLL
6300|Bank Service Charges|EXPENSE||Y|| :: MONTHLY SERVICE FEE; MONTHLY MAINTENANCE; OVERDRAFT FEE; WIRE TRANSFER FEE; NSF FEE; ATM FEE; FOREIGN TRANSACTION
6200|Insurance Expense|EXPENSE|DEBIT|Y|| :: PROGRESSIVE INSURANCE; GEICO; STATE FARM; ALLSTATE; LIBERTY MUTUAL; NATIONWIDE; USAA INSURANCE
6400|Software & Subscriptions|EXPENSE||Y|| :: QUICKBOOKS; INTUIT; ADOBE; MICROSOFT 365; MICROSOFT OFFICE; GOOGLE WORKSPACE; ZOOM.US; SLACK; DROPBOX; XERO; FRESHBOOKS; HUBSPOT
5100|Vehicle Purchases - COGS|COGS||Y|| :: MANHEIM; COPART; IAAI; ADESA
6310|CC Processing Fees|EXPENSE||Y|| :: SQUARE INC; STRIPE FEE; PAYPAL FEE; CLOVER FEE
4000|Sales Revenue|REVENUE|CREDIT|Y|| :: SQUARE DEPOSIT; SQ *DEPOSIT; STRIPE PAYOUT; STRIPE TRANSFER; SHOPIFY PAYOUT; PAYPAL TRANSFER; CLOVER DEPOSIT; TOAST DEPOSIT
4000|Sales Revenue|REVENUE|CREDIT|Y|| :: POS SALE; POS BATCH; DAILY SALES
4000|Sales Revenue|REVENUE|CREDIT|Y||Cash deposit — verify this is business revenue :: CASH DEPOSIT
4000|Sales Revenue|REVENUE|CREDIT|Y|| :: CUSTOMER PAYMENT; CUSTOMER PMT; CLIENT PAYMENT; INVOICE PAYMENT; INVOICE PMT
4200|Service Revenue|REVENUE|CREDIT|Y|| :: SERVICE PAYMENT
4300|Consulting Revenue|REVENUE|CREDIT|Y|| :: CONSULTING FEE
4000|Sales Revenue|REVENUE|CREDIT|Y|| :: ZELLE FROM; ZELLE PAYMENT; VENMO PAYMENT; VENMO CASHOUT
4000|Sales Revenue|REVENUE|CREDIT|Y||Check deposit — verify this is business revenue, not personal :: CHECK DEPOSIT
4000|Sales Revenue|REVENUE|CREDIT|Y|| :: WIRE TRANSFER IN; ACH DEPOSIT; ACH CREDIT
4500|Insurance Reimbursement|REVENUE|CREDIT|Y||Contra to insurance expense — nets against 6200, not operating revenue :: INSURANCE CLAIM
4500|Insurance Reimbursement|REVENUE|CREDIT|Y|| :: INSURANCE REIMBURSE; INSURANCE REFUND; INSURANCE PROCEEDS; CLAIM PAYMENT; CLAIM SETTLEMENT
4510|Vendor Refund|REVENUE|CREDIT|Y|| :: VENDOR REFUND
4510|Vendor Credit|REVENUE|CREDIT|Y|| :: VENDOR CREDIT; CREDIT MEMO
4510|Vendor Refund|REVENUE|CREDIT|Y|| :: RETURN CREDIT; REFUND FROM
5000|COGS - Supplies|COGS||Y|Schedule C Line 4| :: US FOODS; SYSCO; RESTAURANT DEPOT; PERFORMANCE FOOD; GORDON FOOD
5120|Parts & Materials - COGS|COGS||Y|Schedule C Line 4| :: AUTOZONE; NAPA AUTO; O'REILLY AUTO; ADVANCE AUTO; PEP BOYS
5000|Direct Labor - COGS|COGS||Y|Schedule C Line 4|Verify this is production/shop payroll not admin payroll :: PAYROLL RUN
5000|Direct Labor - COGS|COGS||Y|Schedule C Line 4| :: SHOP PAYROLL; DIRECT LABOR
6100|Rent & Lease Expense|EXPENSE||Y|| :: PUBLIC STORAGE; EXTRA SPACE; LIFE STORAGE; CUBESMART; UHAUL; U-HAUL; STORAGE UNIT
6800|Other Operating Expense|EXPENSE||Y|| :: CLEANING SERVICE; JANITORIAL; PEST CONTROL; TERMINIX; ORKIN; WASTE MANAGEMENT; REPUBLIC SERVICES
6110|Utilities|EXPENSE||Y|| :: XFINITY; COX COMM; CENTURYLINK; FRONTIER COMM
6360|Shipping & Postage|EXPENSE||Y|| :: USPS; FEDEX; UPS STORE; UPS.COM; DHL EXPRESS; STAMPS.COM; PIRATE SHIP
6500|Professional Services|EXPENSE||Y|| :: H&R BLOCK; TURBOTAX; CPA; BOOKKEEPER; TAX PREPARATION
6120|Vehicle - Fuel|EXPENSE||Y|| :: SHELL OIL; CHEVRON; BP PRODUCTS; EXXONMOBIL; MARATHON PETRO; CIRCLE K; 7-ELEVEN; PILOT TRAVEL; LOVES TRAVEL; WAWA; RACETRAC; SPEEDWAY; COSTCO GAS; SAMS CLUB FUEL
6450|Advertising & Marketing|EXPENSE||Y|| :: FACEBOOK ADS; META PLATFORMS; GOOGLE ADS; YELP ADVERTISING; INDEED; VISTAPRINT; CONSTANT CONTACT; MAILCHIMP
6000|Salaries & Wages|EXPENSE||Y|| :: ADP PAYROLL; GUSTO; PAYCHEX; SQUARE PAYROLL; HEARTLAND PAYROLL
6020|Contract Labor|EXPENSE||Y|| :: UPWORK; FIVERR; FREELANCER
1020|Transfer - Savings|ASSET||Y|| :: TRANSFER TO SAVINGS
1000|Transfer - Operating|ASSET||Y|| :: TRANSFER FROM SAVINGS
1000|Internal Transfer|ASSET||Y||Verify this is an internal transfer, not a payment :: ONLINE TRANSFER
2120|Sales Tax Payable|LIABILITY||Y|| :: SALES TAX PAYMENT; SALES TAX PMT
3100|Owner's Draw|EQUITY||N||NOT TAX DEDUCTIBLE — reduces equity not income :: OWNER DRAW; OWNER DISTRIBUTION
3200|Owner's Contributions|EQUITY||Y|| :: OWNER CONTRIBUTION
3100|Owner's Draw|EQUITY||N||NOT TAX DEDUCTIBLE — reduces equity not income :: MEMBER DISTRIBUTION
2300|Loan Payable|LIABILITY||N||Split principal vs interest — only interest deductible :: LOAN PAYMENT
2300|SBA Loan Payable|LIABILITY||N||Split principal vs interest — only interest deductible :: SBA LOAN
2300|Loan Proceeds|LIABILITY||Y|| :: LOAN PROCEED
"""

CONFIDENCE = 0.99


def rules() -> list[dict]:
    """Rules in match order: longest keyword first, then listing order."""
    by_keyword: dict[str, dict] = {}
    for line in TEXT.strip().splitlines():
        head, _, words = line.partition(" :: ")
        account, name, kind, direction, deductible, ref, note = head.split("|")
        for word in words.split("; "):
            place = by_keyword.get(word, {}).get("ordinal", len(by_keyword))
            by_keyword[word] = dict(
                ordinal=place, keyword=word, account=account, name=name, type=kind,
                direction=direction, deductible=deductible == "Y", ref=ref, note=note)
    return sorted(by_keyword.values(), key=lambda r: (-len(r["keyword"]), r["ordinal"]))
