"""Transactions with the account they are known to belong to."""

#: description | direction | amount | account
ROWS = [x.split("|") for x in """
STRIPE PAYOUT 12345|CREDIT|1250.00|4000
SQUARE DEPOSIT 03/10|CREDIT|980.00|4000
ACH DEPOSIT - CLIENT PAYMENT|CREDIT|2200.00|4000
WIRE TRANSFER IN FROM CUSTOMER|CREDIT|4800.00|4000
CHECK DEPOSIT #4451|CREDIT|750.00|4000
VENMO PAYMENT FROM JANE|CREDIT|120.00|4000
INSURANCE CLAIM PAYMENT GEICO|CREDIT|600.00|4500
VENDOR REFUND FROM STAPLES|CREDIT|85.00|4510
EMPLOYEE REIMBURSEMENT Q2|CREDIT|250.00|4520
TRANSFER FROM SAVINGS ACCOUNT|CREDIT|1500.00|1000
SBA LOAN PROCEED DEPOSIT|CREDIT|15000.00|2300
OWNER CONTRIBUTION DEPOSIT|CREDIT|5000.00|3200
SHELL OIL 1234|DEBIT|95.00|6120
CHEVRON #9901|DEBIT|70.00|6120
AUTOZONE PARTS|DEBIT|310.00|5120
NAPA AUTO PARTS|DEBIT|180.00|5120
US FOODS INVOICE|DEBIT|1200.00|5000
SYSCO FOODS ORDER|DEBIT|980.00|5000
COPART VEHICLE PURCHASE|DEBIT|4500.00|5100
MONTHLY SERVICE FEE|DEBIT|12.00|6300
OVERDRAFT FEE|DEBIT|35.00|6300
QUICKBOOKS SUBSCRIPTION|DEBIT|55.00|6400
ADOBE CREATIVE CLOUD|DEBIT|29.99|6400
FACEBOOK ADS MARCH|DEBIT|210.00|6450
GOOGLE ADS CAMPAIGN|DEBIT|175.00|6450
COMCAST BUSINESS INTERNET|DEBIT|132.00|6110
AT&T BUSINESS WIRELESS|DEBIT|165.00|6110
RENT PAYMENT MAIN OFFICE|DEBIT|2800.00|6100
PUBLIC STORAGE UNIT|DEBIT|180.00|6100
STARBUCKS|DEBIT|14.50|6150
GRUBHUB ORDER|DEBIT|44.10|6150
UPS STORE LABEL|DEBIT|28.00|6360
USPS SHIPPING|DEBIT|16.50|6360
ADP PAYROLL RUN|DEBIT|3200.00|6000
GUSTO PAYROLL|DEBIT|2800.00|6010
PROGRESSIVE INSURANCE PREMIUM|DEBIT|350.00|6200
STATE FARM INSURANCE|DEBIT|275.00|6200
TRANSFER TO SAVINGS ACCOUNT|DEBIT|900.00|1020
OWNER DRAW APRIL|DEBIT|2000.00|3100
ATM WITHDRAWAL 123 MAIN ST|DEBIT|300.00|3100
SALES TAX PAYMENT STATE OF CA|DEBIT|420.00|2120
SBA LOAN PAYMENT|DEBIT|820.13|2300
VENMO PAYMENT TO JOHN DOE|DEBIT|120.00|6900
AMAZON PURCHASE|DEBIT|45.00|6350
""".strip().splitlines()]
