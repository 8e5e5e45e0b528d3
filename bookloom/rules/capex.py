"""Capital-purchase keywords and asset classes."""

# class|life in years|property class|reference|keywords, in order.
CLASSES = """
vehicle|5|5-year property|MACRS 5-year; IRC 179/168(k) eligible|VEHICLE, CAR, TRUCK, VAN, SUV, AUTO, COPART, IAAI, MANHEIM, CARMAX, CARVANA, DEALER, DMV, TITLE
equipment|7|7-year property|MACRS 7-year; IRC 179/168(k) eligible|EQUIPMENT, MACHINERY, TOOL, LIFT, COMPRESSOR, WELDER, GENERATOR, FORKLIFT, HVAC, OVEN, MIXER, REFRIGERATOR, FREEZER
computer|5|5-year property|MACRS 5-year; IRC 179 eligible|COMPUTER, LAPTOP, MACBOOK, IPAD, SERVER, MONITOR, PRINTER, APPLE STORE, DELL, LENOVO
furniture|7|7-year property|MACRS 7-year|FURNITURE, DESK, CHAIR, SHELVING, CABINET, OFFICE FURNITURE
leasehold|15|15-year qualified improvement|Qualified Improvement Property; 168(k) eligible|LEASEHOLD, TENANT IMPROVEMENT, BUILD OUT, RENOVATION, REMODEL
"""

# Words that rule a capital purchase out.
EXCLUSIONS = """
PAYROLL; SALARY; WAGES; DIRECT DEPOSIT; ADP; GUSTO; PAYCHEX; SQUARE PAYROLL
RENT; LEASE PAYMENT; LEASE PMT; PROPERTY MANAGEMENT; PROPERTY MGMT; STORAGE UNIT; EXTRA SPACE; PUBLIC STORAGE; LIFE STORAGE
UTILITY; ELECTRIC; WATER BILL; GAS BILL; POWER BILL; COMCAST; SPECTRUM; AT&T; VERIZON; T-MOBILE; XFINITY; COX COMM; CENTURYLINK
INSURANCE; PREMIUM; GEICO; STATE FARM; PROGRESSIVE; ALLSTATE; LIBERTY MUTUAL; NATIONWIDE; USAA
TRANSFER; XFER; BETWEEN ACCOUNTS; LOAN PAYMENT; NOTE PAYMENT; SBA; LINE OF CREDIT
TAX PAYMENT; EFTPS; FRANCHISE TAX; SALES TAX
OWNER DRAW; OWNER DISTRIBUTION; MEMBER DISTRIBUTION
US FOODS; SYSCO; RESTAURANT DEPOT; GORDON FOOD; PERFORMANCE FOOD
MONTHLY SERVICE FEE; OVERDRAFT; NSF FEE; WIRE FEE
"""

# Accounts already specific enough to skip the large-expense review.
KNOWN_CODES = ("6000 6010 6020 6100 6110 6120 6125 6130 6140 6150 6200 6210 6300 6310 6350 "
               "6360 6400 6410 6450 6500 6510 6600 6700 6800 "
               "5000 5100 5110 5120 5130 5140").split()
DE_MINIMIS = "2500"
LARGE_EXPENSE = "10000"


def exclusions() -> list[str]:
    return [w for line in EXCLUSIONS.strip().splitlines() for w in line.split("; ")]


def classes() -> list[dict]:
    keys = ("name", "life", "property_class", "ref", "words")
    rows = [dict(zip(keys, x.split("|"))) for x in CLASSES.strip().splitlines()]
    return [dict(r, words=r["words"].split(", ")) for r in rows]
