"""Statement dates: month first, several layouts, raw text kept when unreadable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each layout is (shape the text must have, Spark datetime pattern). Month comes before day, and
# after it only where the first number is no month, so a later layout of one shape is a fallback.
LAYOUTS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "M.d.yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
]


def iso_date(raw: Column, default_year: int) -> Column:
    """``YYYY-MM-DD``; month/day without a year takes ``default_year``.

    Read: the numeric layouts above with one of / - . between the parts, two-digit years (below
    69 is this century), eight digits, month names in full or in three letters (and Sept) before
    or after the day, and any ISO date with a time behind it. Other text is given back trimmed."""
    text = F.trim(raw)
    short = F.regexp_replace(text, r"^(\d{1,2})[/-](\d{1,2})$", rf"$1/$2/{default_year}")
    short = F.regexp_replace(short, r"^(\d{4}-\d{2}-\d{2})[T ]\d{1,2}:\d{2}.*$", "$1")
    wide = F.when(
        short.rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2}$"),
        F.concat(F.regexp_replace(short, r"\d{2}$", ""),
                 F.when(F.right(short, F.lit(2)).try_cast("int") < 69, F.lit("20"))
                 .otherwise(F.lit("19")),
                 F.right(short, F.lit(2)))).otherwise(short)
    plain = F.initcap(F.regexp_replace(F.regexp_replace(wide, ",", ""), r"\.? +", " "))
    plain = F.regexp_replace(plain, "Sept ", "Sep ")
    tries = [F.when(plain.rlike(shape), F.try_to_timestamp(plain, F.lit(layout)))
             for shape, layout in LAYOUTS]
    return F.coalesce(F.date_format(F.coalesce(*tries), "yyyy-MM-dd"), text, F.lit(""))
