"""Exact money: two-digit decimals, half-up rounding, tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
MONEY_TEXT = r"^-?\d+\.\d{2}$"


def cents(value: Column) -> Column:
    """Round to cents, ties away from zero."""
    return F.round(value, 2).cast(MONEY)


def money(value: Column) -> Column:
    return value.cast(MONEY)


def total(value: Column, when: Column | None = None) -> Column:
    """Sum of money over rows where ``when`` holds; zero for none."""
    kept = value if when is None else F.when(when, value)
    return F.coalesce(F.sum(kept), F.lit(0)).cast(MONEY)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def parse_amount(raw: Column) -> Column:
    """``$1,234.50`` and ``(1,234.50)`` to decimal; null when it is not a number."""
    plain = F.regexp_replace(F.trim(raw), r"[$, ]", "")
    signed = F.regexp_replace(plain, r"^\((.*)\)$", "-$1")
    return F.when(F.coalesce(raw, F.lit("")) != "", signed.try_cast(T.DecimalType(18, 2)))


def float_money_columns(df: DataFrame, money_columns: list[str]) -> list[str]:
    """Money columns that are binary floats, which the ledger refuses."""
    bad = (T.FloatType, T.DoubleType)
    return [f.name for f in df.schema if f.name in money_columns and isinstance(f.dataType, bad)]


def require_exact_money(df: DataFrame, money_columns: list[str]) -> DataFrame:
    bad = float_money_columns(df, money_columns)
    if bad:
        raise TypeError(f"binary float is not allowed for money: {', '.join(bad)}")
    return df


def is_money_text(text: Column) -> Column:
    return text.rlike(MONEY_TEXT)
