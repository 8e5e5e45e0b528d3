"""Keeping computed columns computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Struct of what `operators.texts` found out about a row's description.
TEXT = "_text"


def known(rows: DataFrame, field: str, otherwise: Column) -> Column:
    """The fact from ``TEXT`` where the rows carry it, else ``otherwise``."""
    return F.col(TEXT)[field] if TEXT in rows.columns else otherwise


def settle(df: DataFrame, columns: dict[str, Column] | None = None) -> DataFrame:
    """Add ``columns`` behind a one-row ``inline``, which filters are not pushed through.

    A filter on a computed column is normally pushed below the projection by repeating the
    whole expression in it; for rule matching that means matching twice and generated code
    past the size limit. Filters on stored columns still reach the scan.
    """
    columns = columns or {}
    kept = [F.col(c) for c in df.columns if c not in columns]
    # computed in a projection of its own, where code is generated for it
    return df.withColumns(columns).select(
        *kept, F.inline(F.array(F.struct(*[F.col(n) for n in columns]))))


def widen(df: DataFrame, key: str) -> DataFrame:
    """Spread an input that arrives in fewer partitions than there are cores.

    Rule matching costs far more than moving a small input. A large table already has
    many splits and passes through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df
