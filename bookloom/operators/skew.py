"""Joins and running counts that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rows of a key that one task joins. Keys with more are split in as many parts as that takes;
# there are at most total/HOT_ROWS such keys, which is what bounds the broadcast below.
HOT_ROWS = 1_000_000


def join_totals(facts: DataFrame, totals: DataFrame, keys: list[str], rows: str,
                spread: Column, how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join per-key ``totals`` back to ``facts``.

    ``totals`` has one row per key and its row count in ``rows``. A key's rows are spread
    over one part per ``hot_rows`` by ``spread`` and its totals row is copied to each part;
    most keys have one part, so nothing is dropped and nothing is copied twice.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col(rows) / hot_rows)).cast("int")
    hot = totals.where(F.col(rows) > hot_rows).select(*keys, parts.alias("_parts"))
    salted = (facts.join(F.broadcast(hot), keys, "left")
              .withColumn("_salt", F.pmod(F.coalesce(spread, F.lit(0)),
                                          F.coalesce("_parts", F.lit(1))).cast("int"))
              .drop("_parts"))
    copied = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(rows)
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")


def running_index(df: DataFrame, keys: list[str], order: str, width: int,
                  name: str = "nth") -> DataFrame:
    """1-based position of each row within its key by ``order``.

    Rows are numbered inside (key, slice of the order column) and shifted by the counts
    of earlier slices, so a hot key is ordered in slices rather than in one task.
    """
    sliced = df.withColumn("_slice", F.expr(f"{order} div {width}"))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(
        W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, "_slice", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(order))
    return (sliced.withColumn("_inside", inside)
            .join(offsets, [*keys, "_slice"])
            .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
            .drop("_slice", "_inside", "_before"))
