"""Matching rows against rules that belong to their client.

Rules are packed per client, best first, and joined on the client id. The optimiser decides
whether the packed table is broadcast, from its measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.matching import let

#: Most rules of one client; more is an error, since a client's rules travel in one row.
CLIENT_RULES = 200_000


def match_client_rules(rows: DataFrame, rules: DataFrame, text: Column, pattern: str,
                       rank: list[str], payload: list[str], name: str,
                       side: Column | None = None, rule_side: str | None = None,
                       only: Column | None = None) -> DataFrame:
    """Add struct ``name``: the best rule of the row's client whose pattern is in ``text``.

    Best is smallest by ``rank`` (columns of ``rules``). An empty pattern is in every text,
    a null text or pattern in none. ``only`` restricts which rows are tried.
    """
    tried = F.coalesce(only, F.lit(False)) if only is not None else F.lit(True)
    need_side = side is not None and rule_side is not None

    def side_ok(rule: Column) -> Column:
        if not need_side:
            return F.lit(True)
        return (rule == "") | (side == "") | (rule == side)

    extra = [rule_side] if rule_side and rule_side not in payload else []
    packed = (rules.groupBy("client_id")
              .agg(F.array_sort(F.collect_list(F.struct(
                  *rank, F.col(pattern).alias("_pattern"),
                  *[F.col(c) for c in [*payload, *extra] if c not in rank]))).alias("_rules")))
    packed = packed.withColumn("_rules", F.when(F.size("_rules") <= CLIENT_RULES, F.col("_rules"))
                               .otherwise(F.raise_error(F.lit("too many rules of one client"))))
    hit = let(text, lambda t: F.get(F.filter(
        "_rules", lambda r: t.contains(r["_pattern"])
        & (side_ok(r[rule_side]) if need_side else F.lit(True))), 0))
    return (rows.join(packed, "client_id", "left")
            .withColumn(name, F.when(tried, hit)).drop("_rules"))
