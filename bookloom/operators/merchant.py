"""Merchant normalisation: clean, tokenise, resolve to one merchant id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.matching import first_word, pick
from bookloom.functions.plan import known
from bookloom.operators.client_rules import match_client_rules
from bookloom.rules import merchants as rules


def _words(group: str) -> str:
    return r"\b(?:" + "|".join(group.split()) + r")\b"


def clean(description: Column) -> Column:
    """Upper case without bank noise, odd punctuation or repeated spaces."""
    noise = [_words(rules.NOISE_WORDS_FIRST), rules.NOISE_CHECK,
             _words(rules.NOISE_WORDS_SECOND), *rules.NOISE_NUMBERS, rules.PUNCTUATION, r"\s+"]
    upper = F.upper(F.trim(description))
    return F.trim(reduce(lambda text, p: F.regexp_replace(text, p, " "), noise, upper))


def tokens(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "),
                    lambda t: (F.length(t) > 1) & ~t.isin(rules.STOP_WORDS))


def alias(cleaned: Column) -> Column:
    table = rules.aliases()
    return pick([{"c": r["canonical"]} for r in table], "c:string",
                first_word(cleaned, [r["alias"] for r in table]))["c"]


def provisional(cleaned: Column, words: Column) -> Column:
    return F.when(F.size(words) > 0, F.upper(F.array_join(F.slice(words, 1, 3), "_"))) \
        .otherwise(F.upper(F.substring(cleaned, 1, 20)))


def light_clean(description: Column) -> Column:
    """Strip bank prefixes one after the other, then trailing reference parts."""
    text = F.upper(F.trim(description))
    for prefix in rules.LIGHT_PREFIXES:
        rest = F.btrim(F.substring(text, len(prefix) + 1, 2**31 - 1), F.lit(" -#"))
        text = F.when(text.startswith(prefix), rest).otherwise(text)
    for tail in rules.LIGHT_TAILS:
        text = F.regexp_replace(text, tail, "")
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.trim(description))


def normalize(rows: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Add ``merchant_clean``, ``merchant_tokens``, ``canonical_merchant_id`` and how it
    was found. A client's own dictionary (first listed hit) goes before the aliases."""
    out = (rows.withColumn("merchant_clean", known(rows, "clean", clean(F.col("description"))))
           .withColumn("merchant_tokens", known(rows, "tokens", tokens(F.col("merchant_clean")))))
    if dictionary is not None:
        keyed = dictionary.withColumn("pattern", F.upper("pattern"))
        out = match_client_rules(out, keyed, F.col("merchant_clean"), "pattern", ["ordinal"],
                                 ["canonical_id", "default_account"], "_own")
    else:
        out = out.withColumn("_own", F.lit(None).cast("struct<canonical_id:string>"))
    found = F.when(F.col("_own").isNull(), known(rows, "alias", alias(F.col("merchant_clean"))))
    return (out.withColumn("_alias", found)
            .withColumns({
                "canonical_merchant_id": F.coalesce(
                    F.col("_own.canonical_id"), F.col("_alias"),
                    provisional(F.col("merchant_clean"), F.col("merchant_tokens"))),
                "client_matched": F.col("_own").isNotNull(),
                "alias_matched": F.col("_alias").isNotNull()})
            .drop("_own", "_alias"))
