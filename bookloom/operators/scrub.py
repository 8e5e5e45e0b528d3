"""Sensitive-data detection and redaction over whole texts, in one narrow pass.

Spark has no find-all with positions, so each pattern yields its values and the pieces
between them; running lengths of both give the offsets. Texts without a hit of a type
(most texts, for most types) are not split at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.arrays import chunked, let, scan
from bookloom.functions.money import count_if
from bookloom.rules import detectors as rules

SPAN = ("struct<start:int,stop:int,rank:int,code:string,label:string,confidence:double,"
        "value:string,context:string>")


def custom_terms(terms: list[str]) -> list[dict]:
    """Detectors for literal terms, ignoring case; repeats and blanks are left out."""
    kept = list(dict.fromkeys(t for t in terms if t))
    first = len(rules.detectors())
    return [dict(rules.CUSTOM, ordinal=first + i,
                 pattern="".join(re.escape(ch) if not ch.isalnum() and ch.isascii() else ch
                                 for ch in term)) for i, term in enumerate(kept)]


def regex(detector: dict) -> str:
    r"""The pattern as Java reads it. Before Java 19 its ``\b`` counts letters of all scripts while
    ``\w`` counts ASCII ones, so word boundaries are spelled out; literal terms hold none."""
    custom = detector["code"] == rules.CUSTOM["code"]
    pattern = detector["pattern"] if custom else detector["pattern"].replace(r"\b", rules.BOUNDARY)
    return "(?id)" + pattern


def values(text: Column, detector: dict) -> Column:
    return F.regexp_extract_all(text, F.lit(regex(detector)), F.lit(0))


def spans(text: Column, detector: dict) -> Column:
    """Array of spans of one detector, offsets counted in characters from zero."""
    found = values(text, detector)
    window = rules.CONTEXT

    def locate(hits: Column) -> Column:
        pieces = F.split(text, regex(detector), -1)

        def step(at: Column, pair: Column) -> tuple[Column, Column]:
            start = at + F.length(pair["gap"])
            stop = start + F.length(pair["hit"])
            return stop, F.array(F.struct(start.alias("start"), stop.alias("stop"),
                                          pair["hit"].alias("hit")))

        pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
        places = scan(F.transform(pairs, lambda p: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"))),
                      F.lit(0), step, "struct<start:int,stop:int,hit:string>")
        return let(places, lambda x: F.flatten(chunked(x, around)))

    def around(chunk: Column, _: Column) -> Column:
        """Spans of a chunk; their contexts are cut from the part of the text that it covers."""
        low = F.greatest(F.lit(0), F.get(chunk, 0)["start"] - window)
        part = F.substring(text, low + 1, F.get(chunk, F.size(chunk) - 1)["stop"] + window - low)

        def span(t: Column, h: Column) -> Column:
            left = F.greatest(F.lit(0), h["start"] - window)
            return F.struct(
                h["start"].alias("start"), h["stop"].alias("stop"), F.lit(detector["ordinal"]).alias("rank"),
                F.lit(detector["code"]).alias("code"), F.lit(detector["label"]).alias("label"),
                F.lit(detector["confidence"]).alias("confidence"), h["hit"].alias("value"),
                F.substring(t, left - low + 1, h["stop"] + window - left).alias("context"))

        return let(part, lambda t: F.transform(chunk, lambda h: span(t, h)))

    bound = F.transform(F.array(found), lambda h: F.when(F.size(h) > 0, locate(h)))
    return F.coalesce(F.get(bound, 0), F.array().cast(f"array<{SPAN}>"))


def detect(rows: DataFrame, text: str = "text", terms: list[str] | None = None,
           only: list[str] | None = None) -> DataFrame:
    """Add ``detections``, sorted by start and then by scan order."""
    chosen = [d for d in rules.detectors() + custom_terms(terms or [])
              if only is None or d["code"] in only]
    parts = {f"_d{d['ordinal']}": spans(F.col(text), d) for d in chosen}
    all_spans = F.concat(*[F.col(c) for c in parts])
    by_start = F.array_sort(F.transform(all_spans, lambda s: F.struct(
        s["start"].alias("a"), s["rank"].alias("b"), s.alias("s"))))
    return (rows.withColumns(parts)
            .withColumn("detections", F.transform(by_start, lambda x: x["s"]))
            .drop(*parts))


def resolve() -> Column:
    """Detections that survive: by start, then confidence, keep what starts at or after
    the end of the last one kept."""
    ordered = F.transform(F.array_sort(F.transform("detections", lambda s: F.struct(
        s["start"].alias("a"), (-s["confidence"]).alias("b"), s["rank"].alias("c"), s.alias("s")))),
        lambda x: x["s"])
    def step(end: Column, s: Column) -> tuple[Column, Column]:
        stays = s["start"] >= end
        return (F.when(stays, s["stop"]).otherwise(end),
                F.when(stays, F.array(s)).otherwise(F.array().cast(f"array<{SPAN}>")))

    return scan(ordered, F.lit(-1), step, SPAN)


def replacement(span: Column, keep_last_four: bool = True) -> Column:
    """The token for a span; card and account numbers may keep their last four digits."""
    digits = F.regexp_replace(span["value"], r"\D", "")
    last = F.lpad(F.right(digits, F.lit(4)), 4, "X") if keep_last_four else F.lit("XXXX")
    chain = F
    for d in [*rules.detectors(), rules.CUSTOM]:
        before, mark, after = d["token"].partition("{last4}")
        token = F.concat(F.lit(before), last, F.lit(after)) if mark else F.lit(before)
        chain = chain.when(span["code"] == d["code"], token)
    return chain.otherwise(F.lit(rules.CUSTOM["token"]))


def redact(rows: DataFrame, text: str = "text", keep_last_four: bool = True) -> DataFrame:
    """Add ``kept`` spans and the ``redacted`` text: gaps and tokens in turn.

    A place in a text is found by reading up to it, so each chunk of spans first cuts out the
    part of the text that it covers."""
    out = rows.withColumn("kept", resolve())
    whole = F.col(text)

    def rewritten(kept: Column) -> Column:
        def part(chunk: Column, first: Column) -> Column:
            at = F.coalesce(F.get(kept, first - 1)["stop"], F.lit(0))
            covered = F.substring(whole, at + 1, F.get(chunk, F.size(chunk) - 1)["stop"] - at)

            def piece(t: Column, s: Column, i: Column) -> Column:
                before = F.coalesce(F.get(chunk, i - 1)["stop"], at)
                return F.concat(F.substring(t, before - at + 1, s["start"] - before),
                                replacement(s, keep_last_four))

            return let(covered, lambda t: F.transform(chunk, lambda s, i: piece(t, s, i)))

        end = F.coalesce(F.get(kept, F.size(kept) - 1)["stop"], F.lit(0))
        return F.concat(F.array_join(F.flatten(chunked(kept, part)), ""),
                        F.substring(whole, end + 1, F.length(whole)))

    rebuilt = let(F.col("kept"), rewritten)
    return out.withColumn("redacted", F.when(F.size("detections") == 0, F.col(text))
                          .otherwise(rebuilt))


def counts(detected: DataFrame, by: list[str]) -> DataFrame:
    """Detections per key and type."""
    return (detected.select(*by, F.explode("detections.label").alias("label"))
            .groupBy(*by, "label").agg(F.count("*").alias("items")))


def report(redacted: DataFrame, text: str = "text") -> DataFrame:
    """Per text: characters before and after, items found, items by type."""
    labels = sorted([d["label"] for d in rules.detectors()] + [rules.CUSTOM["label"]])

    def count(label: str) -> Column:
        hits = F.size(F.filter("detections", lambda d: d["label"] == label))
        return F.when(hits > 0, F.concat(F.lit(f"{label}="), hits.cast("string")))

    by_type = F.array_compact(F.array(*[count(label) for label in labels]))
    return redacted.withColumns({
        "original_chars": F.length(text), "redacted_chars": F.length("redacted"),
        "items": F.size("detections"), "by_type": F.array_join(by_type, "; ")})


def examples(detected: DataFrame, by: list[str]) -> DataFrame:
    """The first three values of each type per text, all but the last four masked."""
    n = rules.EXAMPLES_PER_TYPE
    codes = F.array_distinct(F.transform("detections", lambda d: d["code"]))
    first = F.flatten(F.transform(codes, lambda c: F.slice(
        F.filter("detections", lambda d: d["code"] == c), 1, n)))
    value = F.col("d.value")
    masked = F.concat(F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(value) - 4)),
                      F.right(value, F.lit(4)))
    return (detected.select(*by, F.explode(first).alias("d"))
            .select(*by, F.col("d.start").alias("start"), F.col("d.label").alias("label"),
                    masked.alias("masked"), F.col("d.confidence").alias("confidence")))


def folder_totals(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Texts done, texts failed and items redacted, from per-text outcomes."""
    return outcomes.groupBy(*(by or [])).agg(
        count_if(F.col("success")).alias("succeeded"),
        count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("items"))), F.lit(0)).cast("bigint")
        .alias("total_redacted"))
