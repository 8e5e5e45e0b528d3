"""Statement readers: delimited lines, free text, extracted tables and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.functions.dates import iso_date
from bookloom.functions.money import MONEY, parse_amount
from bookloom.functions.plan import settle
from bookloom.operators.skew import join_totals

# Header names by role.
HEADERS = {
    "date": ["date", "posted date", "posting date", "trans date", "transaction date",
             "effective date", "post date"],
    "text": ["description", "memo", "details", "transaction", "narrative", "payee", "merchant",
             "name"],
    "amount": ["amount", "total", "sum"],
    "credit": ["credit", "credits", "deposit", "deposits"],
    "debit": ["debit", "debits", "withdrawal", "withdrawals", "charge"],
}
# Delimiters told apart by the header line, most preferred first.
DELIMITERS = [",", "\t", ";", "|"]
# A dated line with a trailing amount, and the statement facts.
LINE = (r"(\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?)\s+(.+?)\s+([+-]?\$?[\d,]+\.?\d{0,2})\s*$")
OPENING = r"(?:beginning|opening|previous)\s+balance[\s:$]*(\$?[\d,]+\.\d{2})"
CLOSING = r"(?:ending|closing|new)\s+balance[\s:$]*(\$?[\d,]+\.\d{2})"
PERIOD = (r"(?:period|statement)\s*:?\s*(\w+\s+\d{1,2})\s*[-–]\s*"
          r"(\w+\s+\d{1,2},?\s*\d{4})")
LAST_FOUR = r"account\s*#?\s*:?\s*\*{0,4}(\d{4})\b"

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every file under ``path`` as (source_id, seq, line); files are splittable.

    ``seq`` numbers the lines of a file from 0: each split's lines follow those of the splits
    before it. The table of splits has one row per split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_id"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("line"))
    earlier = W.partitionBy("source_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    splits = (lines.groupBy("source_id", "_block")
              .agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    return lines.join(splits, ["source_id", "_block"]).select(
        "source_id", (F.col("_before") + F.col("_id") - F.col("_first")).alias("seq"), "line")


def read_texts(spark: SparkSession, path: str, glob: str = "*.{txt,text,csv}") -> DataFrame:
    """Whole files as (source_id, text), for readers whose patterns cross lines."""
    return (spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path)
            .select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("text")))


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def split_cells(line: Column, delimiter: Column) -> Column:
    """Cells of a line; a delimiter inside double quotes does not split.

    A piece between quotes lies inside when an odd number of quotes follows it. Delimiters
    inside are set aside while the line is split, so each line is read a fixed number of times.
    """
    mark, aside = F.lit('"'), F.lit("\ue000")
    pieces = F.split(line, '"', -1)
    masked = F.array_join(F.transform(pieces, lambda p, i: F.when(
        (F.size(pieces) - i) % 2 == 0, F.replace(p, delimiter, aside)).otherwise(p)), '"')
    quoted = F.transform(F.split(masked, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")), -1),
                         lambda c: F.replace(c, aside, delimiter))
    plain = F.split(line, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")), -1)
    bare = F.transform(quoted, lambda c: F.when(
        F.trim(c).rlike('(?s)^".*"$'),
        F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"')).otherwise(c))
    return F.when(line.contains(mark), bare).otherwise(plain)


def sniff(header: Column) -> Column:
    """The first preferred delimiter the header holds; a comma when there is none."""
    chain = F
    for d in DELIMITERS:
        chain = chain.when(header.contains(d), F.lit(d))
    return chain.otherwise(F.lit(DELIMITERS[0]))


def header_positions(cells: Column) -> dict[str, Column]:
    """1-based position of the first header of each role, 0 when there is none."""
    names = F.transform(cells, lambda h: F.regexp_replace(F.lower(F.trim(h)), "_", " "))

    def place(aliases: list[str]) -> Column:
        return F.array_position(F.transform(names, lambda n: n.isin(aliases)), F.lit(True)).cast("int")

    return {f"at_{role}": place(aliases) for role, aliases in HEADERS.items()}


def _cell(cells: Column, position: Column) -> Column:
    return F.when(position > 0, F.get(cells, position - 1))


def typed(rows: DataFrame, default_year: int) -> DataFrame:
    """Cells to date, description, amount (positive) and direction; rows that have no
    description or no usable amount are left out."""
    cells = F.col("cells")
    signed = parse_amount(_cell(cells, F.col("at_amount")))
    credit = F.nullif(parse_amount(_cell(cells, F.col("at_credit"))), F.lit(0).cast(MONEY))
    debit = F.nullif(parse_amount(_cell(cells, F.col("at_debit"))), F.lit(0).cast(MONEY))
    one_column = F.col("at_amount") > 0
    out = settle(rows, {
        "description": F.trim(F.coalesce(_cell(cells, F.col("at_text")), F.lit(""))),
        "_signed": F.when(one_column, signed).otherwise(
            F.coalesce(F.abs(credit), -F.abs(debit)))})
    return (out.where((F.col("description") != "") & F.col("_signed").isNotNull())
            .withColumns({"date": iso_date(F.coalesce(_cell(cells, F.col("at_date")), F.lit("")), default_year),
                          "amount": F.abs("_signed").cast(MONEY),
                          "direction": F.when(F.col("_signed") >= 0, "CREDIT").otherwise("DEBIT")})
            .drop("_signed"))


def delimited(lines: DataFrame, default_year: int, few_sources: bool = False) -> DataFrame:
    """Transactions from header-led delimited lines (source_id, seq, line).

    The first line of a source names its columns. One header row per source is joined to
    the lines, spread out for a source that holds much of the data; where the caller knows that
    ``few_sources`` hold all lines, their headers are sent to the lines instead, which stay in place.
    """
    first = lines.groupBy("source_id").agg(F.min("seq").alias("header_seq"), F.count("*").alias("rows"))
    # no header stands behind the last of them, so most lines are left out before they are put together
    last = first.agg(F.max("header_seq")).scalar()
    heads = lines.where(F.col("seq") <= last).groupBy("source_id").agg(
        F.min_by("line", "seq").alias("header"), F.min("seq").alias("header_seq"))
    heads = heads.withColumn("delimiter", sniff(F.col("header")))
    heads = heads.withColumn("_h", split_cells(F.col("header"), F.col("delimiter")))
    heads = heads.withColumns(header_positions(F.col("_h"))).drop("_h", "header")
    if few_sources:
        body = lines.join(F.broadcast(heads), "source_id")
    else:
        heads = heads.join(first.select("source_id", "rows"), "source_id")
        body = join_totals(lines, heads, ["source_id"], "rows", F.col("seq"), how="inner")
    # settled, so that lines are split once and not in the join's condition as well
    body = settle(body.where(F.col("seq") > F.col("header_seq")), {"cells": F.when(
        F.col("line") != "", split_cells(F.col("line"), F.col("delimiter")))}).where("cells IS NOT NULL")
    return typed(body, default_year).select(
        "source_id", "seq", "date", "description", "amount", "direction")


def free_text(rows: DataFrame, default_year: int, key: str = "source_id") -> DataFrame:
    """Transactions from dated lines with a trailing amount, anywhere in the text.

    The pattern runs over the whole text since its gaps may cross a line break.
    """
    pattern = "(?md)" + LINE
    hits = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda m: F.struct(
        F.regexp_extract(m, pattern, 1).alias("d"), F.regexp_extract(m, pattern, 2).alias("t"),
        F.regexp_extract(m, pattern, 3).alias("a")))
    signed = parse_amount(F.col("m.a"))
    return (rows.select(key, F.posexplode(hits).alias("line_no", "m"))
            .select(key, "line_no", iso_date(F.col("m.d"), default_year).alias("date"),
                    F.trim("m.t").alias("description"), signed.alias("_signed"))
            .where(F.col("_signed").isNotNull() & (F.col("description") != ""))
            .select(key, "line_no", "date", "description",
                    F.abs("_signed").cast(MONEY).alias("amount"),
                    F.when(F.col("_signed") >= 0, "CREDIT").otherwise("DEBIT").alias("direction")))


def tables(rows: DataFrame, default_year: int, key: str = "source_id") -> DataFrame:
    """Transactions from extracted tables: ``table`` is rows of cells, the first the header."""
    positions = header_positions(F.transform(F.get("table", 0), lambda h: F.coalesce(h, F.lit(""))))
    body = (rows.where(F.size("table") > 1).withColumns(positions)
            .select(key, *positions, F.posexplode(
                F.slice("table", 2, F.size("table"))).alias("line_no", "cells"))
            .where(F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != "")))
    return typed(body, default_year).select(key, "line_no", "date", "description", "amount",
                                            "direction")


def metadata(rows: DataFrame) -> DataFrame:
    """Opening and closing balance, period and account last four; null where not stated."""
    low = F.lower("text")

    def found(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.trim(F.regexp_extract(low, pattern, group)), F.lit(""))

    return rows.withColumns({
        "beginning_balance": parse_amount(found(OPENING)),
        "ending_balance": parse_amount(found(CLOSING)),
        "period_start": found(PERIOD, 1), "period_end": found(PERIOD, 2),
        "account_last4": found(LAST_FOUR)})
