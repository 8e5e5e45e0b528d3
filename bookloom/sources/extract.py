"""From statement files to the tables an analysis starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.dates import iso_date
from bookloom.operators import doctype
from bookloom.sources import statements

#: Sources whose name ends so are read as delimited lines, all others as free text.
DELIMITED = (".csv", ".tsv")
FAILED = "No transactions could be extracted"


def _date(iso: Column) -> Column:
    """Null where a date stayed raw text."""
    return iso.try_cast("date")


def extract(texts: DataFrame, default_year: int, client_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(transactions, batches) of whole statements (source_id, text).

    Every source is a batch, named by a hash of its name and content; ``transaction_id`` is the
    batch and the row's place in it, so ids stay apart whatever else is read. Batches carry the
    stated balances and period, document type, content hash, and ``success`` with ``error``: a
    source without a usable row stays in the list as a failed batch.
    """
    named = texts.select(
        "source_id", F.coalesce("text", F.lit("")).alias("text"),
        F.substring(F.sha2(F.concat_ws("\n", "source_id", "text"), 256), 1, 32).alias("batch_id"))
    is_table = F.lower("source_id").rlike("(" + "|".join(e.replace(".", r"\.") for e in DELIMITED) + ")$")
    lines = named.where(is_table).select("batch_id", F.posexplode(
        F.split("text", r"\r?\n")).alias("seq", "line"))
    columns = ["batch_id", "seq", "date", "description", "amount", "direction"]
    cells = statements.delimited(lines.withColumn("seq", F.col("seq").cast("bigint"))
                                 .withColumnRenamed("batch_id", "source_id"), default_year)
    free = statements.free_text(named.where(~is_table), default_year, key="batch_id")
    rows = (cells.withColumnRenamed("source_id", "batch_id").select(*columns)
            .unionByName(free.withColumn("seq", F.col("line_no").cast("bigint")).select(*columns)))
    transactions = rows.select(
        F.lit(client_id).cast("bigint").alias("client_id"), "batch_id", "seq",
        F.concat_ws("-", "batch_id", F.col("seq").cast("string")).alias("transaction_id"), "date",
        _date(F.col("date")).alias("txn_date"), "description", "amount", "direction")

    facts = statements.metadata(named)
    kinds = doctype.classify(named.select("source_id", "text")).select("source_id", "document_type")
    end = iso_date(F.col("period_end"), default_year)
    start = _date(iso_date(F.concat_ws(" ", "period_start", F.substring(end, 1, 4)), default_year))
    end = _date(end)
    # a period that begins late in a year ends in the next
    start = F.when(start > end, F.add_months(start, -12)).otherwise(start)
    found = transactions.groupBy("batch_id").agg(F.count("*").alias("n"))
    batches = (facts.withColumn("source_hash", statements.fingerprint(F.col("text")))
               .join(kinds, "source_id", "left").join(found, "batch_id", "left")
               .select(F.lit(client_id).cast("bigint").alias("client_id"), "batch_id",
                       start.alias("period_start"), end.alias("period_end"), "beginning_balance",
                       "ending_balance", F.col("source_id").alias("source_document"),
                       "document_type", "account_last4", "source_hash",
                       F.col("n").isNotNull().alias("success"),
                       F.when(F.col("n").isNull(), FAILED).alias("error")))
    return transactions, batches
