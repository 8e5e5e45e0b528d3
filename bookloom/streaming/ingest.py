"""Incremental folder ingest: new statement files are scrubbed or read as they arrive.

Every operator used here is narrow, so the batch functions serve the stream unchanged and
no state or watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bookloom.operators import scrub
from bookloom.sources import extract, statements


def stream_texts(spark: SparkSession, folder: str, glob: str = "*.{txt,text,csv}") -> DataFrame:
    """Whole files as (source_id, text), each read once."""
    return (spark.readStream.format("text").option("wholetext", True)
            .option("pathGlobFilter", glob).load(folder)
            .select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("text")))


def _texts_of(spark: SparkSession, folder: str) -> DataFrame:
    return stream_texts(spark, folder, "*.{txt,text,csv,tsv}")


def scrub_folder(spark: SparkSession, folder: str, out: str, checkpoint: str,
                 terms: list[str] | None = None) -> StreamingQuery:
    """Scrub the files not yet done and write one row per file; stops when caught up."""
    done = scrub.report(scrub.redact(scrub.detect(_texts_of(spark, folder), terms=terms)))
    # as in a single scrub, a file without any text is a failure
    filled = F.trim("redacted") != ""
    result = done.select("source_id", "redacted", "original_chars", "redacted_chars", "items",
                         "by_type", filled.alias("success"),
                         F.when(~filled, "No text could be extracted").alias("error"))
    return (result.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_folder(spark: SparkSession, folder: str, out: str, checkpoint: str,
                default_year: int, client_id: int = 0) -> StreamingQuery:
    """Transactions and batches of the statements not yet read, as two tables under ``out``.

    Files are read in micro-batches, delimited ones too; each is written under its number, so a
    batch that is run again replaces what it wrote."""
    def store(files: DataFrame, number: int) -> None:
        rows, batches = extract.extract(files, default_year, client_id)
        rows.write.mode("overwrite").parquet(f"{out}/transactions/run={number}")
        batches.write.mode("overwrite").parquet(f"{out}/batches/run={number}")

    return (_texts_of(spark, folder).writeStream.foreachBatch(store)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
