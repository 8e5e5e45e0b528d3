"""What the corpus operators share: reading tables, shared scratch tables, files of raw bytes."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labels that a sample covers: the commonest.
LABELS = 1_000
TOP = (1 << 63) - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # lets Python workers that share this machine find the package, wherever the driver was started
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that the driver and all executors share.

    spark.checkpoint.dir names it; where that is unset, the warehouse is used, which is shared too."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs neither repeat its work nor
    depend on executors that may be lost."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """Writes df to a new table of the warehouse in buckets of a column: joins on that column then
    move the other side only."""
    spark = df.sparkSession
    name, n = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, column).write.bucketBy(n, column).sortBy(column)
     .option("compression", "zstd").saveAsTable(name))
    return spark.table(name)


def remainder(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id written as text, modulo k; it decides which rows are held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str)
                  else F.crc32(doc_id.cast("string").cast("binary")), F.lit(k))


def text_hash() -> Column:
    return F.xxhash64("text").bitwiseAND(F.lit(TOP))


def sample(rows: DataFrame, texts: DataFrame, limit: Column, labels: int = LABELS) -> DataFrame:
    """label, text, h: up to `limit` (a column of `label`) different texts of each label, those with the
    smallest hashes. rows: label, h of what is labelled; texts: text, of which those with an h are looked
    up. Equal texts of a label count once, so neither null ids nor repeated rows add to it.

    Only hashes move, and those of the sample (`limit` for each of `labels` labels) are broadcast."""
    sizes = rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).orderBy(
        F.col("n").desc(), "label").limit(labels)
    few = rows.join(F.broadcast(sizes), "label").where(
        F.col("h").cast("double") * F.col("n") <= 1.3 * TOP * limit).select("label", "h").distinct()
    order = W.partitionBy("label").orderBy("h")
    picked = few.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).select("label", "h")
    return texts.select("text", text_hash().alias("h")).join(F.broadcast(picked), "h").groupBy(
        "label", "h").agg(F.min("text").alias("text")).select("label", "text", "h")


def trained(taken: DataFrame, fit: Callable[[list[tuple]], Any]) -> Any:
    """fit(rows) of a sample (label, text, h), in one task; only the model comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            rows.extend(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield pa.record_batch([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    row = taken.repartition(1).sortWithinPartitions("h", "label").select("label", "text").mapInArrow(
        run, "model binary").head()
    return fit([]) if row is None else pickle.loads(row["model"])


def write_files(files: DataFrame, folder: str, separator: str = "\n", compress: bool = False,
                per_file: int = 0) -> None:
    """Writes a binary column `content` as raw bytes, a row after another, each followed by the
    separator, through Spark's own writer, so any storage will do and lost tasks are redone.
    per_file: the most rows in one file (0: all of a partition)."""
    (files.select(F.col("content").cast("string").alias("value")).write
     .option("lineSep", separator).option("compression", "gzip" if compress else "none")
     .option("maxRecordsPerFile", per_file).text(folder))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of every file in the folder."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
            .where("length > 0").select("path", "content"))
