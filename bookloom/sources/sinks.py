"""Writers: scrubbed texts and reports, workpaper packages, durable stage tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def write_scrubbed(redacted: DataFrame, path: str, key: str = "source_id") -> None:
    """Scrubbed text and report figures, one row per input text."""
    redacted.select(key, "redacted").write.mode("overwrite").parquet(f"{path}/scrubbed")
    redacted.drop("text", "redacted", "detections", "kept").write.mode("overwrite").parquet(
        f"{path}/reports")


def write_package(package: DataFrame, path: str, files_per_section: int | None = None) -> None:
    """The workpaper package as JSON lines, one folder per section, sorted by batch."""
    out = package.repartition(files_per_section, "section", "batch_id") if files_per_section \
        else package
    (out.sortWithinPartitions("batch_id", "sort_key")
     .write.mode("overwrite").partitionBy("section").json(path))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on shared storage: the checkpoint folder, or the warehouse where that is unset."""
    base = spark.conf.get(CHECKPOINT_DIR, None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut lineage where a stage is used many times: a table at ``path`` or a checkpoint.

    Both live on shared storage, so a lost executor costs no recomputation. The checkpoint
    folder is the one the session names.
    """
    spark = df.sparkSession
    if path is not None:
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if spark.conf.get(CHECKPOINT_DIR, None) is None and \
            spark.sparkContext.getCheckpointDir() is None:
        raise ValueError(f"set {CHECKPOINT_DIR} or pass a path")
    return df.checkpoint()
