"""Exact duplicates by a persistent digest index, bucketed and sorted by digest.

The index is a bucketed table with one row per distinct text: digest, the row that stays and how
many rows have that text. A batch is first grouped by digest (partial sums first, so a digest with
any share of the rows is cheap), then anti-joined with the index by sort-merge on the bucket
column, and what is new is appended. A later batch never displaces a row that already stays.

Texts are equal when identical after deleting blanks and the characters 09 to 0D; null counts as
empty. In a group the row with the most code points in its text, then the smallest id, stays; null
ids come last. Repeated rows with the same id are one group; all of them carry kept = true when
their id stays. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import settle

#: A digest that holds more than one row in so many is joined by broadcast: at most so many are.
HOT_SHARE = 1_000


def digest(text: str | Column = "text") -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")
    return F.sha2(bare, 256)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, points (code points of the text as it is)."""
    return docs.select("doc_id", digest().alias("text_sha256"),
                       F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("points"))


class DigestIndex:
    """A table of the warehouse, made when first appended to."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(self) -> DataFrame | None:
        return self.spark.table(self.table) if self.spark.catalog.tableExists(self.table) else None

    def groups(self, batch: DataFrame) -> DataFrame:
        """One row per digest of a batch made by digests()."""
        best = F.max(F.struct("points", (-F.col("doc_id")).alias("less"))).alias("best")
        return batch.groupBy("text_sha256").agg(best, F.count("*").alias("group_size")).select(
            "text_sha256", (-F.col("best.less")).alias("keep_id"),
            F.col("best.points").alias("points"), "group_size")

    def append(self, batch: DataFrame) -> None:
        """Adds the digests that the index lacks; sort-merge on its buckets, no index shuffle."""
        new, known = self.groups(batch), self.rows()
        if known is not None:
            new = settle(new.join(known.select("text_sha256").hint("merge"), "text_sha256",
                                  "left_anti"), "new_digests")
        (new.repartition(self.buckets, "text_sha256").sortWithinPartitions("text_sha256").write
         .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").mode("append")
         .saveAsTable(self.table))

    def hot(self, batch: DataFrame) -> DataFrame:
        """text_sha256, keep_id, group_size of the digests with over a thousandth of the batch's rows,
        a thousand at most, however large the index is."""
        rows = batch.count()
        many = batch.groupBy("text_sha256").count().where(F.col("count") * HOT_SHARE > rows)
        index = self.rows().select("text_sha256", "keep_id", "group_size")
        return settle(index.join(F.broadcast(many.select("text_sha256")), "text_sha256"), "hot_digests")

    def decide(self, batch: DataFrame) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 of each row of an appended batch.

        The digests of hot() are broadcast; the others meet the index by sort-merge join."""
        index = self.rows().select("text_sha256", "keep_id", "group_size")
        hot = self.hot(batch)
        is_hot = F.broadcast(hot)
        few = batch.join(is_hot, "text_sha256")
        rest = batch.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti")
        many = rest.join(index.hint("merge"), "text_sha256")
        return few.unionByName(many).select(
            "doc_id", "keep_id", "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Appends docs to the index (a new one if none is given) and tells each row's fate."""
    index = index or DigestIndex(docs.sparkSession)
    batch = settle(digests(docs), "digests")
    index.append(batch)
    return index.decide(batch)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, unchanged; of repeated rows with one id, all with that text."""
    stay = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"),
                                                  F.col("text_sha256").alias("_sha")).distinct()
    same = docs["doc_id"].eqNullSafe(stay["_id"]) & (digest() == stay["_sha"])
    return docs.join(stay, same, "left_semi")
