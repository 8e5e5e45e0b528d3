"""The registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm import (arc, decontam, exact_dedup, forest, language, minhash, packing, phrases, planes, repair,
                          repeats, token_count, toxicity)
from bookloom.llm.common import scratch, table
from bookloom.llm.tokenizer import default_path


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = token_count.count_tokens(table(spark, folder, "documents"),
                                     default_path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), default_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return forest.near_duplicates(table(spark, folder, "documents"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    old, new = scratch(spark, "arc"), scratch(spark, "warc")
    arc.write_arc(table(spark, folder, "pages"), old)
    arc.write_warc(arc.read_arc(spark, old), new)
    return arc.read_warc(spark, new).select("page_id", "payload_bytes", "payload_digest",
                                            "record_type", "refers_to")


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)
                        .alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_of(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_planes(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch(spark, "planes")
    planes.write_planes(table(spark, folder, "documents"), out, default_path("word_bpe_49k.json"), 2)
    return planes.read_planes(spark, out).select("doc_id", "start", "n_tokens",
                                                 F.crc32("ids").alias("ids_crc32"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_of(table(spark, folder, "documents"))


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return repair.damaged_and_repaired(table(spark, folder, "conversations"))


def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_packing, op4_jaccard_join, op5_warc,
                            op6_exact_dedup, op7_repeats, op8_toxicity, op9_planes, op10_language,
                            op11_conversations, op12_minhash, op13_phrases)}

ORACLES = {"op2_decontamination": decontam.oracle(), "op11_conversations": repair.oracle(),
           "op12_minhash": minhash.ORACLE, "op13_phrases": phrases.ORACLE, "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, length(t) AS points,
             sha256(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)"""}
