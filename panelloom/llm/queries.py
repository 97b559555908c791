"""The corpus operators and the pipeline as registered queries, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelloom.llm import (
    chat, common, decontam, divergence, exact, lines, mainhtml, mixing, near, negatives, passages, secret_scan, toxicity, urls,
)
from panelloom.llm.common import table
from panelloom.llm.oracle import ORACLE  # noqa: F401

# Functions that run in tasks travel by value, so executors need no installed package.
for _module in (common, divergence, exact, mainhtml, near, negatives, passages, toxicity):
    cloudpickle.register_pickle_by_value(_module)

NEAR = near.NearConfig(shingle=4, percent=80)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score; rows of remainder 1 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.counted(secret_scan.scan(table(spark, sf_dir, "documents")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(mixing.measured(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(table(spark, sf_dir, "documents"), NEAR)


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.drop_repeats(table(spark, sf_dir, "documents"))
    span = lambda p: F.concat_ws(":", p["start"].cast("string"), p["stop"].cast("string"))
    return out.select(
        "doc_id", "n_removed", F.array_join(F.transform("removed", span), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.main_text(table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_decontamination, op3_url_filter, op4_chat_format, op5_exact_dedup,
        op6_secret_scan, op7_line_dedup, op8_mixing, op9_near_dedup, op10_passage_dedup,
        op11_source_divergence, op12_html_extraction, op13_hard_negatives,
    )
}

