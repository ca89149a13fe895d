"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payproof.llm import (
    chat,
    html,
    licenses,
    middle,
    neardup,
    negatives,
    packing,
    pieces,
    pii,
    quality,
    simhash,
    substrings,
    topk,
)
from payproof.llm.oracle import oracle_sql as oracle_sql
from payproof.llm.tables import read, written


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, read(spark, sf_dir, "labels"))
    counts = [F.col(f"statistics.{c}").alias(c) for c in quality.COUNTS]
    return quality.judged(docs, rules).select("doc_id", *counts, "base_failed", "kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoted = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(quoted).alias("text"),
    )
    return chat.read_back(chat.windows(given.unionByName(more))).select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("targets").cast("long").alias("loss_chars"),
        F.sha2("targets", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scanned(docs).select("doc_id", "license.*")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    spans = written(pii.found(docs).select("doc_id", "base", "more"))
    both = F.concat("base", pii.accepted(pii.fit(spans)))
    counts = [F.size(F.filter("base", pii.of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    return spans.select(
        "doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(both).alias("spans")
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encoded(docs, keep_ids=False).select("doc_id", "encoded.n_ids", "encoded.ids_crc32", "encoded.round_trip")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extracted(pages).withColumn("n_chars", F.length("text").cast("long"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return middle.transformed(docs, keep_output=False).drop("output")


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}

