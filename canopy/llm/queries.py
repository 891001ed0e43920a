"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import (
    decontaminate,
    filter_audit,
    langid,
    license_scan,
    line_dedup,
    nearest,
    packing,
    ppm,
    quality,
    sharding,
    simhash,
    token_counts,
    vector_codes,
)
from canopy.llm.common import id_remainder, read_table
from canopy.llm.oracle import ORACLE  # noqa: F401

SHARDS = 40


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, id_remainder("doc_id", 5) != 0)
    return langid.label(docs, model).select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score",
        "spans")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"),
                                        read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        "contaminated")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read_table(spark, sf_dir, "documents"), id_remainder("doc_id", 10) != 0)


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(
        read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), shards=SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_json())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = quality.train(docs, read_table(spark, sf_dir, "labels"),
                           id_remainder("doc_id", 5) != 0)
    return quality.score(docs, scorer).select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_json())


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"),
                              read_table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode(read_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", vector_codes.hex_code("codes").alias("code"), "error",
                        "label_error",
                        F.lit(vector_codes.fingerprint(books)).alias("codebooks_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents")).drop("found")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_language_id, op2_decontamination, op3_lm_scoring, op4_simhash_neardup,
        op5_nearest_neighbours, op6_line_dedup, op7_sharding, op8_token_counts,
        op9_quality_classifier, op10_packing, op11_filter_interaction, op12_vector_codes,
        op13_license_scan)}
